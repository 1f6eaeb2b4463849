from itertools import combinations

import pytest

from tideline.llm import jaccard_join as j


def grams(text):
    w = [x.encode() for x in text.encode().decode().lower().split()] if text.isascii() else text.lower().encode().split()
    n = min(5, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()


def brute(rows):
    sets = [grams(t or "") for _, t in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            links[a] += 1
            links[b] += 1
            up[root(a)] = root(b)
    least = {}
    for k, (d, _) in enumerate(rows):
        key = (d is None, d or 0)
        least[root(k)] = min(least.get(root(k), key), key)
    return sorted((str(d), "None" if least[root(k)][0] else str(least[root(k)][1]), links[k]) for k, (d, _) in enumerate(rows))


def found(df):
    return sorted((str(r.doc_id), str(r.class_id), r.n_links) for r in j.jaccard_join(df).collect())


def test_matches_brute_force(docs, odd, none):
    for df in (docs, odd, none):
        assert found(df) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_large_buckets_in_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(j, "BLOCK_DOCS", 7)
    base = [f"w{k}" for k in range(120)]
    rows = [(k, " ".join([*base[: 40 + k % 30], *(f"x{k}" for _ in range(k % 3)), *base[40 + k % 30 :]])) for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)


def test_one_of_each_class_stays(odd):
    left = j.one_of_each_class(odd)
    assert left.columns == odd.columns
    assert sorted({str(r.doc_id) for r in left.collect()}) == sorted(["1", "3", "4", "None", "5", "7", "8", "9"])


@pytest.mark.parametrize("similarity", [0.5, 0.8, 0.95])
def test_bands_reach_the_recall(similarity):
    bands, rows = j.choose_bands(similarity, 0.999, 256)
    assert 1 - (1 - similarity**rows) ** bands >= 0.999 and bands * rows <= 256
