from itertools import combinations

import pytest
from pyspark.sql import functions as F

from tideline.llm.line_dedup import line_dedup, without_lines

ASCII = str.maketrans({c: " " for c in "\t\x0b\x0c\r"})


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    lines = []
    for row, (doc, text) in enumerate(rows):
        for k, line in enumerate((text or "").lower().translate(ASCII).split("\n")):
            w = [x for x in line.split(" ") if x]
            if w:
                lines.append(((doc is None, doc or 0, row, k), tuple(w)))
    distinct = sorted({w for _, w in lines})
    up = {w: w for w in distinct}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(distinct, 2):
        if min(len(a), len(b)) >= 5 and abs(len(a) - len(b)) <= 1 and (a[:2] == b[:2] or a[-2:] == b[-2:]) and within_one(a, b):
            up[root(a)] = root(b)
    least = {}
    for at, w in lines:
        least[root(w)] = min(least.get(root(w), at), at)
    dropped = [[] for _ in rows]
    for at, w in lines:
        if at != least[root(w)]:
            dropped[at[2]].append(at[3])
    return sorted((str(d), len((t or "").split("\n")) if t else 0, x) for (d, t), x in zip(rows, dropped))


def found(df):
    return sorted((str(r.doc_id), r.n_lines, list(r.dropped)) for r in line_dedup(df).collect())


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_matches_brute_force(request, name):
    df = request.getfixturevalue(name)
    assert found(df) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


@pytest.mark.parametrize("size", [12, 16, 40])
def test_edits(spark, size):
    base = [f"w{k}" for k in range(size)]
    variants = [base, base[1:], base[:-1], base[:5] + base[6:], [*base[:3], "new", *base[3:]], [*base[:7], "other", *base[8:]], ["x", *base[1:]], base[::-1], [*base[:2], "a", "b", *base[2:]], base[:4]]
    rows = [(k, "Intro\n" + " ".join(v) + "\n") for k, v in enumerate(variants)]
    rows += [(100 + k, f"page {k} of the long report here") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = line_dedup(df).collect()
    assert sorted((str(r.doc_id), r.n_lines, list(r.dropped)) for r in got) == brute(rows)
    cleaned = {r.doc_id: r.t for r in df.join(spark.createDataFrame(got, "doc_id long, n_lines long, dropped array<int>"), "doc_id").select("doc_id", without_lines(F.col("text"), F.col("dropped")).alias("t")).collect()}
    assert cleaned[1] == "" and cleaned[0] == rows[0][1] and cleaned[101] == ""


def test_equal_lines_of_any_length(spark, small, tmp_path):
    """The query drops every equal line that is not blank, however short; one edit counts from five words on."""
    from tideline.llm.line_dedup import op7_line_dedup

    rows = [(1, "All rights reserved.\nles.\n\n \nshort line here\none two three four five\none two three four"), (2, "all  rights RESERVED.\n\nles.\nshort line there\none two three four"), (3, "les.\nles.\none two three four six\n第一行没有空格\n第一行没有空格"), (None, "les."), (4, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.dropped) for r in op7_line_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (7, 0, ""), 2: (5, 3, "0,2,4"), 3: (5, 4, "0,1,2,4"), None: (1, 1, "0"), 4: (0, 0, "")}


def test_query_drops_every_equal_line(spark, small):
    from tideline.llm.line_dedup import op7_line_dedup

    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    dropped = {r.doc_id: set(filter(None, r.dropped.split(","))) for r in op7_line_dedup(spark, small).collect()}
    seen = set()
    for r in docs:
        for k, line in enumerate((r.text or "").lower().translate(ASCII).split("\n")):
            words = tuple(x for x in line.split(" ") if x)
            assert not words or str(k) in dropped[r.doc_id] or words not in seen
            assert 0 == len(words) or len(words) >= 5 or (str(k) in dropped[r.doc_id]) == (words in seen)
            seen.add(words)


def test_texts_are_hashed_together(monkeypatch):
    """The calls that hash a batch do not grow with its texts and lines, and a text's lines do not depend on its neighbours."""
    import pyarrow as pa

    from tideline.llm import line_dedup as module

    texts = ["", "\n\n a b c d e f\n", "ΟΔΟΣ", "\n", "no end", *(f"one line of {k} words here\nand another\n" + " ".join(f"w{k + j}" for j in range(20 + k % 3)) for k in range(200)), "", "é ▁ \x00 x\ty\n"]

    def found(texts):
        batch = pa.RecordBatch.from_arrays([*(pa.array(range(len(texts)), pa.int64()) for _ in range(3)), pa.array(texts, pa.string())], ["rid", "doc_id", "key", "text"])
        return pa.Table.from_batches(module.hashed_lines([batch], 5, 16)).to_pylist()

    calls = []
    mixed = module.mixed
    monkeypatch.setattr(module, "mixed", lambda x: calls.append(1) or mixed(x))
    together = found(texts)
    assert len(calls) < 30
    alone = [found([t])[0] for t in texts]
    assert [(r["n_lines"], r["items"]) for r in together] == [(r["n_lines"], r["items"]) for r in alone]
    as_set = lambda rows: {(x["d1"], x["words"], x["start"], tuple(x["variants"])) for r in rows for x in r["near"]}
    assert as_set(together) == as_set(alone)
    monkeypatch.setattr(module, "BLOCK", 300)
    assert [(r["n_lines"], r["items"]) for r in found(texts)] == [(r["n_lines"], r["items"]) for r in alone]
