import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tideline.llm import suffix_tree_lm as m
from tideline.llm.suffix_tree_lm import lm_scores, op9_suffix_tree_lm, pack, squeeze, unpack, unsqueeze


def words(text):
    return (text or "").translate({k: k + 32 for k in range(65, 91)}).encode().split()


def held(doc_id):
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def brute(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base, score) from a tree held in dictionaries."""
    texts = [(d, held(d), ["<start>", *words(t), "<end>"]) for d, t in rows]
    after = defaultdict(Counter)  # context, a tuple with the newest word last: what follows it
    for _, out, s in texts:
        for k in range(1, len(s)):
            for depth in range(min(k, 2) + 1):
                after[tuple(s[k - depth : k])][s[k]] += not out
    n = sum(after[()].values())
    v = sum(c > 0 for c in after[()].values())

    def p(context, word):
        if not context:
            return (after[()][word] + 1) / (n + v + 1)
        weight = (200, 2)[len(context) - 1]
        return (after[context][word] + weight * p(context[1:], word)) / (sum(after[context].values()) + weight)

    kept = {()}
    for context, seen in list(after.items()):
        whole = sum(seen.values())
        if context and whole >= 2:
            gain = sum(c * math.log(c / whole / p(context[1:], w)) - 0.5 * math.log(max(n, 2)) for w, c in seen.items() if c)
            if gain > 0:
                kept.add(context)
    out = []
    for d, o, s in texts:
        score = 0.0
        for k in range(1, len(s)):
            context = next(c for depth in (2, 1, 0) if depth <= k and (c := tuple(s[k - depth : k])) in kept)
            score += math.log10(p(context, s[k]))
        out.append((str(d), o, len(s) - 1, sum(after[()][w] > 0 for w in s[1:]), n, sum(math.log10(p((), w)) for w in s[1:]), score))
    return sorted(out)


def check(df):
    got = lm_scores(df).collect()
    have = sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got)
    want = brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert [x[:5] for x in have] == [x[:5] for x in want]
    assert np.allclose([x[5:] for x in have], [x[5:] for x in want], atol=1e-6)
    return got


@pytest.mark.parametrize("name", ["docs", "odd", "none"])
def test_scores_match_a_tree_in_dictionaries(request, name):
    check(request.getfixturevalue(name))


def test_many_small_chunks_and_parts_give_the_same(docs, monkeypatch):
    monkeypatch.setattr(m, "PART_KEYS", 5_000)
    monkeypatch.setattr(m, "CHUNK_BYTES", 3_000)
    check(docs)


def test_no_training_texts(spark):
    df = spark.createDataFrame([(d, "a b c") for d in range(200) if held(d)], "doc_id long, text string")
    assert {(r.base_score, r.score, r.n_known, r.train_tokens) for r in lm_scores(df).collect()} == {(0.0, 0.0, 0, 0)}


def test_held_out_texts_score_above_the_base_and_the_order_of_words_counts(spark, small):
    where = small.replace("sf0.001", "sf0.01")
    got = [r for r in op9_suffix_tree_lm(spark, where).collect() if r.held_out]
    tokens = sum(r.n_tokens for r in got)
    assert sum(r.score for r in got) / tokens > sum(r.base_score for r in got) / tokens + 0.2
    rows = [(k, "the old king sat on his throne and spoke to all") for k in range(40)]
    rows += [(1000, "the old king sat on his throne"), (1001, "throne his on sat king old the")]
    score = {r.doc_id: r.score for r in lm_scores(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert score[1000] > score[1001] + 3


def test_a_text_that_stands_twice_scores_apart(spark, small):
    where = small.replace("sf0.001", "sf0.01")
    docs = spark.read.parquet(f"{where}/documents.parquet").select("doc_id", "text")
    once = docs.dropDuplicates(["text"]).where("doc_id % 50 = 3").collect()
    once = [r for r in once if not held(r.doc_id) and len(words(r.text)) > 50][:8]
    again, k = [], 10**9
    for r in once:
        while held(k):
            k += 1
        again.append((k, r.text))
        k += 1
    alone = {r.doc_id: r.score / r.n_tokens for r in lm_scores(docs).collect()}
    both = {r.doc_id: r.score / r.n_tokens for r in lm_scores(docs.union(spark.createDataFrame(again, docs.schema))).collect()}
    assert len(again) > 2 and np.mean([both[r.doc_id] - alone[r.doc_id] for r in once]) > 0.5


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**56 - 1), max_size=50), st.lists(st.integers(0, 2**64 - 1), max_size=20))
def test_packed_numbers_come_back(keys, values):
    keys, values = np.array(sorted(keys), np.uint64), np.array(values, np.uint64)
    got, more = unpack(pack(keys, squeeze(values)))
    assert (got == keys).all() and (unsqueeze(more) == values).all()
