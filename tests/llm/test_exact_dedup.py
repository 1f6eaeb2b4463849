import hashlib

from pyspark.sql import functions as F

from tideline.llm.exact_dedup import drop_copies, exact_dedup


def plain(text):
    return (text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(plain(text), []).append((-len(text or ""), doc_id is None, doc_id or 0, doc_id))
    return sorted((str(d), str(min(groups[plain(t)])[3]), len(groups[plain(t)]), hashlib.sha256(plain(t).encode()).hexdigest()) for d, t in rows)


def found(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in df.collect())


def test_matches_brute_force(docs, odd, none):
    for df in (docs, odd):
        assert found(exact_dedup(df)) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    assert exact_dedup(none).count() == 0


def test_one_row_of_each_group_is_kept(odd):
    got = exact_dedup(odd)
    assert got.where("kept").count() == got.select("text_sha256").distinct().count()
    left = drop_copies(odd)
    assert left.columns == odd.columns and left.count() == got.where("kept").count()


def test_colliding_hashes_are_split_by_bytes(docs, odd):
    for df in (docs, odd):
        weak = lambda norm: F.unhex(F.substring(F.md5(norm), 1, 2))
        assert found(exact_dedup(df, hash_of=weak)) == found(exact_dedup(df))
