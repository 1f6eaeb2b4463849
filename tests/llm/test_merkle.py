import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import Row

from tideline.llm.merkle import SQL, manifest, op13_merkle_manifest

NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    return h(*("-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in ("doc_id", "source", "lang", "n_chars", "text")))


def tree(digests):
    """(root, per digest: its place in each level's run and that run)."""
    paths, level, at = [[] for _ in digests], list(digests), list(range(len(digests)))
    while len(level) > 1:
        runs = [level[k : k + 3] for k in range(0, len(level), 3)]
        for path, k in zip(paths, at, strict=True):
            path.append((k % 3, runs[k // 3]))
        level, at = [h(*run) for run in runs], [k // 3 for k in at]
    return level[0], paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append((leaf_of(row), row))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for held in groups.values():
        held.sort(key=lambda x: (x[1]["doc_id"] is not None, x[1]["doc_id"] or 0, x[0]))
    trees = {s: tree([d for d, _ in groups[s]]) for s in order}
    root, over = tree([trees[s][0] for s in order])
    found = []
    for source, above in zip(order, over, strict=True):
        subroot, paths = trees[source]
        for (leaf, row), path in zip(groups[source], paths, strict=True):
            v = leaf
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0 and row["text"] is not None:
                v = leaf_of(row | {"text": row["text"].replace("\n", "")})
            proof = ""
            for k, run in path + above:
                proof += "".join(run[:k] + run[k + 1 :])
                v = h(*run[:k], v, *run[k + 1 :])
            found.append((row["doc_id"], leaf, subroot, root, h(proof), v, v == root))
    return sorted(found, key=str)


def got(df):
    assert df.columns == NAMES
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("levels", [1, 2, 6])
def test_matches_brute_force(docs, odd, levels):
    for df in (docs, odd) if levels == 2 else (odd,):
        assert got(manifest(df, levels=levels)) == brute([r.asDict() for r in df.select("doc_id", "source", "lang", "n_chars", "text").collect()])


def test_every_number_of_leaves(spark):
    """Runs that end short at any level, groups of one, and no group but one."""
    rows = [Row(doc_id=100 * n + k, source=f"s{n:02d}", lang=None, n_chars=k, text=f"a\n{k}") for n in (1, 2, 3, 4, 9, 10, 11, 27, 28, 40) for k in range(n)]
    for held in (rows, [r for r in rows if r.source == "s28"], rows[:1]):
        df = spark.createDataFrame(held, "doc_id long, source string, lang string, n_chars long, text string")
        for levels in (1, 2):
            assert got(manifest(df, levels=levels)) == brute([r.asDict() for r in held])


def test_null_groups_come_first_and_bytes_decide(spark):
    rows = [(1, None, "x\ny"), (2, "", "x\ny"), (3, "Z", ""), (4, "a", None), (5, "é", "é\n"), (6, "😀", "b"), (7, "￿", "c")]
    df = spark.createDataFrame([(k, s, "en", 1, t) for k, s, t in rows], "doc_id long, source string, lang string, n_chars long, text string")
    assert got(manifest(df)) == brute([r.asDict() for r in df.collect()])


def test_empty_table(none):
    assert got(manifest(none)) == []


def test_only_tampered_rows_with_line_feeds_fail(spark, small, texts):
    for r in op13_merkle_manifest(spark, small).collect():
        assert r.verified == (zlib.crc32(str(r.doc_id).encode()) % 2 == 1 or "\n" not in texts[r.doc_id])


def test_matches_sql(spark, small):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
        assert sorted(con.execute(SQL).fetchall(), key=str) == got(op13_merkle_manifest(spark, small))
