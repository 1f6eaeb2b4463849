import math
import random

import duckdb
import numpy as np
import pytest

from tideline.llm.hard_negatives import SQL, feasible, hard_negatives, op11_hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, rid string, norm string"


def brute(rows, every=50):
    held = []
    for k, (id_, v, label) in enumerate(rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((k, id_, [math.floor(256 * float(x)) for x in v], (label + 1) % 10 if id_ is not None and id_ % 7 == 0 else label))
    out = []
    for k, id_, v, label in held:
        if id_ is None or id_ % every:
            continue
        ranked = sorted(((-sum(x * y for x, y in zip(v, w)), other is None, other or 0, r, other, own) for r, other, w, own in held if r != k), key=lambda x: x[:4])  # noqa: B905
        for p in [x for x in ranked if x[5] == label][:5]:
            band = [x for x in ranked if x[5] != label and 50 * -p[0] <= 100 * -x[0] <= 95 * -p[0]]
            out += [(id_, p[4], j, n[4], -p[0], -n[0]) for j, n in enumerate(band[:3], 1)]
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def rows_of(df):
    return [(r.vec_id, r.embedding, r.label) for r in df.select("vec_id", "embedding", "label").collect()]


@pytest.fixture(scope="module")
def odd_vectors(spark):
    """Missing labels, vectors and components, other lengths, zeros, ties, repeats, a hot vector and one group of long vectors."""
    rng = random.Random(3)
    near = lambda spread: [1.0 + spread * rng.random(), 0.5 + spread * rng.random(), spread * rng.random(), -spread * rng.random()]
    rows = [(k, near(1.5), rng.randrange(4)) for k in range(-60, 140)] + [(k, [1.0, 0.5, 0.25, 0.0], k % 3) for k in range(200, 320)]
    rows += [(k, [x * 9 for x in near(0.5)], 2) for k in range(400, 460)] + [(450, near(0.1), 2)] * 2
    rows += [(500, None, 1), (501, [1.0, None, 1.0, 1.0], 1), (502, [math.nan, 1.0, 1.0, 1.0], 1), (503, [math.inf, 1.0, 1.0, 1.0], 1), (550, near(1), None), (600, [], 1), (601, [2.0], 1), (602, [2.0, 1.0], 3), (650, [0.0] * 4, 1), (None, near(1), 1), (None, near(1), 3), (700, [-1.0, -0.5, 0.0, 0.0], 1)]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


@pytest.mark.parametrize(("rows", "anchors"), [(4096, 4096), (40, 3)])
def test_matches_brute_force(odd_vectors, rows, anchors):
    assert got(hard_negatives(odd_vectors, rows=rows, anchor_rows=anchors)) == brute(rows_of(odd_vectors))


def test_both_sides_of_a_block_meet_in_one_of_many_partitions(spark, odd_vectors):
    conf = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        assert got(hard_negatives(odd_vectors, rows=40, anchor_rows=3)) == brute(rows_of(odd_vectors))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_scores_beyond_doubles_are_exact(spark):
    rows = [(50 * k, [float(2**22 + k), float(2**21 - k)], k % 2) for k in range(8)] + [(k + 1000, [float(2**21 + 3 * k), float(2**21 + k)], k % 2) for k in range(9)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA.replace("float", "double"))
    assert got(hard_negatives(df, rows=5, anchor_rows=2)) == brute(rows)


def test_empty_and_single_rows(spark):
    assert got(hard_negatives(spark.createDataFrame([], SCHEMA))) == []
    assert got(hard_negatives(spark.createDataFrame([(50, [1.0], 1, "x", "y")], SCHEMA))) == []


def test_ranges_hold_every_direction_within_the_bound():
    rng = np.random.default_rng(5)
    ways = rng.normal(size=(4000, 4))
    ways /= np.linalg.norm(ways, axis=1)[:, None]
    for q in ways[:40]:
        for t in (0.1, 0.6, 0.95, 1.0):
            for f in range(4):
                low, high = feasible(q, t, f)
                inside = ways[ways @ q >= t][:, f]
                assert (inside >= low).all() and (inside <= high).all()


def test_matches_sql(spark, small):
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{small}/embeddings.parquet'")
        assert sorted(con.execute(SQL).fetchall(), key=str) == got(op11_hard_negatives(spark, small)) == brute(rows_of(spark.read.parquet(f"{small}/embeddings.parquet")))
