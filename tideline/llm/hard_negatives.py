"""Hard negatives: length buckets with sorted coordinate lists, searched by the ranges that an anchor's focus coordinates allow."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import Scratch

POSITIVES, NEGATIVES = 5, 3
LOWEST, HIGHEST = 50, 95  # per cent of a positive's score within which a negative is hard
ROWS, ANCHORS = 4096, 4096  # of a bucket and of the anchors that meet it in one task
FOCUS = 5
SLICE = 256
SLACK = 1e-9
EXACT = 2.0**53  # sums of products below this are exact in doubles
ANCHOR = "a_rid long, a_id long, a_label long, a_v array<double>, a_norm double"
POSITIVE = "a_rid long, rid long, vec_id long, score long"
NEGATIVE = "a_rid long, j int, anchor_id long, positive_id long, positive_score long, rid long, negative_id long, negative_score long"


def whole_components(vector: Column) -> Column:
    """floor(256 x) of each component as a double, which holds every such integer."""
    def one(x: Column) -> Column:
        y = F.lit(256.0) * x.cast("double")
        return F.when(F.abs(y) < F.lit(2.0**52), F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, one)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, v) of the rows that take part; labels of ids that 7 divides move on by one."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == F.lit(math.inf)))
    held = vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    id_, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    return held.select(id_.alias("vec_id"), F.when(id_ % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), whole_components(F.col("embedding")).alias("v"))


def buckets(vectors: DataFrame, scratch: Scratch, rows: int) -> DataFrame:
    """usable() rows with rid and norm, dealt by descending length into buckets of about `rows` rows; shorter vectors are filled with zeros."""
    held = scratch.table(usable(vectors).withColumn("rid", F.monotonically_increasing_id()), "usable")
    count, size = held.agg(F.count("*"), F.max(F.size("v"))).first()
    filled = F.concat("v", F.array_repeat(F.lit(0.0), F.lit(size or 0) - F.size("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    dealt = held.select("rid", "vec_id", "label", filled.alias("v"), norm.alias("norm")).repartitionByRange(max(1, -(-count // rows)), F.desc("norm"), "rid")
    return scratch.table(dealt.withColumn("bucket", F.spark_partition_id()), "buckets")


class Bucket:
    """Rows of about one length: directions, lengths, and per coordinate the rows in its order."""

    def __init__(self, table: pa.Table):
        vectors = table["v"].combine_chunks()
        self.whole = vectors.values.to_numpy(zero_copy_only=False).reshape(table.num_rows, -1) if len(vectors.values) else np.zeros((table.num_rows, 1))
        norms = table["norm"].to_numpy()
        order = np.argsort(-norms, kind="stable")
        self.whole, self.norms = self.whole[order], norms[order]
        take = table.take(pa.array(order))
        self.rid, self.label = take["rid"].to_numpy(), take["label"].to_numpy()
        self.none = take["vec_id"].is_null().to_numpy()
        self.vec_id = take["vec_id"].fill_null(np.iinfo(np.int64).max).to_numpy()
        with np.errstate(divide="ignore", invalid="ignore"):
            self.ways = np.nan_to_num(self.whole / self.norms[:, None])
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def coordinate(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        """(rows, values) in the order of one coordinate."""
        if f not in self.lists:
            order = np.argsort(self.ways[:, f], kind="stable")
            self.lists[f] = order, self.ways[order, f]
        return self.lists[f]

    def scores(self, rows: np.ndarray | slice, anchor: np.ndarray, norm: float) -> np.ndarray:
        """Exact inner products; beyond what doubles hold, in Python's integers."""
        if not len(self.norms) or norm * self.norms[0] < EXACT:
            return (self.whole[rows] @ anchor).astype(np.int64)
        wide = [int(x) for x in anchor]
        return np.array([sum(int(x) * y for x, y in zip(row, wide, strict=True)) for row in self.whole[rows]], object)


def feasible(q: np.ndarray, t: float, f: int) -> tuple[float, float]:
    """The values of coordinate f that a direction may have whose inner product with direction q is t or more."""
    spread = math.sqrt(max(0.0, (1 - q[f] ** 2) * (1 - t * t)))
    low, high = q[f] * t - spread, q[f] * t + spread
    return (-1.0 if q[f] <= -t else low) - SLACK, (1.0 if q[f] >= t else high) + SLACK


def candidates(bucket: Bucket, anchor: np.ndarray, norm: float, bound: float) -> np.ndarray | slice:
    """Rows that may reach the bound: a prefix by length, and the intersection of the focus coordinates' ranges if that narrows it."""
    if bound <= 0 or not norm:
        return slice(0, len(bucket.norms) if bound <= 0 else 0)
    reach = int(np.searchsorted(-bucket.norms, -bound / norm * (1 - SLACK), "right"))
    if not reach:
        return slice(0, 0)
    t = min(1.0, bound / (norm * bucket.norms[0]) * (1 - SLACK))
    q = anchor / norm
    focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS].tolist()
    ranges = []
    for f in focus:
        low, high = feasible(q, t, f)
        _, values = bucket.coordinate(f)
        ranges.append((*np.searchsorted(values, [low, np.nextafter(high, np.inf)]), f, low, high))
    first, last, best, *_ = min(ranges, key=lambda r: r[1] - r[0])
    if 2 * (last - first) > reach:
        return slice(0, reach)  # no coordinate narrows the bucket enough to gather rows one by one
    found = bucket.coordinate(best)[0][first:last]
    found = found[found < reach]
    for _, _, f, low, high in ranges:
        if f != best:
            values = bucket.ways[found, f]
            found = found[(values >= low) & (values <= high)]
    return found


def verified(bucket: Bucket, anchors: np.ndarray, norms: np.ndarray, bounds: list[float]) -> Iterator[tuple[int, np.ndarray | slice, np.ndarray]]:
    """(anchor, candidate rows, their exact scores); anchors with the same whole prefix share one product, in slices."""
    whole: list[tuple[int, slice]] = []
    for i, bound in enumerate(bounds):
        rows = candidates(bucket, anchors[i], norms[i], bound)
        if isinstance(rows, slice) and norms[i] * bucket.norms[0] < EXACT:
            if rows.stop:
                whole.append((i, rows))
        elif isinstance(rows, slice) or len(rows):
            yield i, rows, bucket.scores(rows, anchors[i], norms[i])
    for k in range(0, len(whole), SLICE):
        part = whole[k : k + SLICE]
        reach = max(rows.stop for _, rows in part)
        products = anchors[[i for i, _ in part]] @ bucket.whole[:reach].T
        for (i, rows), line in zip(part, products, strict=True):
            yield i, rows, line[rows].astype(np.int64)


def best_first(bucket: Bucket, rows: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """Order by descending score, then id (none last), then row."""
    return np.array(sorted(range(len(rows)), key=lambda k: (-scores[k], bucket.none[rows[k]], bucket.vec_id[rows[k]], bucket.rid[rows[k]])), int) if scores.dtype == object else np.lexsort((bucket.rid[rows], bucket.vec_id[rows], bucket.none[rows], -scores))


def of_anchors(left: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    values = left["a_v"].combine_chunks().values
    return (values.to_numpy(zero_copy_only=False).reshape(left.num_rows, -1) if len(values) else np.zeros((left.num_rows, 1))), left["a_norm"].to_numpy()


def table_of(columns: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.Table:
    held = list(zip(*rows, strict=True)) if rows else [()] * len(columns)
    return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(held, columns, strict=True)], [n for n, _ in columns])


def id_of(bucket: Bucket, row: int) -> int | None:
    return None if bucket.none[row] else int(bucket.vec_id[row])


def positives_in(left: pa.Table, right: pa.Table) -> pa.Table:
    """Each anchor's best rows of its own label in one bucket, from its bound on."""
    columns, out = [(c, pa.int64()) for c in ("a_rid", "rid", "vec_id", "score")], []
    if left.num_rows and right.num_rows:
        bucket, (anchors, norms) = Bucket(right), of_anchors(left)
        rids, labels = left["a_rid"].to_numpy(), left["a_label"].to_numpy()
        bounds = [-math.inf if b is None else b for b in left["bound"].to_pylist()]
        for i, rows, scores in verified(bucket, anchors, norms, bounds):
            rows = np.arange(rows.stop) if isinstance(rows, slice) else rows
            keep = (bucket.label[rows] == labels[i]) & (bucket.rid[rows] != rids[i]) & (scores >= bounds[i])
            rows, scores = rows[keep], scores[keep]
            if len(rows) > POSITIVES and scores.dtype != object:
                keep = scores >= np.partition(scores, -POSITIVES)[-POSITIVES]
                rows, scores = rows[keep], scores[keep]
            for k in best_first(bucket, rows, scores)[:POSITIVES]:
                out.append((int(rids[i]), int(bucket.rid[rows[k]]), id_of(bucket, rows[k]), int(scores[k])))
    return table_of(columns, out)


def negatives_in(left: pa.Table, right: pa.Table) -> pa.Table:
    """For each anchor and positive the best rows of other labels in one bucket, within the band, from its bound on."""
    columns = [("a_rid", pa.int64()), ("j", pa.int32()), *((c, pa.int64()) for c in ("anchor_id", "positive_id", "positive_score", "rid", "negative_id", "negative_score"))]
    out = []
    if left.num_rows and right.num_rows:
        bucket, (anchors, norms) = Bucket(right), of_anchors(left)
        rids, ids, labels = left["a_rid"].to_numpy(), left["a_id"].to_pylist(), left["a_label"].to_numpy()
        bands = [[(j, p["vec_id"], p["score"], max(-(-LOWEST * p["score"] // 100), least if least is not None else -(2**63)), HIGHEST * p["score"] // 100) for j, (p, least) in enumerate(zip(*x, strict=True))] for x in zip(left["positives"].to_pylist(), left["bounds"].to_pylist(), strict=True)]
        bands = [[b for b in x if b[3] <= b[4]] for x in bands]
        bounds = [min((b[3] for b in x), default=math.inf) for x in bands]
        for i, rows, scores in verified(bucket, anchors, norms, bounds):
            rows = np.arange(rows.stop) if isinstance(rows, slice) else rows
            keep = (bucket.label[rows] != labels[i]) & (scores >= bounds[i]) & (scores <= max((b[4] for b in bands[i]), default=0))
            rows, scores = rows[keep], scores[keep]
            order = best_first(bucket, rows, scores)
            rows, falling = rows[order], -scores[order]
            for j, positive, score, low, high in bands[i]:
                first, last = np.searchsorted(falling, -high), np.searchsorted(falling, -low, "right")
                for k in range(first, min(last, first + NEGATIVES)):
                    out.append((int(rids[i]), j, ids[i], positive, score, int(bucket.rid[rows[k]]), id_of(bucket, rows[k]), -int(falling[k])))
    return table_of(columns, out)


def meet(anchors: DataFrame, bucketed: DataFrame, longest: DataFrame, bound: Column, search, schema: str, parts: int, pilot: bool) -> DataFrame:
    """search over every bucket whose length lets an anchor reach its bound; pilot: over the longest bucket only, or all others.

    anchors: ANCHOR and what search reads. Anchors and buckets meet in groups of bounded size, one task a pair of blocks.
    """
    reach = F.col("to.norm") * F.col("a_norm") * (1 + SLACK) >= F.coalesce(bound.cast("double"), F.lit(-math.inf))
    own = (F.col("to.k") == 0) if pilot else (F.col("to.k") > 0)
    part = F.pmod(F.xxhash64("a_rid"), F.lit(parts)).cast("int").alias("part")  # of the type it has on the other side, or equal keys are dealt to different tasks
    sent = anchors.withColumn("one", F.lit(1)).join(F.broadcast(longest), "one").withColumn("to", F.explode("buckets"))  # one row: two numbers a bucket
    sent = sent.where(own & reach).select("*", part, F.col("to.bucket").alias("bucket")).drop("one", "buckets", "to")
    rows = bucketed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return sent.groupBy("part", "bucket").cogroup(rows.groupBy("part", "bucket")).applyInArrow(search, schema)


def hard_negatives(vectors: DataFrame, every: int = 50, rows: int = ROWS, anchor_rows: int = ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the hardest rows of other labels.

    Rows without label or vector, or with a null or non-finite component, take no part. Anchors are the rows whose id
    `every` divides; scores are inner products of floor(256 x). Positives are an anchor's first five other rows of its
    label, negatives the first three rows of other labels between 50 and 95 per cent of the positive's score (none if
    that is negative). Order is by score, then id. A null id is no anchor and comes last among ties; repeated rows are
    rows of their own; shorter vectors count as filled with zeros, an empty one as zero; scores must fit a long. An empty table gives an
    empty result. Other columns are not read.

    Rows are dealt by descending length into buckets, hot lengths and copies over several. The longest bucket gives each
    anchor a bound; then only buckets that are long enough are sent, and in them only rows in the intersection of the
    feasible ranges of the anchor's five greatest coordinates are verified, or the whole prefix by length where no range
    narrows it. The anchors are a stated query set; all rows are searched, none is sampled.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "hard-negatives")
    bucketed = buckets(vectors, scratch, rows)
    tops = bucketed.groupBy("bucket").agg(F.max("norm").alias("norm"))
    longest = tops.groupBy(F.lit(1).alias("one")).agg(F.array_sort(F.collect_list(F.struct("bucket", "norm"))).alias("buckets"))
    longest = scratch.table(longest.select("one", F.transform("buckets", lambda x, k: F.struct(k.alias("k"), x.bucket.alias("bucket"), x.norm.alias("norm"))).alias("buckets")), "longest")
    anchors = bucketed.where(F.col("vec_id") % every == 0).select(*(F.col(c).alias(f"a_{n}") for c, n in zip(["rid", "vec_id", "label", "v", "norm"], ["rid", "id", "label", "v", "norm"], strict=True)))
    anchors = scratch.table(anchors, "anchors")
    parts = max(1, -(-anchors.count() // anchor_rows))
    order = lambda score, id_: [F.desc(score), F.col(id_).isNull(), id_, "rid"]

    def both(held: DataFrame, bound: Column, search, schema: str, raised, name: str) -> DataFrame:
        """The longest bucket's results, and with the bounds that they give all others'."""
        pilot = scratch.table(meet(held, bucketed, longest, bound, search, schema, parts, True), f"{name}-pilot")
        again, bound = raised(held, pilot)
        again = scratch.table(again, f"{name}-bounds")
        return pilot.union(meet(again, bucketed, longest, bound, search, schema, parts, False))

    def fifth(held: DataFrame, pilot: DataFrame) -> tuple[DataFrame, Column]:
        found = pilot.groupBy("a_rid").agg(F.when(F.count("*") >= POSITIVES, F.min("score")).alias("bound"))
        return held.drop("bound").join(found, "a_rid", "left"), F.col("bound")

    def third(held: DataFrame, pilot: DataFrame) -> tuple[DataFrame, Column]:
        found = pilot.groupBy("a_rid", "j").agg(F.when(F.count("*") >= NEGATIVES, F.min("negative_score")).alias("bound"))
        found = found.groupBy("a_rid").agg(F.map_from_entries(F.collect_list(F.struct("j", "bound"))).alias("raised"))
        bounds = F.transform("bounds", lambda x, j: F.coalesce(F.try_element_at("raised", j), x))
        return held.join(found, "a_rid", "left").withColumn("bounds", bounds).drop("raised"), least_bound

    first = anchors.withColumn("bound", F.lit(None).cast("long"))
    near = both(first, F.col("bound"), positives_in, POSITIVE, fifth, "positives")
    rank = Window.partitionBy("a_rid").orderBy(*order("score", "vec_id"))
    near = near.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= POSITIVES)
    near = near.groupBy("a_rid").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "score"))).alias("positives"))
    held = scratch.table(anchors.join(near, "a_rid").withColumn("bounds", F.transform("positives", lambda _: F.lit(None).cast("long"))), "held")
    # A band begins at half of the positive's score; a bound that was raised is above that.
    half = F.transform(F.arrays_zip("positives", "bounds"), lambda x: F.greatest(F.coalesce(x.bounds.cast("double"), x.positives.score * (LOWEST / 100)), x.positives.score * (LOWEST / 100)))
    least_bound = F.array_min(F.filter(half, lambda x: x >= 0))
    far = both(held.where(least_bound.isNotNull()), least_bound, negatives_in, NEGATIVE, third, "negatives")
    rank = Window.partitionBy("a_rid", "j").orderBy(*order("negative_score", "negative_id"))
    far = far.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= NEGATIVES)
    return far.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


SQL = r"""
WITH r AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
    SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
    FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
n AS (
    SELECT anchor_id, positive_id, other_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS k
    FROM p JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
)
SELECT anchor_id, positive_id, CAST(k AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE k <= 3
"""
