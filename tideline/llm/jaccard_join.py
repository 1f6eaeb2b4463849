"""Similarity join of texts on the Jaccard similarity of their word n-gram sets, by MinHash banding."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import HEAVY, Scratch, documents, heavy_join, kept, text_rows
from tideline.llm.components import connected_components

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.99999
MOST_HASHES = 128
BLOCK_DOCS = 512  # texts of a bucket that are compared at once with as many others
BLOCK_GRAMS = 2_000_000

BASE = np.uint64(0x9E3779B97F4A7C15)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def choose_bands(similarity: float = SIMILARITY, recall: float = RECALL, most: int = MOST_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which at most `most` hashes give 1 - (1 - s^rows)^bands >= recall."""
    for rows in range(most, 0, -1):
        miss = 1 - similarity**rows
        if miss < 1 and (bands := math.ceil(math.log(1 - recall) / math.log(miss))) * rows <= most:
            return max(1, bands), rows
    return most, 1


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * MIX[0]
    x = (x ^ (x >> np.uint64(27))) * MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^k and its inverse modulo 2^64, for k below n."""
    up = np.full(n, BASE, np.uint64)
    up[0] = 1
    down = np.full(n, np.uint64(pow(int(BASE), -1, 1 << 64)), np.uint64)
    down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


_power_table: list[tuple[np.ndarray, np.ndarray]] = []


def ngram_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word n-grams: lower-cased words between ASCII white space.

    A text of fewer words, but not none, has one gram of all of them.
    """
    data = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    if not len(data):
        return np.empty(0, np.uint64)
    if not _power_table or len(_power_table[0][0]) <= len(data):
        _power_table[:] = [_powers(max(1 << 16, 2 * len(data)))]
    up, down = _power_table[0]
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    hashes = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    n = min(words, len(hashes))
    grams = np.zeros(len(hashes) - n + 1, np.uint64)
    for k in range(n):
        grams = mixed(grams * BASE + hashes[k : k + len(grams)])
    return np.unique(grams)


class Signer:
    def __init__(self, bands: int, rows: int, seed: int = 20_240_131):
        self.bands, self.rows = bands, rows
        rng = np.random.default_rng(seed)
        self.a = rng.integers(0, 1 << 63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, np.uint64)

    def band_hashes(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, np.uint64)
        for k in range(0, len(grams), 4096):
            part = grams[k : k + 4096, None] * self.a + self.b
            part ^= part >> np.uint64(32)
            part *= MIX[0]
            np.minimum(least, part.min(axis=0), out=least)
        out = np.arange(self.bands, dtype=np.uint64)
        for column in least.reshape(self.bands, self.rows).T:
            out = mixed(out * BASE + column)
        return out


def signatures(docs: DataFrame, bands: int, rows: int, words: int = WORDS) -> DataFrame:
    """doc_id, key (of the text), n (grams), d1, d2 (128-bit digest of the gram set), bands."""
    signer = Signer(bands, rows)

    def sign(batches: Iterator[pa.RecordBatch]):
        kept("jaccard-join")
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                n, d1, d2, signed = [], [], [], []
                for text in part.column(2).to_pylist():
                    grams = ngram_set(text, words)
                    n.append(len(grams))
                    d1.append(int(mixed(grams).sum(dtype=np.uint64).view(np.int64)))
                    d2.append(int(mixed(grams ^ BASE).sum(dtype=np.uint64).view(np.int64)))
                    signed.append(signer.band_hashes(grams).view(np.int64) if len(grams) else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int32()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(signed, pa.list_(pa.int64()))], ["doc_id", "key", "n", "d1", "d2", "bands"])

    keyed = text_rows(docs).select("doc_id", F.xxhash64("text").alias("key"), "text")
    return keyed.mapInArrow(sign, "doc_id long, key long, n int, d1 long, d2 long, bands array<long>")


def first_shared(sig: np.ndarray, band: int, rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Which pairs (row, other) share no band before this one: so each pair is compared in one bucket only."""
    apart = np.ones((len(rows), len(others)), bool)
    for k in range(band):
        apart &= sig[rows, k][:, None] != sig[others, k][None, :]
    return apart


def assigned(sig: np.ndarray, size: np.ndarray, block: np.ndarray, band: int, i: int, j: int, similarity: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(left, right, which pairs) of a block pair: those to compare here, whose sizes allow the similarity."""
    left = np.arange(len(size)) if i == j else np.flatnonzero(block == i)
    right = left if i == j else np.flatnonzero(block == j)
    pairs = first_shared(sig, band, left, right)
    a, b = size[left][:, None], size[right][None, :]
    pairs &= np.minimum(a, b) >= similarity * np.maximum(a, b) - 1e-9
    if i == j:
        pairs &= left[:, None] < right[None, :]
    return left, right, pairs


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows, starts of the groups in them) of batches sorted by the keys; a group is never torn."""
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for k in keys:
            values = table.column(k).to_numpy()
            new[1:] |= values[1:] != values[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        at = starts(table)
        if len(at) > 1:
            yield table.slice(0, int(at[-1])), at[:-1]
            held = table.slice(int(at[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held)
        yield table, starts(table)


def verified(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, pairs: np.ndarray, similarity: float) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows that it is similar to) on the full gram sets, row by row of `left`."""
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int64)
    ends = np.cumsum([0, *map(len, sets)])
    mark = np.zeros(codes.max(initial=0) + 1, np.int32)
    sizes = np.diff(ends)
    for at, row in enumerate(left):
        others = right[pairs[at]]
        if not len(others):
            continue
        own = codes[ends[row] : ends[row + 1]]
        mark[own] = 1
        both = np.add.reduceat(mark[np.concatenate([codes[ends[o] : ends[o + 1]] for o in others])], np.cumsum(np.concatenate([[0], sizes[others][:-1]])))
        mark[own] = 0
        hit = both >= similarity * (sizes[row] + sizes[others] - both) - 1e-9
        if hit.any():
            yield int(row), others[hit]


class Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = x = self.up[self.up[x]]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
        return a != b


def jaccard_join(docs: DataFrame, words: int = WORDS, similarity: float = SIMILARITY, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, key (hash of its text), class_id, class_key, n_links, class_size, n_grams.

    A link joins two documents whose sets of word n-grams have at least the given Jaccard similarity; n_links counts a
    document's links, those to its own copies included. A class is a connected component of links; class_id is its
    least doc_id (class_key tells apart rows that share that id). Null and empty texts have no grams and no links, and
    each is its own class; a null doc_id comes after all others; repeated rows are copies of each other.

    Copies (equal gram sets) are one text with a count and are never expanded. The texts of a band bucket are compared
    in pairs of blocks of at most BLOCK_DOCS texts and BLOCK_GRAMS grams, so that no task holds more, whatever the
    bucket's size; a pair is compared only in the first band that it shares. A block pair leaves as one row a text (how
    many links) and the edges of a spanning forest, never as its pairs. `recall` is that of banding at the threshold.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "jaccard-join")
    bands, rows = choose_bands(similarity, recall)
    signed = scratch.table(signatures(docs, bands, rows, words), "signed")
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    texts = scratch.table(signed.where("n > 0").groupBy("d1", "d2").agg(F.count("*").alias("copies"), F.min(rank).alias("rep"), F.first("n").alias("n"), F.first("bands").alias("bands")), "texts")

    slots = texts.select("d1", "d2", F.posexplode("bands").alias("band", "bucket"))
    counts = texts.select("n", F.posexplode("bands").alias("band", "bucket")).groupBy("band", "bucket").agg(F.count("*").alias("m"), F.sum("n").alias("grams")).where("m > 1")
    crowded = scratch.table(counts.withColumn("blocks", F.greatest(F.ceil(F.col("m") / BLOCK_DOCS), F.ceil(F.col("grams") / BLOCK_GRAMS)).cast("int")).drop("grams"), "buckets")
    # Buckets with more than 1/HEAVY of all slots are fewer than HEAVY: they are broadcast, so that none is one task's alone.
    least = bands * texts.count() // HEAVY
    heavy, light = (F.broadcast(crowded.where(F.col("m") > least).drop("m")), crowded.where(F.col("m") <= least).drop("m"))
    crowded_slots = slots.join(heavy, ["band", "bucket"]).unionByName(slots.join(heavy, ["band", "bucket"], "left_anti").join(light, ["band", "bucket"]))
    members = crowded_slots.join(texts.select("d1", "d2", "n", "bands"), ["d1", "d2"])
    members = members.withColumn("block", F.pmod(F.xxhash64("d1", "d2"), F.col("blocks")).cast("int"))
    dealt = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("band", "bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "d1", "d2", "n", "bands")
    at = ["band", "bucket", "i", "j"]

    def groups(table, starts):
        """(first row, end, signatures, what to compare) of each block pair."""
        sig = table.column("bands").combine_chunks().flatten().to_numpy().reshape(len(table), bands)
        size, block = table.column("n").to_numpy().astype(float), table.column("block").to_numpy()
        band, i, j = (table.column(c).to_numpy() for c in ("band", "i", "j"))
        for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(table)]):
            yield a, b, assigned(sig[a:b], size[a:b], block[a:b], int(band[a]), int(i[a]), int(j[a]), similarity)

    def needed(batches):
        kept("jaccard-join")
        for table, starts in whole_groups(batches, at):
            keep = np.zeros(len(table), bool)
            for a, _, (left, right, pairs) in groups(table, starts):
                keep[a + left[pairs.any(axis=1)]] = True
                keep[a + right[pairs.any(axis=0)]] = True
            yield from table.filter(pa.array(keep)).to_batches()

    wanted = scratch.table(dealt.repartition(*at).sortWithinPartitions(*at).mapInArrow(needed, dealt.schema), "wanted")

    # Each text that is compared somewhere is fetched once, by its first document.
    compared = wanted.select("d1", "d2").distinct().join(texts, ["d1", "d2"]).select("d1", "d2", "copies", F.col("rep.doc_id").alias("doc_id"), F.col("rep.key").alias("key"))
    held = text_rows(docs).withColumn("key", F.xxhash64("text"))
    same = F.col("held.doc_id").eqNullSafe(F.col("compared.doc_id")) & (F.col("held.key") == F.col("compared.key"))
    fetched = held.alias("held").join(compared.alias("compared"), same).select("compared.d1", "compared.d2", "compared.copies", "held.text")

    def compare(batches):
        kept("jaccard-join")
        known: dict[tuple[int, int], np.ndarray] = {}  # gram sets of this batch's texts; a text can be in several buckets
        for table, starts in whole_groups(batches, at):
            d1, d2 = table.column("d1").to_numpy(), table.column("d2").to_numpy()
            new = np.zeros(len(table), bool)
            new[starts] = True
            once = new.copy()  # repeated rows of a table fetch a text again
            once[1:] |= (d1[1:] != d1[:-1]) | (d2[1:] != d2[:-1])
            table, d1, d2, new = table.filter(pa.array(once)), d1[once], d2[once], new[once]
            copies, text = table.column("copies").to_numpy(), table.column("text")
            out = []
            for a, b, (left, right, pairs) in groups(table, np.flatnonzero(new)):
                sets = []
                for k in range(a, b):
                    if (x := known.get((d1[k], d2[k]))) is None:
                        x = known[d1[k], d2[k]] = ngram_set(text[k].as_py(), words)
                    sets.append(x)
                links, forest, edges = np.zeros(b - a, np.int64), Forest(b - a), []
                for row, others in verified(sets, left, right, pairs, similarity):
                    links[row] += copies[a + others].sum()
                    links[others] += copies[a + row]
                    edges += [(a + row, a + o) for o in others.tolist() if forest.join(row, o)]
                out += [(x, y, 0) for x, y in edges] + [(a + k, a + k, links[k]) for k in np.flatnonzero(links).tolist()]
            known.clear()
            x, y, n = np.array(out, np.int64).reshape(-1, 3).T
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (d1[x], d2[x], d1[y], d2[y], n)], ["a1", "a2", "b1", "b2", "links"])

    together = wanted.join(fetched, ["d1", "d2"]).repartition(*at).sortWithinPartitions(*at, "d1", "d2")
    blocks = together.mapInArrow(compare, "a1 long, a2 long, b1 long, b2 long, links long")
    found = scratch.table(blocks, "found")
    degree = found.where("links > 0").groupBy(F.col("a1").alias("d1"), F.col("a2").alias("d2")).agg(F.sum("links").alias("links"))
    edges = found.where("links = 0").select(F.struct(F.col("a1").alias("d1"), F.col("a2").alias("d2")).alias("a"), F.struct(F.col("b1").alias("d1"), F.col("b2").alias("d2")).alias("b"))
    roots = connected_components(edges)
    roots = roots.select("node.d1", "node.d2", F.col("root.d1").alias("c1"), F.col("root.d2").alias("c2"))

    placed = texts.join(roots, ["d1", "d2"], "left").join(degree, ["d1", "d2"], "left")
    placed = scratch.table(placed.select("d1", "d2", "rep", "copies", F.coalesce("c1", "d1").alias("c1"), F.coalesce("c2", "d2").alias("c2"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "placed")
    classes = placed.groupBy("c1", "c2").agg(F.min("rep").alias("class"), F.sum("copies").alias("class_size"))
    classed = scratch.table(heavy_join(placed, classes, ["c1", "c2"], scratch).select("d1", "d2", "class", "class_size", "n_links"), "classed")
    some = heavy_join(signed.where("n > 0"), classed, ["d1", "d2"], scratch).select("doc_id", "key", F.col("class.doc_id").alias("class_id"), F.col("class.key").alias("class_key"), "n_links", "class_size", "n")
    none = signed.where("n = 0").select("doc_id", "key", F.col("doc_id").alias("class_id"), F.col("key").alias("class_key"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("class_size"), "n")
    return some.unionByName(none).withColumnRenamed("n", "n_grams")


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """The input without near copies: of each class the least doc_id stays; columns stay as they are."""
    names = docs.columns
    keyed = docs.withColumn("_tl_key", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_tl_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    found = jaccard_join(docs.select("doc_id", "text"))
    drop = found.where("not (class_id <=> doc_id and class_key = key)").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_tl_id"), F.col("key").alias("_tl_key"))
    return keyed.join(drop, ["_tl_id", "_tl_key"], "left_anti").select(*names)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(documents(spark, sf_dir)).drop("key", "class_key")
