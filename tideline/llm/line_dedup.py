"""Near-duplicate lines across documents by a deletion-neighbourhood join, with an edit bound of one word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, documents, heavy_join, text_rows
from tideline.llm.components import connected_components
from tideline.llm.jaccard_join import _powers, mixed

WORDS = 5  # lines of fewer words are alike only if equal
SHORT = 16  # lines of up to so many words emit all variants; longer ones only if they share a half with a line of near length
BLOCK = 1 << 20  # bytes of text that are hashed together
LENGTH = np.uint64(0xD6E8FEB86659FD93)
_table: list[tuple[np.ndarray, np.ndarray]] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _table or len(_table[0][0]) < n:
        _table[:] = [_powers(max(1 << 16, 2 * n))]
    return _table[0]


def word_hashes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each lower-cased word, line number of each word)."""
    data = np.frombuffer(f"\n{text.lower()}\n".encode("utf-8", "surrogatepass"), np.uint8)  # begins and ends outside of words
    up, down = powers(len(data) + 1)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    starts, ends = edge[::2], edge[1::2]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), np.cumsum(data == 10, dtype=np.int32)[starts] - 1


def counted(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, .., n[0] of them, then those of first[1], and so on."""
    return np.arange(n.sum()) + np.repeat(first - np.cumsum(n) + n, n)


def offsets(n: np.ndarray) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())


class Lines:
    """The lines with words of some texts, hashed together, and hashes of any run of their words: equal runs have equal hashes."""

    def __init__(self, texts: list[str]):
        self.hashes, at = word_hashes("\n".join(texts))  # \n bounds words and the letters that lower-casing looks at
        self.total = np.array([t.count("\n") + 1 if t else 0 for t in texts], np.int64)
        up, self.down = powers(len(self.hashes) + 2)
        self.sums = np.zeros(len(self.hashes) + 1, np.uint64)
        np.cumsum(self.hashes * up[: len(self.hashes)], out=self.sums[1:])
        self.first = np.flatnonzero(np.concatenate([[True] * (len(at) > 0), at[1:] != at[:-1]]))
        self.n = np.diff(self.first, append=len(at))
        taken = np.maximum(self.total, 1)  # an empty text is an empty line between its neighbours
        begins = np.cumsum(taken) - taken
        self.text = np.searchsorted(begins, at[self.first], "right") - 1
        self.numbers = at[self.first] - begins[self.text]
        self.size = np.bincount(self.text, minlength=len(texts))
        self.d1 = self.run(self.first, self.n)

    def run(self, first: np.ndarray, n: np.ndarray, salt: np.ndarray | int = 0) -> np.ndarray:
        value = (self.sums[first + n] - self.sums[first]) * self.down[first]
        return mixed(value + n.astype(np.uint64) * LENGTH + np.asarray(salt, np.uint64))

    def second(self) -> np.ndarray:
        """Another hash of each line, of all its words."""
        return mixed(self.d1 ^ mixed(self.run(self.first, self.n - 1) + self.hashes[self.first + self.n - 1]))

    def halves(self, some: np.ndarray) -> np.ndarray:
        """Four hashes for each of some lines.

        Two lines with at most one edit, the shorter of n words, share their first or their last (n - 1) // 2 words. A
        line looks for partners as the shorter one or an equally long one, and as the longer one; n is in the hash.
        """
        first, n, out = self.first[some], self.n[some], []
        for least in (n, n - 1):
            p, salt = (least - 1) // 2, 4 * least.astype(np.uint64)
            out += [self.run(first, p, salt + np.uint64(1)), self.run(first + n - p, p, salt + np.uint64(2))]
        return np.column_stack(out)

    def places(self, some: np.ndarray, prefix: np.ndarray, suffix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(from, to): where an edit of a line may lie beside a line that shares its first or its last half."""
        n = self.n[some]
        half = (n - 2) // 2
        return np.where(suffix, 0, half), np.where(prefix, n, n - half)

    def near(self, some: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[pa.Array]:
        """The columns of NEAR for some lines. A variant is the line without its word low, low + 1, .. below high: its hash
        is what run() gives for the line that is left."""
        first, n, many = self.first[some], self.n[some], high - low
        words = self.hashes[counted(first, n)]
        out = counted(first + low, many)
        first, n = np.repeat(first, many), np.repeat(n, many)
        before = (self.sums[out] - self.sums[first]) * self.down[first]
        after = (self.sums[first + n] - self.sums[out + 1]) * self.down[first + 1]
        variants = pa.array(mixed(before + after + (n - 1).astype(np.uint64) * LENGTH).view(np.int64))
        binary = pa.Array.from_buffers(pa.binary(), len(some), [None, offsets(8 * self.n[some]).buffers()[1], pa.py_buffer(words)])
        return [pa.array(self.d1[some].view(np.int64)), binary, pa.array(low, pa.int32()), pa.ListArray.from_arrays(offsets(many), variants)]


NEAR = "d1 long, words binary, start int, variants array<long>"
NEAR_NAMES = ["d1", "words", "start", "variants"]


def blocks(batches, column: int):
    """Slices of batches with up to BLOCK bytes of text, or with one longer text."""
    for batch in batches:
        ends, k = np.cumsum(pc.binary_length(batch.column(column)), dtype=np.int64), 0
        while k < batch.num_rows:
            past = max(k + 1, int(np.searchsorted(ends, BLOCK + (ends[k - 1] if k else 0), "right")))
            yield batch.slice(k, past - k)
            k = past


def hashed_lines(batches, words: int, short: int):
    """Batches of line_table: rid, doc_id, key and text become what is known of the text's lines."""
    for part in blocks(batches, 3):
        lines = Lines(part.column(3).to_pylist())
        long = lines.n >= short  # the longest short lines have longer partners
        half = pa.ListArray.from_arrays(offsets(np.where(long, 4, 0)), pa.array(lines.halves(long).ravel().view(np.int64)))
        columns = [pa.array(lines.numbers, pa.int32()), pa.array(lines.d1.view(np.int64)), pa.array(lines.second().view(np.int64)), half]
        items = pa.ListArray.from_arrays(offsets(lines.size), pa.StructArray.from_arrays(columns, ["line", "d1", "d2", "half"]))
        some = np.flatnonzero((lines.n <= short) & (lines.n >= words))
        some = np.sort(some[np.unique(lines.d1[some], return_index=True)[1]])  # one of a block's equal lines
        structs = pa.StructArray.from_arrays(lines.near(some, np.zeros_like(some), lines.n[some]), NEAR_NAMES)
        near = pa.ListArray.from_arrays(offsets(np.bincount(lines.text[some], minlength=part.num_rows)), structs)
        yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), pa.array(lines.total), items, near], ["rid", "doc_id", "key", "n_lines", "items", "near"])


def line_table(docs: DataFrame, words: int, short: int) -> DataFrame:
    """rid, doc_id, key (of the text), n_lines; items: number, digests and, of lines of `short` words or more, half hashes; near: digest, words and variants of lines of `words` to `short` words (of equal lines of neighbouring texts, one at least)."""
    rows = text_rows(docs).select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.xxhash64("text").alias("key"), "text")
    return rows.mapInArrow(lambda batches: hashed_lines(batches, words, short), f"rid long, doc_id long, key long, n_lines long, items array<struct<line:int,d1:long,d2:long,half:array<long>>>, near array<struct<d1:long,words:binary,start:int,variants:array<long>>>")


def chosen_words(batches):
    """Batches of NEAR from text and lines. Only the wanted lines are hashed."""
    for part in blocks(batches, 0):
        x = part.column(1).flatten()
        at, kept = x.field("line").to_numpy(), []
        ends = np.cumsum(pc.list_value_length(part.column(1)))
        for text, numbers in zip(part.column(0).to_pylist(), np.split(at, ends[:-1])):
            every = text.split("\n")
            kept += [every[i] for i in numbers.tolist()]
        lines = Lines(kept)  # each has words, so they are lines 0, 1, ..
        some = np.arange(len(kept))
        low, high = lines.places(some, *(x.field(c).to_numpy(zero_copy_only=False) for c in ("prefix", "suffix")))
        yield pa.RecordBatch.from_arrays(lines.near(some, low, high), NEAR_NAMES)


def line_words(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """d1, words (their hashes), and variants without one word from place `start` on, of the wanted lines: doc_id, key, and
    lines (line, prefix, suffix: which halves are shared)."""
    keyed, wanted = text_rows(docs).withColumn("key", F.xxhash64("text")).alias("k"), wanted.alias("w")
    same = F.col("k.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("k.key") == F.col("w.key"))
    return keyed.join(wanted, same).select("k.text", "w.lines").mapInArrow(chosen_words, NEAR)


def one_edit(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether at most one word was deleted, inserted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    differs = np.flatnonzero(a != b[: len(a)])
    at = int(differs[0]) if len(differs) else len(a)
    return bool((a[at + (len(a) == len(b)) :] == b[at + 1 :]).all())


def line_dedup(docs: DataFrame, words: int = WORDS, short: int = SHORT) -> DataFrame:
    """One row per document: doc_id, n_lines, dropped (numbers of the lines that repeat an earlier one, ascending).

    Lines end at \\n; words are lower-cased and lie between ASCII white space; a line without words is left alone. Two
    lines are alike if equal, and two of at least `words` also if one word was deleted, inserted or replaced; alike
    lines form groups, and of a group the line of the least (doc_id, row, line number) stays. A null doc_id comes after
    all others, null and empty texts have no lines, repeated rows repeat their lines.

    Equal lines count as one, from map-side combining on. The neighbourhood join takes each variant of a line without
    one word as a hashed key. Lines of up to `short` words emit all of theirs: their number is in proportion to the
    input. A longer line can be alike another only if it shares half its words, from either end, with a line of near
    length, so it emits variants only where such a half occurs, and only without a word outside of it. Lines with equal variants at the same place are linked
    to the least of them, and lines that are a variant to that line; so a crowded key gives one edge a line. Every edge
    is verified on the words.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "line-dedup")
    rows = scratch.table(line_table(docs, words, short), "lines")
    lines = rows.select("rid", "doc_id", "key", F.explode("items").alias("x")).select("rid", "doc_id", "key", "x.line", "x.d1", "x.d2", "x.half")
    keys = lines.select("doc_id", "key", "line", "d1", F.posexplode("half").alias("side", "h"))
    shared = keys.groupBy("h").agg(F.min("d1").alias("lo"), F.max("d1").alias("hi")).where("lo < hi").select("h")
    side = lambda k: F.bool_or(F.col("side") % 2 == k)
    taking = keys.join(shared, "h", "left_semi").groupBy("d1").agg(F.min(F.struct("doc_id", "key", "line")).alias("at"), side(0).alias("prefix"), side(1).alias("suffix"))
    wanted = taking.groupBy("at.doc_id", "at.key").agg(F.array_sort(F.collect_list(F.struct("at.line", "prefix", "suffix"))).alias("lines"))
    every = rows.select(F.explode("near").alias("x")).select("x.*").union(line_words(docs, wanted))
    longest = F.max_by(F.struct("words", "start", "variants"), F.size("variants"))  # a short line may come twice
    near = scratch.table(every.groupBy("d1").agg(longest.alias("x")).select("d1", "x.*"), "near")

    variants = near.select("d1", "start", F.posexplode("variants").alias("at", "v")).select("d1", (F.col("start") + F.col("at")).alias("at"), "v")
    stars = variants.groupBy("v", "at").agg(F.min("d1").alias("a"), F.max("d1").alias("b")).where("a < b").select("v", "at", "a")
    replaced = variants.join(stars, ["v", "at"]).where("d1 <> a").select("a", F.col("d1").alias("b"))
    inserted = variants.select(F.col("d1").alias("b"), "v").join(near.select(F.col("d1").alias("a")), F.col("v") == F.col("a")).select("a", "b")
    edges = replaced.union(inserted).distinct()

    def verify(batches):
        for batch in batches:
            a, b = (batch.column(k).to_pylist() for k in (2, 3))
            good = [one_edit(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))

    first, second = near.select(F.col("d1").alias("a"), F.col("words").alias("wa")), near.select(F.col("d1").alias("b"), F.col("words").alias("wb"))
    checked = scratch.table(edges.join(first, "a").join(second, "b").select("a", "b", "wa", "wb").mapInArrow(verify, "a long, b long"), "edges")
    roots = connected_components(checked).withColumnRenamed("node", "d1")
    scratch.drop("near", "edges")

    # One row a distinct line, then one a group, and back to the occurrences of those lines whose group has several.
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid", "line")
    distinct = lines.groupBy("d1", "d2").agg(F.min(place).alias("first"), F.count("*").alias("n")).join(roots, "d1", "left")
    distinct = distinct.select("d1", "d2", "first", "n", F.coalesce("root", "d1").alias("c1"), F.when(F.col("root").isNull(), F.col("d2")).otherwise(F.lit(0)).alias("c2"))
    distinct = scratch.table(distinct, "distinct")
    groups = distinct.groupBy("c1", "c2").agg(F.min("first").alias("first"), F.sum("n").alias("n")).where("n > 1").select("c1", "c2", F.col("first.rid").alias("keep_rid"), F.col("first.line").alias("keep_line"))
    repeated = scratch.table(heavy_join(distinct.select("d1", "d2", "c1", "c2"), groups, ["c1", "c2"], scratch).select("d1", "d2", "keep_rid", "keep_line"), "repeated")
    met = heavy_join(lines.select("rid", "line", "d1", "d2"), repeated, ["d1", "d2"], scratch)
    gone = met.where("not (rid = keep_rid and line = keep_line)").groupBy("rid").agg(F.array_sort(F.collect_list("line")).alias("dropped"))
    return rows.select("rid", "doc_id", "n_lines").join(gone, "rid", "left").select("doc_id", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def without_lines(text, dropped):
    """A text column without the lines of the given numbers."""
    return F.array_join(F.filter(F.split(text, "\n", -1), lambda _, k: ~F.array_contains(dropped, k)), "\n")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup(documents(spark, sf_dir))
    return found.select("doc_id", "n_lines", F.size("dropped").cast("long").alias("n_dropped"), F.array_join(F.transform("dropped", lambda k: k.cast("string")), ",").alias("dropped"))
