"""Language-model scores from a probabilistic suffix tree over the words of running text.

A context is what stands before a word in its text: nothing, one word, or two (or back to the text's start). The counts
are those of training texts. Three steps go over the corpus, which is dealt in chunks of documents:

1. each chunk sends its distinct runs of one, two and three words, as sorted hashes with their counts, to the part that
   a hash belongs to; parts add up and answer with the totals;
2. each chunk sends, for its distinct contexts, by how much its training words there are better predicted with the
   context than with its parent (the context without its oldest word), less the cost of the context's numbers; parts add
   up, and a context is kept if the sum over the corpus is positive: the divergence test;
3. each chunk scores its texts: a word's probability comes from its longest kept context.

A context's distribution is its counts smoothed by its parent's: (n + w * parent's p) / (all + w). The root gives a word
the share (n + 1) / (N + V + 1), all unseen words being one symbol, as the base score does; so the model is a
distribution over the same symbols as the base.
"""

from __future__ import annotations

import math
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, documents, text_rows
from tideline.llm.jaccard_join import mixed

WEIGHTS = (200.0, 2.0)  # of the parent's distribution, in words, in contexts of one and of two words
LEAST = 2  # a context occurs so often at least
COST = 0.5  # of one number, in log(training words)
CHUNK_BYTES = 8_000_000
PART_KEYS = 2_000_000  # hashes that a part adds up, about
KEY_BITS = 56
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)  # hashes of what stands before and after a text
MULTIPLIER = np.uint64(0xD6E8FEB86659FD93)


def squeeze(x: np.ndarray) -> bytes:
    """Unsigned numbers as compressed byte planes."""
    wide = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    planes = x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T
    return bytes([wide]) + zlib.compress(planes.tobytes(), 1)


def unsqueeze(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8").ravel()


def pack(keys: np.ndarray, more: bytes) -> bytes:
    """Ascending numbers by their differences, whose low halves are random and stay as they are; and other bytes."""
    steps = np.diff(keys, prepend=np.uint64(0))
    high = squeeze(steps >> np.uint64(32))
    return struct.pack("<II", len(keys), len(high)) + steps.astype("<u4").tobytes() + high + more


def unpack(data: bytes) -> tuple[np.ndarray, bytes]:
    n, size = struct.unpack_from("<II", data)
    at = 8 + 4 * n
    steps = np.frombuffer(data, "<u4", n, 8).astype(np.uint64) | unsqueeze(data[at : at + size]) << np.uint64(32)
    return np.cumsum(steps, dtype=np.uint64), data[at + size :]


def chunks_of(docs: DataFrame) -> DataFrame:
    """Chunks of documents, each of about CHUNK_BYTES of text or one longer document.

    chunk; hashes: of its distinct words; docs, held and tokens (words) a document; seq: word numbers of one document after another.
    """

    def split(batches):
        import xxhash

        at, size = TaskContext.get().partitionId() << 32, 0
        numbers: dict[bytes, int] = {}
        held: list = []

        def row():
            hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, numbers), np.uint64, len(numbers))
            values = [at], [hashes.tobytes()], [[h[0] for h in held]], [[h[1] for h in held]], [[len(h[2]) for h in held]], [squeeze(np.concatenate([h[2] for h in held]))]
            kinds = pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int64()), pa.binary()
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds)], ["chunk", "hashes", "docs", "held", "tokens", "seq"])

        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                for doc_id, out, text in zip(*(part.column(c).to_pylist() for c in range(3))):
                    words = text.encode("utf-8", "surrogatepass").lower().split()
                    for w in words:
                        if w not in numbers:
                            numbers[w] = len(numbers)
                    held.append((doc_id, out, np.fromiter(map(numbers.__getitem__, words), np.uint32, len(words))))
                    size += len(text)
                    if size >= CHUNK_BYTES:
                        yield row()
                        at, size, numbers, held = at + 1, 0, {}, []
        if held:
            yield row()

    held_out = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2
    rows = text_rows(docs).select("doc_id", held_out.alias("held"), "text")
    return rows.mapInArrow(split, "chunk long, hashes binary, docs array<long>, held array<boolean>, tokens array<long>, seq binary")


class Chunk:
    """A chunk's symbols (start, words, end of each document) and its distinct runs of one, two and three of them."""

    def __init__(self, row: dict):
        self.docs, self.held = row["docs"], np.array(row["held"], bool)
        self.tokens = np.array(row["tokens"], np.int64)
        words = np.frombuffer(row["hashes"], np.uint64)
        lengths = self.tokens + 2
        first = np.cumsum(lengths) - lengths
        inner = np.ones(int(lengths.sum()), bool)
        inner[first] = inner[first + lengths - 1] = False
        symbols = np.empty(len(inner), np.uint64)
        symbols[first], symbols[first + lengths - 1] = START, END
        symbols[inner] = words[unsqueeze(row["seq"])]
        self.train = np.repeat(~self.held, lengths)
        inside = np.arange(len(symbols)) - np.repeat(first, lengths)
        self.predicted = np.flatnonzero(inside > 0)
        runs, found, self.places = symbols, [], []
        self.number = np.full((3, len(symbols)), -1, np.int32)  # of the run of so many words that ends at a place
        at = 0
        for words_before in range(3):
            place = np.flatnonzero(inside >= words_before)
            if words_before:
                longer = np.zeros(len(symbols), np.uint64)
                longer[place] = mixed(runs[place - 1] * MULTIPLIER + symbols[place])
                runs = longer
            keys, number = np.unique((runs[place] >> np.uint64(64 - KEY_BITS)) & ~np.uint64(3) | np.uint64(words_before), return_inverse=True)
            self.number[words_before, place] = number + at
            self.places.append(place)
            found.append(keys)
            at += len(keys)
        keys = np.concatenate(found)
        order = np.argsort(keys)
        rank = np.empty(len(keys) + 1, np.int32)  # the last stands for no run
        rank[order], rank[-1] = np.arange(len(keys)), -1
        self.keys, self.number = keys[order], rank[self.number]

    def counts(self) -> np.ndarray:
        """How often each run occurs in the chunk's training documents."""
        return sum(np.bincount(self.number[k, place], self.train[place], len(self.keys)) for k, place in enumerate(self.places)).astype(np.uint64)

    def predict(self, totals: np.ndarray, n: int, v: int) -> None:
        """Probabilities from the root, one word and two words before each place, and the contexts there with their totals."""
        seen = [np.where(own >= 0, totals[own], 0).astype(float) for own in self.number]
        self.p = [(seen[0] + 1) / (n + v + 1)]
        self.context = [np.full(len(self.train), -1, np.int32) for _ in range(2)]
        self.gain = []
        for k, weight in enumerate(WEIGHTS):
            place = self.places[k + 1]
            whole = np.zeros(len(self.train))
            whole[place] = seen[k][place - 1]
            self.context[k][place] = np.where(whole[place] >= LEAST, self.number[k, place - 1], -1)
            own, up = seen[k + 1], self.p[k]
            self.p.append((own + weight * up) / (whole + weight))
            use = np.flatnonzero((self.context[k] >= 0) & self.train)
            gain = np.zeros(len(self.train))
            gain[use] = np.log(own[use] / whole[use] / up[use]) - COST * math.log(max(n, 2)) / own[use]
            self.gain.append(gain)

    def contexts(self) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of the runs that are contexts here, what each gains on the chunk's training words)."""
        gain = sum(np.bincount(c[c >= 0], g[c >= 0], len(self.keys)) for c, g in zip(self.context, self.gain))
        used = np.zeros(len(self.keys), bool)
        for c in self.context:
            used[c[c >= 0]] = True
        return np.flatnonzero(used), gain[used]

    def scores(self, kept: np.ndarray) -> np.ndarray:
        """log10 of each place's probability from its longest kept context."""
        p = self.p[0]
        for k in range(2):
            p = np.where((self.context[k] >= 0) & kept[self.context[k]], self.p[k + 1], p)
        return np.log10(p)

    def by_document(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(np.repeat(np.arange(len(self.tokens)), self.tokens + 1), values[self.predicted], len(self.tokens))


def sent(chunk: int, keys: np.ndarray, parts: int, more) -> pa.Table:
    """(part, chunk, data): the ascending keys cut by part; more(slice) gives the other bytes."""
    part = (keys >> np.uint64(KEY_BITS - 32)) * np.uint64(parts) >> np.uint64(32)
    numbers = np.unique(part)
    ends = np.searchsorted(part, numbers, "right").tolist()
    slices = [slice(a, b) for a, b in zip([0, *ends], ends)]
    return pa.table({"part": pa.array(numbers.astype(np.int64)), "chunk": pa.array(np.full(len(numbers), chunk, np.int64)), "data": pa.array([pack(keys[s], more(s)) for s in slices], pa.binary())})


SENT = "part long, chunk long, data binary"
ANSWER = "kind int, chunk long, part long, known long, data binary"


def answers(table: pa.Table, kind: int, values_of, answer_of) -> pa.Table:
    """What one part adds up over chunks, and its answer to each of them."""
    got = [unpack(x) for x in table.column("data").to_pylist()]
    keys, number = np.unique(np.concatenate([k for k, _ in got]), return_inverse=True)
    sums = np.bincount(number, np.concatenate([values_of(more) for _, more in got]), len(keys))
    known = int(((keys & np.uint64(3) == 0) & (sums > 0)).sum())
    ends = np.cumsum([len(k) for k, _ in got])
    data = [answer_of(sums[x]) for x in np.split(number, ends[:-1])]
    n = len(data)
    return pa.table({"kind": pa.array([kind] * n, pa.int32()), "chunk": table.column("chunk"), "part": table.column("part"), "known": pa.array([known] * n, pa.int64()), "data": pa.array(data, pa.binary())})


def answered(table: pa.Table, kind: int, of) -> np.ndarray:
    """A chunk's answers of one kind, in the order of its keys."""
    rows = sorted((r["part"], r["data"]) for r in table.to_pylist() if r["kind"] == kind)
    return np.concatenate([of(x) for _, x in rows])


def lm_scores(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are words (A-Z lower-cased, between ASCII white space), then one end. Training documents are those whose
    crc32(doc_id as text) mod 7 is not 2; a null doc_id counts as empty text there. A null text is empty and has the
    end alone. Repeated rows count and are scored each. Without training documents every probability is 1, as in the
    base. An empty table gives an empty result. A text longer than a chunk is a chunk of its own and lies in one task.

    Counts cover all training texts. A chunk sends each distinct run of words once, so a frequent word or passage is
    no heavier than the chunks it is in, and parts are equally large; runs are known by 56-bit hashes. Chunks lie
    dealt by number, so only requests and answers are shuffled, never texts. Sums of gains are of 32-bit numbers.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix-tree-lm")
    dealt = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = scratch.bucketed(chunks_of(docs), "chunks", "chunk", dealt)
    per_doc = chunks.select(F.explode(F.arrays_zip("held", "tokens")).alias("x")).select((F.col("x.tokens") + 1).alias("t"), F.col("x.held").alias("held"))
    sizes = per_doc.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("all"), F.coalesce(F.sum(F.when(~F.col("held"), F.col("t"))), F.lit(0)).alias("train")).first()
    n, parts = sizes["train"], max(dealt, 3 * sizes["all"] // PART_KEYS)

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                chunk = Chunk(row)
                counts = chunk.counts()
                yield from sent(row["chunk"], chunk.keys, parts, lambda s: squeeze(counts[s])).to_batches()

    requests = chunks.mapInArrow(ask, SENT)
    totals = requests.groupBy("part").applyInArrow(lambda t: answers(t, 0, unsqueeze, lambda x: squeeze(x.astype(np.uint64))), ANSWER)
    totals = scratch.table(totals, "totals")
    v = totals.groupBy("part").agg(F.first("known").alias("known")).agg(F.sum("known")).first()[0] or 0
    v -= n > 0  # the start of texts is counted as a context, but is no symbol

    def state(left: pa.Table, right: pa.Table) -> tuple[dict, Chunk]:
        row = left.to_pylist()[0]
        chunk = Chunk(row)
        chunk.predict(answered(right, 0, unsqueeze), n, v)
        return row, chunk

    def test(left: pa.Table, right: pa.Table) -> pa.Table:
        row, chunk = state(left, right)
        used, gain = chunk.contexts()
        return sent(row["chunk"], chunk.keys[used], parts, lambda s: gain[s].astype("<f4").tobytes())

    by_chunk = chunks.groupBy("chunk")
    tests = by_chunk.cogroup(totals.groupBy("chunk")).applyInArrow(test, SENT)
    kept = tests.groupBy("part").applyInArrow(lambda t: answers(t, 1, lambda x: np.frombuffer(x, "<f4").astype(float), lambda x: struct.pack("<I", len(x)) + np.packbits(x > 0).tobytes()), ANSWER)
    kept = scratch.table(kept, "kept")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        row, chunk = state(left, right)
        used, _ = chunk.contexts()
        bits = np.zeros(len(chunk.keys), bool)
        if len(used):
            bits[used] = answered(right, 1, lambda x: np.unpackbits(np.frombuffer(x, np.uint8, offset=4), count=struct.unpack_from("<I", x)[0])).astype(bool)
        known = chunk.p[0] * (n + v + 1) > 1.5
        columns = [pa.array(row["docs"], pa.int64()), pa.array(chunk.held), pa.array(chunk.tokens + 1), pa.array(chunk.by_document(known).astype(np.int64)), pa.array(np.full(len(chunk.tokens), n, np.int64)), pa.array(chunk.by_document(np.log10(chunk.p[0]))), pa.array(chunk.by_document(chunk.scores(bits)))]
        return pa.table(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    told = totals.unionByName(kept).groupBy("chunk")
    return by_chunk.cogroup(told).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op9_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
