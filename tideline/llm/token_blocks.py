"""Token ids of a corpus in files of patched frame-of-reference blocks.

A file holds the id streams of consecutive documents, one after another, in blocks of BLOCK ids:

    block    minimum u32, n u16, width u8, 0 u8, n_exceptions u16, 0 u16, packed bits, positions u16[], values u32[]
    footer   block starts u64[], document ids i64[], null flags u8[], ids a document u64[]
    trailer  blocks u64, documents u64, ids u64, footer start u64, magic

A block stores id - minimum. Its width is that of the PERCENTILE-th value; larger ones are stored whole as exceptions
(their packed bits are 0). All numbers are little-endian; block starts make any range of ids readable by itself.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, documents, text_rows

BLOCK = 4096
PERCENTILE = 95
END_ID = 2
MAGIC = b"TLPFOR01"
HEAD = struct.Struct("<IHBxHxx")
TAIL = struct.Struct("<QQQQ8s")
CACHE_WORDS = 600_000


def pack_block(ids: np.ndarray) -> bytes:
    """One block of at least one and at most BLOCK unsigned 32-bit ids."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    k = min(len(rest) - 1, (len(rest) * PERCENTILE + 99) // 100 - 1)
    width = int(np.partition(rest, k)[k]).bit_length()
    over = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.empty(0, np.int64)
    values = rest[over]
    rest[over] = 0
    kind, bits = _kind(width)
    packed = np.packbits(np.unpackbits(rest.astype(kind).view(np.uint8).reshape(len(rest), bits // 8), axis=1)[:, bits - width :])
    return HEAD.pack(low, len(ids), width, len(over)) + packed.tobytes() + over.astype("<u2").tobytes() + values.astype("<u4").tobytes()


def _kind(width: int) -> tuple[str, int]:
    """The least big-endian type that holds so many bits, and its bits."""
    return (">u1", 8) if width <= 8 else (">u2", 16) if width <= 16 else (">u4", 32)


def unpack_block(data: memoryview | bytes) -> np.ndarray:
    low, n, width, n_over = HEAD.unpack_from(data)
    at = HEAD.size
    size = (n * width + 7) // 8
    kind, wide = _kind(width)
    bits = np.zeros((n, wide), np.uint8)
    if width:
        bits[:, wide - width :] = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width).reshape(n, width)
    ids = np.packbits(bits, axis=1).view(kind).ravel().astype(np.uint32)
    at += size
    ids[np.frombuffer(data, "<u2", n_over, at)] = np.frombuffer(data, "<u4", n_over, at + 2 * n_over)
    return ids + np.uint32(low)


class BlockWriter:
    """Writes one file, block by block; only the footer's few numbers a document are kept in memory."""

    def __init__(self, out):
        self.out, self.at = out, 0
        self.starts: list[int] = []
        self.docs: list[tuple[int, int, int]] = []
        self.held: list[bytes] = []
        self.size = self.total = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: unsigned 32-bit little-endian."""
        self.docs.append((doc_id or 0, doc_id is None, len(ids) // 4))
        self.held.append(ids)
        self.size += len(ids) // 4
        self.total += len(ids) // 4
        if self.size >= 64 * BLOCK:
            self.flush(whole=False)

    def flush(self, whole: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), "<u4")
        end = len(ids) if whole else len(ids) - len(ids) % BLOCK
        for k in range(0, end, BLOCK):
            block = pack_block(ids[k : min(k + BLOCK, end)])
            self.starts.append(self.at)
            self.out.write(block)
            self.at += len(block)
        self.held, self.size = [ids[end:].tobytes()], len(ids) - end

    def close(self) -> None:
        self.flush(whole=True)
        docs = np.array(self.docs, dtype=np.int64).reshape(-1, 3)
        self.out.write(np.array(self.starts, "<u8").tobytes() + docs[:, 0].astype("<i8").tobytes() + docs[:, 1].astype("<u1").tobytes() + docs[:, 2].astype("<u8").tobytes())
        self.out.write(TAIL.pack(len(self.starts), len(docs), self.total, self.at, MAGIC))


class BlockReader:
    """Reads a file's documents in order, or any range of its ids."""

    def __init__(self, file):
        self.file, size = file, file.size()
        blocks, docs, self.total, foot, magic = TAIL.unpack(file.read_at(TAIL.size, size - TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token block file")
        data = file.read_at(size - TAIL.size - foot, foot)
        self.starts = np.append(np.frombuffer(data, "<u8", blocks).astype(np.int64), foot)
        self.doc_ids = np.frombuffer(data, "<i8", docs, 8 * blocks)
        self.nulls = np.frombuffer(data, "<u1", docs, 8 * (blocks + docs)).astype(bool)
        self.lengths = np.frombuffer(data, "<u8", docs, 8 * blocks + 9 * docs).astype(np.int64)

    def blocks(self, first: int, last: int) -> np.ndarray:
        """Ids of blocks [first, last)."""
        if first >= last:
            return np.empty(0, np.uint32)
        low = int(self.starts[first])
        data = self.file.read_at(int(self.starts[last]) - low, low)
        return np.concatenate([unpack_block(data[int(self.starts[k]) - low : int(self.starts[k + 1]) - low]) for k in range(first, last)])

    def ids(self, start: int, n: int) -> np.ndarray:
        first = start // BLOCK
        return self.blocks(first, -(-(start + n) // BLOCK))[start - first * BLOCK :][:n] if n else np.empty(0, np.uint32)

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in this file, ids) of each document."""
        held, first, k, start = np.empty(0, np.uint32), 0, 0, 0
        for doc_id, null, n in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.lengths.tolist()):
            if start + n > first + len(held):
                until = min(len(self.starts) - 1, max(k + 64, -(-(start + n) // BLOCK)))
                held, first, k = np.concatenate([held[start - first :], self.blocks(k, until)]), start, until
            yield (None if null else doc_id), start, held[start - first : start - first + n]
            start += n


class WordEncoder:
    """Byte-level BPE ids of whole texts; words that come again are looked up.

    The pattern that splits a text for this tokenizer always cuts before a space that a non-space follows, around a
    line end between two non-spaces, and between letters and a mark, so that a text's ids are those of such pieces put
    together. Texts with other spaces, or with an added token's own text in them, go to the tokenizer as they are.
    """

    MARKS = ".,;:!?"

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.content]
        vocabulary = self.tokenizer.get_vocab()
        self.led = np.zeros(max(vocabulary.values()) + 1, bool)
        self.led[[k for token, k in vocabulary.items() if token.startswith("\u0120")]] = True  # tokens that begin with a space
        self.marks = {c: self.whole(c) for c in "\n" + self.MARKS}
        self.line_end = int(self.ids("\n")[0])
        self.first: dict[str, bytes] = {}  # pieces that no space leads
        self.young: dict[str, bytes] = {}  # words that a space leads
        self.old: dict[str, bytes] = {}

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)

    def whole(self, text: str) -> bytes:
        return self.ids(text).tobytes()

    def spaced(self, words: list[str]) -> list[bytes]:
        """Ids of each word after a space, by one call: only a word's first token begins with a space."""
        ids = self.ids(" " + " ".join(words))
        starts = np.flatnonzero(self.led[ids])
        if len(starts) != len(words):
            return [self.whole(" " + w) for w in words]
        data, ends = ids.tobytes(), [*(4 * starts).tolist(), 4 * len(ids)]
        return [data[a:b] for a, b in zip(ends, ends[1:])]

    def unspaced(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece with nothing before it, by one call: a line end between non-spaces is a token of its own."""
        if any(not p or "\n" in p or p[0].isspace() or p[-1].isspace() or any(t in p for t in self.added) for p in pieces):
            return [self.whole(p) for p in pieces]
        ids = self.ids("\n".join(pieces))
        cuts = np.flatnonzero(ids == self.line_end)
        if len(cuts) != len(pieces) - 1:
            return [self.whole(p) for p in pieces]
        data, ends = ids.tobytes(), [-4, *(4 * cuts).tolist(), 4 * len(ids)]
        return [data[a + 4 : b] for a, b in zip(ends, ends[1:])]

    def learn(self, words: set[str], heads: set[str]) -> None:
        """Put words among the young ones, but for those that are empty or begin with white space; and heads."""
        young, old, missing, split = self.young, self.old, [], []
        for w in words:
            if (ids := old.get(w)) is not None:
                young[w] = ids
            elif not w or w[0].isspace():
                continue
            elif "\n" in w and all(p and not p[0].isspace() and not p[-1].isspace() for p in w.split("\n")):
                split.append((w, *w.split("\n")))
            elif w[-1] in self.MARKS and w[:-1].isalpha():
                split.append((w, w[:-1]))
            else:
                missing.append(w)
        heads = {h for x in split for h in x[2:] if h not in self.first} | heads
        if heads:
            heads = list(heads)
            self.first.update(zip(heads, self.unspaced(heads)))
        if split:
            self.learn({x[1] for x in split if x[1] not in young}, set())
        if missing:
            young.update(zip(missing, self.spaced(missing)))
        for w, head, *lines in split:
            if lines:
                young[w] = self.marks["\n"].join([young[head], *map(self.first.__getitem__, lines)])
            else:
                young[w] = young[head] + self.marks[w[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [t.split(" ") for t in texts]
        get = self.young.get
        found = [list(map(get, words)) for words in split]  # the first of each is no word after a space, and unused
        holes = [absent(ids) for ids in found]
        new = {words[k] for words, at in zip(split, holes) for k in at}
        heads = {words[0] for words in split if words[0] not in self.first}
        if new or heads:
            self.learn(new, heads)
        out = []
        for text, words, ids, at in zip(texts, split, found, holes):
            for k in at:
                ids[k] = get(words[k])
            ids[0] = self.first[words[0]]
            plain = None not in ids if at else True
            out.append(b"".join(ids) if plain and not any(t in text for t in self.added) else self.whole(text))
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        if len(self.first) > CACHE_WORDS:
            self.first = {}
        return out


def absent(ids: list) -> list[int]:
    """Where None stands, but for the first place."""
    out, k = [], 0
    try:
        while True:
            k = ids.index(None, k + 1)
            out.append(k)
    except ValueError:
        return out


def _tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """One encoder a Python worker, so that its words serve all tasks of that worker."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, directory: str, tokenizer_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write the ids of all texts to `directory`, in ascending doc_id order over and within files.

    Returns the manifest: part (the files' order), path, n_docs, n_tokens, n_bytes. Nulls: a null text is empty, a null
    doc_id comes first. Repeated ids are ordered by text. A file that a failed or repeated task attempt left behind is
    never listed. Empty texts hold the end id alone; an empty table writes no file with documents.
    """
    path = tokenizer_path or _tokenizer_path()

    def write(batches):
        encoder, end = encoder_of(path), np.array([end_id], "<u4").tobytes()
        task = TaskContext.get()
        fs, at = pafs.FileSystem.from_uri(directory)
        fs.create_dir(at, recursive=True)
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}.pfor"
        with fs.open_output_stream(f"{at}/{name}") as out:
            writer = BlockWriter(out)
            for batch in batches:
                for k in range(0, batch.num_rows, 64):
                    rows = batch.slice(k, 64)
                    for doc_id, ids in zip(rows.column(0).to_pylist(), encoder.encode(rows.column(1).to_pylist())):
                        writer.add(doc_id, ids + end)
            writer.close()
            size = out.tell()
        if writer.docs:
            yield pa.RecordBatch.from_pydict({"part": pa.array([task.partitionId()], pa.int64()), "path": [f"{directory}/{name}"], "n_docs": pa.array([len(writer.docs)], pa.int64()), "n_tokens": pa.array([writer.total], pa.int64()), "n_bytes": pa.array([size], pa.int64())})

    rows = text_rows(docs).withColumn("tie", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    return dealt.mapInArrow(write, "part long, path string, n_docs long, n_tokens long, n_bytes long")


def _read(manifest: DataFrame, as_batch, schema: str) -> DataFrame:
    """as_batch(list of (doc_id, start, ids)) over every document of the manifest's files, one task a file."""
    based = manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    based = based.select("path", F.coalesce("base", F.lit(0)).cast("long").alias("base"))

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_file(at) as file:
                    held, size = [], 0
                    for doc_id, start, ids in BlockReader(file).documents():
                        held.append((doc_id, base + start, ids))
                        size += len(ids)
                        if size > 1_000_000:
                            yield as_batch(held)
                            held, size = [], 0
                    if held:
                        yield as_batch(held)

    return based.repartition(max(1, manifest.count())).mapInArrow(read, schema)


def read_tokens(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids: every document of the manifest's files."""

    def as_batch(held):
        ids = pa.array(np.concatenate([x[2] for x in held]).astype(np.int64), pa.int64())
        ends = np.concatenate([[0], np.cumsum([len(x[2]) for x in held])])
        return pa.RecordBatch.from_arrays([pa.array([x[0] for x in held], pa.int64()), pa.array([x[1] for x in held], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids)], ["doc_id", "start", "ids"])

    return _read(manifest, as_batch, "doc_id long, start long, ids array<long>")


def token_digests(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from its ids as they are read."""

    def as_batch(held):
        crc = [zlib.crc32(x[2].astype("<u4").tobytes()) for x in held]
        columns = [x[0] for x in held], [x[1] for x in held], [len(x[2]) for x in held], crc
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(manifest, as_batch, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "token-blocks")
    manifest = scratch.table(write_tokens(documents(spark, sf_dir), scratch.path("files")), "manifest")
    return token_digests(manifest)
