"""SentencePiece encoding and decoding: batched Viterbi over the words of many texts."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import documents, kept

SPACE = "▁"
BASE = np.uint64(0x100000001B3)
BATCH_CELLS = 1 << 18
BATCH_TEXTS = 1000  # the more words of a length advance together, the fewer steps
STRETCH = 1 << 15  # places of a long word whose pieces are looked up at once
CACHE_WORDS = 450_000
NORMAL, UNKNOWN, BYTE = 1, 2, 6  # piece types of the model format


class Pieces:
    """A model's pieces: for each length the sorted hashes of its pieces, with their ids and scores."""

    def __init__(self, model_path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("this model changes texts before it cuts them; only identity models are encoded here")
        if any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces if p.type == NORMAL):
            raise ValueError("a piece has a space after another character, so words cannot be encoded by themselves")
        self.prefix = spec.add_dummy_prefix
        self.table = [p.piece.encode() for p in model.pieces]
        self.unknown = next(k for k, p in enumerate(model.pieces) if p.type == UNKNOWN)
        self.bytes = {int(p.piece[3:-1], 16): k for k, p in enumerate(model.pieces) if p.type == BYTE}
        self.table = [p.replace(SPACE.encode(), b" ") for p in self.table]
        for value, k in self.bytes.items():
            self.table[k] = bytes([value])
        by: dict[int, list[tuple[int, int, float]]] = defaultdict(list)
        self.codes: dict[int, np.ndarray] = {}
        least = 0.0
        for k, p in enumerate(model.pieces):
            if p.type == NORMAL and p.piece:
                code = np.array([ord(c) for c in p.piece], np.uint64)
                by[len(code)].append((int(substring_hash(code)), k, p.score))
                self.codes[k] = code
                least = min(least, p.score)
        self.unknown_score = least - 10.0
        self.longest = max(by, default=1)
        self.keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for n, rows in by.items():
            rows.sort()
            ids = np.array([r[1] for r in rows], np.int64)
            self.keys[n] = np.array([r[0] for r in rows], np.uint64), ids, np.array([r[2] for r in rows], np.float64), np.stack([self.codes[k] for k in ids.tolist()])
        self.codes.clear()

    def matches(self, codes: np.ndarray):
        """For each length: which substrings of the equally long words are pieces, as (length, rows, starts, ids, scores)."""
        words, size = codes.shape
        rolling = np.zeros((words, size), np.uint64)
        for n in range(1, min(self.longest, size) + 1):
            rolling = rolling[:, : size - n + 1] * BASE + codes[:, n - 1 :]
            if n not in self.keys:
                continue
            keys, ids, scores, spelled = self.keys[n]
            at = np.minimum(np.searchsorted(keys, rolling), len(keys) - 1)
            row, start = np.nonzero(keys[at] == rolling)
            found = at[row, start]
            same = (codes[row[:, None], start[:, None] + np.arange(n)] == spelled[found]).all(axis=1)  # a hash alone proves nothing
            if same.any():
                yield n, row[same], start[same], ids[found[same]], scores[found[same]]

    def viterbi(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best-scoring piece ids of words of one length (rows of code points), word after word, and how many each has;
        an unknown character is -1 - its code.

        Words advance together, one end position at a time: the maximum over piece lengths of the best score before the
        piece plus the piece's. Of equal scores the path with the longest last piece wins. Pieces are looked up for one
        stretch of places after another, so that a long word needs little more than its back-pointers.
        """
        words, size = codes.shape
        lengths = np.array(sorted({1, *(n for n in self.keys if n <= size)}, reverse=True))
        slot = {int(n): k for k, n in enumerate(lengths)}
        column, pad = np.arange(words), int(lengths[0])
        best = np.full((pad + size + 1, words), -np.inf)
        best[pad] = 0.0
        back, taken = np.zeros((size, words), np.int64), np.zeros((size, words), np.int64)
        for low in range(0, size, STRETCH):
            high, first = min(size, low + STRETCH), max(0, low - pad + 1)
            score, piece = np.full((high - low, len(lengths), words), -np.inf), np.zeros((high - low, len(lengths), words), np.int64)
            for n, row, start, ids, scores in self.matches(codes[:, first:high]):
                at = first + start + n - 1 - low  # of a piece's last character, in this stretch
                if low:
                    row, at, ids, scores = (x[at >= 0] for x in (row, at, ids, scores))
                score[at, slot[n], row], piece[at, slot[n], row] = scores, ids
            single = score[:, -1]
            none = np.isneginf(single)
            single[none] = self.unknown_score
            piece[:, -1][none] = -1 - codes[:, low:high].T[none].astype(np.int64)
            for k in range(high - low):
                end = low + k
                offers = best[pad + end + 1 - lengths] + score[k]
                choice = offers.argmax(axis=0)
                best[pad + end + 1], back[end], taken[end] = offers[choice, column], lengths[choice], piece[k, choice, column]
        out, used = np.zeros((words, size), np.int64), np.zeros((words, size), bool)
        at, row = np.full(words, size), column
        while len(row):
            out[row, at[row] - 1] = taken[at[row] - 1, row]
            used[row, at[row] - 1] = True
            at[row] -= back[at[row] - 1, row]
            row = row[at[row] > 0]
        return out[used], used.sum(axis=1)

    def word_ids(self, words: list[str]) -> list[bytes]:
        """Ids of words, as 32-bit numbers; a character without a piece becomes its bytes."""
        by: dict[int, list[int]] = defaultdict(list)
        for k, w in enumerate(words):
            by[len(w)].append(k)
        out = [b""] * len(words)
        for size, members in by.items():
            step = max(1, BATCH_CELLS // (size * max(1, min(size, self.longest))))
            for k in range(0, len(members), step):
                part = members[k : k + step]
                codes = np.frombuffer("".join(words[m] for m in part).encode("utf-32-le", "surrogatepass"), "<u4").reshape(len(part), size)
                ids, counts = self.viterbi(np.where(codes == ord(" "), ord(SPACE), codes).astype(np.uint64))
                if len(ids) and ids.min() < 0:
                    ids, counts = self.spelled(ids, counts)
                data, ends = ids.astype("<i4").tobytes(), [0, *(4 * np.cumsum(counts)).tolist()]
                for m, a, b in zip(part, ends, ends[1:]):
                    out[m] = data[a:b]
        return out

    def spelled(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids and counts with each unknown character as its bytes."""
        parts = [[x] if x >= 0 else self.fallback(chr(-1 - x)) for x in ids.tolist()]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        more = np.add.reduceat(sizes, np.cumsum(counts) - counts)
        return np.array([i for x in parts for i in x], np.int64), more

    def fallback(self, c: str) -> list[int]:
        return [self.bytes.get(b, self.unknown) for b in c.encode("utf-8", "surrogatepass")]

    def text(self, ids: list[int]) -> str:
        joined = b"".join(map(self.table.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return joined[1:] if self.prefix and joined.startswith(" ") else joined


def substring_hash(codes: np.ndarray) -> np.uint64:
    out = np.uint64(0)
    with np.errstate(over="ignore"):
        for c in codes:
            out = out * BASE + c
    return out


class Encoder:
    """Ids of whole texts. No piece has a space mark after another character, so words are encoded by themselves."""

    WORD = re.compile(" *[^ ]+| +")  # a space stands for the mark, which is a wider character, until words are looked up

    def __init__(self, model_path: str):
        self.pieces = Pieces(model_path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        plain = text.replace(SPACE, " ") if SPACE in text else text
        return self.WORD.findall(" " + plain if self.pieces.prefix and text else plain)

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        new = [w for w in {w for ws in split for w in ws} if w not in self.young]
        missing = []
        for w in new:
            if (ids := self.old.get(w)) is None:
                missing.append(w)
            else:
                self.young[w] = ids
        self.young.update(zip(missing, self.pieces.word_ids(missing)))
        out = [b"".join(map(self.young.__getitem__, ws)) for ws in split]
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        return out


def encoder_of(model_path: str) -> Encoder:
    """One encoder a Python worker, as long as it runs tasks of this operator."""
    found = kept("sentence-pieces")
    if model_path not in found:
        found[model_path] = Encoder(model_path)
    return found[model_path]


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


ENCODED = "doc_id long, text_sha256 string, ids array<int>"
DECODED = f"{ENCODED}, text string"


def encoding(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        encoder = encoder_of(path)
        for batch in batches:
            for k in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(k, BATCH_TEXTS)
                found = encoder.encode(part.column(2).to_pylist())
                ids = np.frombuffer(b"".join(found), "<i4")
                ends = np.cumsum([0, *(len(x) // 4 for x in found)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "text_sha256", "ids"])

    return run


def decoding(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches):
        pieces = encoder_of(path).pieces
        for batch in batches:
            for k in range(0, batch.num_rows, 200):
                part = batch.slice(k, 200)
                ids = part.column(2).flatten().to_numpy(zero_copy_only=False).tolist()
                ends = [0, *np.cumsum(pc.list_value_length(part.column(2)).fill_null(0).to_numpy(zero_copy_only=False)).tolist()]
                texts = [pieces.text(ids[a:b]) for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(3)), pa.array(texts, pa.string())], ["doc_id", "text_sha256", "ids", "text"])

    return run


def digested(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.sha2(text, 256).alias("text_sha256"), text.alias("text"))


def encode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_sha256, ids: of each whole text the pieces with the greatest sum of scores.

    Unknown characters become byte pieces. A null text counts as empty and has no ids; repeated rows repeat; other
    columns are not read. model_path must be readable where the tasks run.
    """
    return digested(docs, id_col, text_col).mapInArrow(encoding(model_path or default_model()), ENCODED)


def decode(encoded: DataFrame, model_path: str | None = None) -> DataFrame:
    """The rows of encode() with the text that the ids spell; null ids spell the empty text.

    The mark U+2581 stands for a space in this format, so a text that has the mark itself comes back with spaces.
    """
    return encoded.select("doc_id", "text_sha256", "ids").mapInArrow(decoding(model_path or default_model()), DECODED)


def encode_and_decode(docs: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """decode(encode(docs)) in one Python worker a task, so that an executor holds half as many encoders."""
    path = model_path or default_model()
    ahead, back = encoding(path), decoding(path)
    return digested(docs, id_col, text_col).mapInArrow(lambda batches: back(ahead(batches)), DECODED)


def op3_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_and_decode(documents(spark, sf_dir))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_xxhash64"), F.sha2("text", 256).alias("decoded_sha256"), (F.sha2("text", 256) == F.col("text_sha256")).alias("round_trip"))
