import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tideline.llm.common import Scratch
from tideline.llm.token_blocks import BLOCK, BlockReader, BlockWriter, WordEncoder, op2_token_blocks, pack_block, read_tokens, token_digests, unpack_block, write_tokens

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def plain():
    return Tokenizer.from_file(TOKENIZER)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 60), min_size=1, max_size=300))
def test_blocks_round_trip(ids):
    values = np.array(ids, np.uint32)
    assert (unpack_block(pack_block(values)) == values).all()


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from(" \t\n \x1cab1,.'É") | st.characters(codec="utf-8"), max_size=60))
def test_words_put_together_are_the_text(text):
    encoder = test_words_put_together_are_the_text.__dict__.setdefault("encoder", WordEncoder(TOKENIZER))
    assert np.frombuffer(encoder.encode([text])[0], "<u4").tolist() == plain_encoder.encode(text, add_special_tokens=False).ids


plain_encoder = plain()


def test_an_added_token_in_a_text_is_that_token():
    encoder = WordEncoder(TOKENIZER)
    for text in ("hello <|endoftext|> x", "<|endoftext|>", "a<|endoftext|>b c", "x\n<|endoftext|>\ny", "<|endoftext|", "again <|endoftext|"):
        assert np.frombuffer(encoder.encode([text, "hello x"])[0], "<u4").tolist() == plain_encoder.encode(text, add_special_tokens=False).ids


def test_ranges_of_a_file():
    out = pa.BufferOutputStream()
    writer, rng = BlockWriter(out), np.random.default_rng(1)
    docs = [rng.integers(0, 50_000, n).astype(np.uint32) for n in (0, 1, 5, BLOCK, 70 * BLOCK + 3, 17)]
    for k, ids in enumerate(docs):
        writer.add(None if k == 2 else k, ids.tobytes())
    writer.close()
    reader, whole = BlockReader(pa.BufferReader(out.getvalue())), np.concatenate(docs)
    assert [d for d, _, _ in reader.documents()] == [0, 1, None, 3, 4, 5]
    assert all((a == b).all() for a, (_, _, b) in zip(docs, reader.documents()))
    for start, n in ((0, 0), (3, 9), (BLOCK - 1, 2), (40 * BLOCK + 7, 9 * BLOCK)):
        assert (reader.ids(start, n) == whole[start : start + n]).all()


def test_files_hold_what_the_tokenizer_gives(spark, docs, odd, none):
    for df in (docs, odd, none):
        scratch = Scratch(spark, "test")
        manifest = scratch.table(write_tokens(df, scratch.path("files")), "manifest")
        rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in df.select("doc_id", "text").collect()), key=lambda r: r[:2])
        got = sorted(read_tokens(manifest).collect(), key=lambda r: r.start)
        want = sorted((r[1], [*plain_encoder.encode(r[2], add_special_tokens=False).ids, 2]) for r in rows)
        assert sorted((r.doc_id or 0, list(r.ids)) for r in got) == want
        assert [r.doc_id or 0 for r in got] == [r[1] for r in rows]
        starts = np.cumsum([0, *(len(r.ids) for r in got)])
        assert [r.start for r in got] == starts[:-1].tolist()
        digests = {(r.doc_id or 0, r.start, r.n_tokens, r.ids_crc32) for r in token_digests(manifest).collect()}
        assert digests == {(r.doc_id or 0, r.start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes())) for r in got}


def test_query_columns(spark, small, texts):
    got = op2_token_blocks(spark, small).orderBy("doc_id").collect()
    start = 0
    for r in got:
        ids = [*plain_encoder.encode(texts[r.doc_id], add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert [r.doc_id for r in got] == sorted(texts)
