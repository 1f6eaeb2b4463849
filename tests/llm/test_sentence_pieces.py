import public_tokenizers
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from tideline.llm import sentence_pieces
from tideline.llm.common import kept
from tideline.llm.sentence_pieces import Encoder, decode, encode, encode_and_decode, encoder_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")


def viterbi_of_the_library():
    """The library's own lattice search over the same pieces and scores."""
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=model.SerializeToString())


def score(ids, library):
    return sum(library.get_score(i) for i in ids)


def test_ids_are_the_librarys(texts):
    library, encoder = viterbi_of_the_library(), Encoder(MODEL)
    for text in [*list(texts.values())[:80], "", " ", "a", "  two  spaces ", "tab\tand\nline", "日本 é é ①", "x" * 700, "the" * 20_000 + "日本" * 9_000]:
        got = list(memoryview(encoder.encode([text])[0]).cast("i"))
        want = library.encode(text)
        assert got == want or score(got, library) >= score(want, library), text[:80]  # the library adds in 32 bits


def test_stretches_of_a_long_word_join(monkeypatch):
    whole = Encoder(MODEL).encode(["understanding" * 40, "日本語" * 30 + "xyz"])
    monkeypatch.setattr(sentence_pieces, "STRETCH", 7)
    assert Encoder(MODEL).encode(["understanding" * 40, "日本語" * 30 + "xyz"]) == whole


def test_models_that_change_texts_are_refused(tmp_path):
    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(open(MODEL, "rb").read())
    model.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        Encoder(str(tmp_path / "m.model"))


def test_texts_come_back(docs, odd, none):
    for df in (docs, odd, none):
        rows = sorted((str(r.doc_id), r.text or "") for r in df.select("doc_id", "text").collect())
        got = sorted((str(r.doc_id), r.text) for r in decode(encode(df)).collect())
        assert got == [(d, t.replace("▁", " ")) for d, t in rows]


def test_both_ways_at_once_and_null_ids(spark, docs, odd, none):
    rows = lambda df: sorted(map(str, df.collect()))
    for df in (docs, odd, none):
        found = encode_and_decode(df)
        assert str(found._jdf.queryExecution().executedPlan()).count("MapInArrow") == 1
        assert rows(found) == rows(decode(encode(df)))
    some = spark.createDataFrame([(1, "x", None), (2, "y", [5, 6]), (3, "z", []), (4, "w", [7])], "doc_id long, text_sha256 string, ids array<int>").coalesce(1)
    pieces = Encoder(MODEL).pieces
    assert [r.text for r in decode(some).orderBy("doc_id").collect()] == ["", pieces.text([5, 6]), "", pieces.text([7])]


def test_another_operator_drops_the_words():
    encoder = encoder_of(MODEL)
    assert encoder_of(MODEL) is encoder
    kept("quality")
    assert encoder_of(MODEL) is not encoder
