import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, rid string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and long texts, ties, repeated rows, and extra columns with names used inside."""
    long = " ".join(f"word{k % 977} and" for k in range(20_000))
    rows = [(1, "same text here now then again", "en", "a", 1, "x", "y"), (2, "same  text here now\nthen again", None, "a", None, None, None), (2, "same  text here now\nthen again", None, "a", None, None, None),
            (3, None, "en", None, 0, "x", None), (4, "", "en", "b", 0, None, None), (None, "a null id", "en", "b", 9, None, None), (None, "a null id", "en", "b", 9, None, None), (5, long, "de", "c", 1, None, None), (6, long + " end", "de", "c", 1, None, None), (7, " \t\n", None, None, None, None, None), (8, "x" * 3000, "en", "c", 1, None, None), (9, "É ▁ \x00 <|endoftext|>  two spaces ", "fr", "a", 1, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}
