"""A pipeline of corpus operators: good documents, without copies, near copies and benchmark passages, as piece ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import Scratch
from tideline.llm.decontaminate import drop_contaminated
from tideline.llm.exact_dedup import drop_copies
from tideline.llm.jaccard_join import one_of_each_class
from tideline.llm.quality import keep_good
from tideline.llm.sentence_pieces import encode_and_decode


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return drop_copies(docs)


def distinct_classes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return one_of_each_class(docs)


def clean_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by the benchmark."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_pieces, and whether the ids spell the text."""
    found = encode_and_decode(docs)
    return found.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), (F.sha2("text", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [("quality", good_documents), ("exact_dedup", distinct_texts), ("jaccard_join", distinct_classes), ("decontaminate", clean_documents), ("sentence_pieces", piece_ids)]
ORACLE_SQL = None  # the classifier, the similarity join and the piece search are beyond SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
