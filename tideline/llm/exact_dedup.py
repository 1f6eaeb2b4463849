"""Exact deduplication by a 128-bit content hash, with a byte comparison inside every hash group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, documents, heavy_join, text_rows

WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(text, WHITE, "")


def content_hash(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_of=content_hash) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256, n_chars.

    Texts are equal when identical after white space (ASCII) is deleted. The longest original stays, then the
    smallest doc_id; a null doc_id comes after all others. Of repeated rows with one id and text exactly one is kept.
    A null text counts as empty, and all empty texts are equal. An empty table gives an empty result.

    Rows meet by hash only as (hash, length, id); whole texts are grouped once, by (hash, text) with map-side
    combining, so that a hot text leaves each map task as one row; the slim rows of a hot text take their group's by broadcast. A hash with more than one text is split by the
    bytes themselves.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "exact-dedup")
    rows = text_rows(docs, id_col, text_col).select("doc_id", F.length("text").alias("n"), normalised(F.col("text")).alias("norm"))
    rows = rows.withColumn("h", hash_of(F.col("norm")))
    meta = scratch.table(rows.select("doc_id", "n", "h", F.sha2("norm", 256).alias("sha"), F.monotonically_increasing_id().alias("rid")), "rows")
    mixed = scratch.table(rows.groupBy("h", "norm").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"), "mixed")
    meta = meta.withColumn("part", F.lit("").cast("binary"))
    if not mixed.isEmpty():
        # One hash, several texts: number the texts of those hashes by their bytes.
        texts = rows.join(mixed, "h", "left_semi").groupBy("h", "norm", F.sha2("norm", 256).alias("sha")).agg(F.count("*").alias("c"))
        parts = scratch.table(texts.select("h", "sha", F.encode("norm", "UTF-8").alias("split")), "parts")
        meta = meta.join(parts, ["h", "sha"], "left").withColumn("part", F.coalesce("split", "part")).drop("split")
    best = F.min(F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    groups = scratch.table(meta.groupBy("h", "part").agg(F.count("*").alias("group_size"), best.alias("best")), "groups")
    groups = groups.select("h", "part", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.rid").alias("keep_rid"))
    return heavy_join(meta, groups, ["h", "part"], scratch).select(
        "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"), F.col("n").cast("long").alias("n_chars")
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input without the copies that exact_dedup() drops; columns stay as they are."""
    keys = [F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_tl_id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("_tl_text")]
    names = docs.columns
    found = exact_dedup(docs.select(id_col, text_col), id_col, text_col).where("kept")
    wanted = found.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_tl_id"), F.col("text_sha256").alias("_tl_sha"), F.col("n_chars").alias("_tl_n"))
    held = docs.select(*names, keys[0], F.sha2(normalised(F.coalesce(F.col(text_col), F.lit(""))), 256).alias("_tl_sha"), F.length(F.coalesce(F.col(text_col), F.lit(""))).cast("long").alias("_tl_n"))
    on = ["_tl_id", "_tl_sha", "_tl_n"]
    # Rows that share id, text and length are repeats of one row: one of them stays; the join has dealt them together.
    return held.join(wanted, on).dropDuplicates(on).select(*names)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("n_chars")


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
r AS (SELECT doc_id, norm, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w AS k
      FROM t WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, k = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""
