"""Release checks as one aggregation: each rule counts its offenders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ("release_month", "ord", "product_name", "price")


def missing_columns(df: DataFrame, required: tuple[str, ...] = REQUIRED) -> list[str]:
    return sorted(set(required) - set(df.columns))


def with_changes(obs: DataFrame) -> DataFrame:
    """Price change against the product's release before, and the rate that was reported (rounded)."""
    line = Window.partitionBy("product_name", "snapshot").orderBy("release_month", "ord")
    changed = obs.withColumn("change", F.col("price") - F.lag("price").over(line))
    return changed.withColumn("reported_pct", F.round(100 * F.col("change") / (F.col("price") - F.col("change")), 1))


def release_validation(obs: DataFrame, minimum_products: int = 40) -> DataFrame:
    """Per release: offenders of each rule, and its status (error, warning or ok)."""
    implied = 100 * F.col("change") / F.nullif(F.col("price") - F.col("change"), F.lit(0.0))
    gap = F.abs(implied - F.col("reported_pct"))
    checks = obs.groupBy("release_month", "ord", "snapshot").agg(
        F.count("*").alias("n_products"), F.count_if(F.col("price").isNull()).alias("not_numeric"), F.count_if(F.col("price") <= 0).alias("not_positive"), F.count_if(F.trim("product_name") == "").alias("blank"),
        (F.count("*") - F.count_distinct("product_name")).alias("duplicates"), F.count_if(gap > 1.0).alias("wrong_change"), F.count_if((gap > 0.25) & (gap <= 1.0)).alias("odd_change"),
    )
    bad = F.col("not_numeric") + F.col("not_positive") + F.col("blank") + F.col("duplicates") + F.col("wrong_change")
    return checks.withColumn("status", F.when(bad > 0, "error").when((F.col("n_products") < minimum_products) | (F.col("odd_change") > 0), "warning").otherwise("ok"))
