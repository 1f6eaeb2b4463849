"""What the models read: their specification table, and the choice of features by prefix and saved order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Key, label, prefixes of the features, vintages; retired models; the order of display.
SPECS = (
    ("gradient_boosting", "Gradient boosting", ("global__", "category__", "product__", "missing__"), ("early", "final")),
    ("economic_ml_hybrid", "Economic + ML hybrid", ("global__", "category__", "econ__"), ("early", "final")),
    ("product_level_ridge", "Product-level ridge", ("product__", "missing__"), ("early", "final")),
    ("sector_first_aggregation", "Sector-first aggregation", ("global__", "category__"), ("early", "final")),
    ("random_forest", "Random forest", ("global__", "category__", "product__", "missing__"), ("early", "final")),
    ("twentieth_to_twentieth_direct", "20th-to-20th direct trimmed index", ("twentieth_product__",), ("final",)),
    ("twentieth_to_twentieth_ridge", "20th-to-20th product ridge", ("twentieth_product__", "twentieth_missing__"), ("final",)),
)
RETIRED = ("category_factor", "category_factor_regression")


def spec_table(spark: SparkSession) -> DataFrame:
    """position, model_key, label, prefixes, vintages of all models."""
    return spark.createDataFrame([(k, *s[:2], list(s[2]), list(s[3])) for k, s in enumerate(SPECS)], "position int, model_key string, label string, prefixes array<string>, vintages array<string>")


def of_vintage(specs: DataFrame, vintage: str) -> DataFrame:
    return specs.where(F.array_contains("vintages", vintage))


def is_active(model: Column) -> Column:
    return ~model.isin(*RETIRED)


def spec_key(*parts: Column | str) -> Column:
    """variant/panel/model, as one string."""
    return F.concat_ws("/", *parts)


def columns_of(features: DataFrame, specs: DataFrame) -> DataFrame:
    """(model_key, feature): the features that a model reads, those that begin with one of its prefixes."""
    prefixes = specs.select("model_key", F.explode("prefixes").alias("prefix"))
    names = features.select("feature").distinct()
    return names.join(F.broadcast(prefixes), names["feature"].startswith(prefixes["prefix"])).select("model_key", "feature").distinct()  # a few prefixes


def in_saved_order(features: DataFrame, saved: DataFrame) -> DataFrame:
    """Every saved feature for each month, in the saved order; one that the month lacks, or that is no number, is null."""
    months = features.select("month").distinct()
    grid = months.join(F.broadcast(saved.select("position", "feature")))  # the names of one model
    held = features.select("month", "feature", F.col("value").try_cast("double").alias("value"))
    return grid.join(held, ["month", "feature"], "left")


def labelled(df: DataFrame, specs: DataFrame, key: str = "model_key") -> DataFrame:
    """With the model's label, or its key where it has none, and its place in the order of display (unknown ones last)."""
    names = specs.select(F.col("model_key").alias(key), "label", "position")
    return df.join(F.broadcast(names), key, "left").withColumn("label", F.coalesce("label", F.col(key))).withColumn("position", F.coalesce("position", F.lit(len(SPECS))))


def bundle_checks(fits: DataFrame, training: DataFrame, specs: DataFrame) -> DataFrame:
    """One row a bundle: the eight checks that its fitted models must pass, and whether all hold.

    fits: bundle, vintage, model_key, n, mae, rmse, bias, direction. training: bundle, cutoff, actual_published_at and
    realtime_status of each training month. Core models are those of every vintage, benchmarks those of the final one
    only. A bundle without training months fails.
    """
    finite = lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False))
    have = fits.groupBy("bundle", "vintage").agg(
        F.collect_set("model_key").alias("have"), F.bool_and(F.coalesce(F.col("n") >= 12, F.lit(False))).alias("enough_predictions"),
        F.bool_and(finite("mae") & finite("rmse") & finite("bias") & finite("direction")).alias("all_metrics_finite"),
    )
    core = F.array_contains("vintages", "early")
    wanted = specs.select("model_key", core.alias("core"), F.explode("vintages").alias("vintage")).groupBy("vintage").agg(
        F.count("*").alias("expected"), F.collect_set(F.when(F.col("core"), F.col("model_key"))).alias("core"), F.collect_set(F.when(~F.col("core"), F.col("model_key"))).alias("benchmarks"),
    )
    rows = training.groupBy("bundle").agg(
        (F.count("*") >= 36).alias("at_least_36_months"), F.bool_and(F.coalesce(F.col("actual_published_at") > F.col("cutoff"), F.lit(False))).alias("publication_precedes_actual"),
        F.bool_and(F.coalesce(F.col("realtime_status") == "pseudo_real_time", F.lit(False))).alias("label_present"),
    )
    held = have.join(wanted, "vintage").join(rows, "bundle", "left")
    checks = {
        "at_least_36_months": F.col("at_least_36_months"), "expected_models_fitted": F.size("have") == F.col("expected"), "core_models_fitted": F.size(F.array_except("core", "have")) == 0,
        "final_benchmarks_fitted": F.size(F.array_except("benchmarks", "have")) == 0, "enough_predictions": F.col("enough_predictions"), "all_metrics_finite": F.col("all_metrics_finite"),
        "publication_precedes_actual": F.col("publication_precedes_actual"), "label_present": F.col("label_present"),
    }
    found = held.select("bundle", *(F.coalesce(c, F.lit(False)).alias(name) for name, c in checks.items()))
    return found.withColumn("validated", F.forall(F.array(*checks), lambda c: c))
