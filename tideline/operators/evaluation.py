"""Training matrices, folds, baselines and forecast evaluation without leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.releases import month_number, regime


def feature_cutoffs(obs: DataFrame, variant: str = "twentieth", last: bool = False) -> DataFrame:
    """Per month, when its features were complete: the publication time of its second window, of its first for the early
    variants; of several snapshots the first time, or the last."""
    ord = 1 if variant.startswith("early") else 2
    return obs.where(F.col("ord") == ord).groupBy(F.col("release_month").alias("month")).agg((F.max if last else F.min)("published_at").alias("cutoff"))


def training_matrix(values: DataFrame, cutoffs: DataFrame, actuals: DataFrame, months: DataFrame) -> DataFrame:
    """One row a month of `months`: its target, cutoff and number of values, and the reason why it is left out.

    Reasons: no_release, no_actual, actual_already_public, no_comparable (no product has a price change).
    """
    counts = values.where("part = 'price'").groupBy("month").agg(F.count("value").alias("n_values"))
    months = months.join(counts, "month", "left").withColumn("n_values", F.coalesce("n_values", F.lit(0)))
    labelled = months.join(cutoffs, "month", "left").join(actuals.select(F.col("target_month").alias("month"), "actual_mom_pct", F.col("published_at").alias("actual_published_at")), "month", "left")
    reason = F.when(F.col("cutoff").isNull(), "no_release").when(F.col("actual_mom_pct").isNull(), "no_actual").when(F.col("actual_published_at") <= F.col("cutoff"), "actual_already_public").when(F.col("n_values") == 0, "no_comparable")
    return labelled.withColumn("reason", reason)


def eligible_origins(matrix: DataFrame) -> DataFrame:
    """For each origin month the training months whose actual was public at its cutoff: a range self-join of months."""
    used = matrix.where("reason is null")
    train = used.select(F.col("month").alias("train_month"), F.col("actual_published_at").alias("train_public"), F.col("actual_mom_pct").alias("y"))
    origin = used.select("month", "cutoff")
    return origin.join(train, (F.col("train_month") < F.col("month")) & (F.col("train_public") < F.col("cutoff")))


def fold_table(matrix: DataFrame, most: int = 5) -> DataFrame:
    """Expanding time-series folds: min(5, max(2, n // 6)) test blocks of n // (folds + 1) months at the end."""
    used = matrix.where("reason is null")
    counted = used.select("month", F.row_number().over(Window.orderBy("month")).alias("r"), F.count("*").over(Window.partitionBy()).alias("n"))
    folds = counted.withColumn("k", F.least(F.lit(most), F.greatest(F.lit(2), F.floor(F.col("n") / 6)))).withColumn("size", F.floor(F.col("n") / (F.col("k") + 1)))
    each = folds.select("*", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("fold"))
    end = F.col("n") - (F.col("k") - F.col("fold")) * F.col("size")
    part = F.when(F.col("r") <= end - F.col("size"), "train").when(F.col("r") <= end, "test")
    return each.withColumn("part", part).where("part is not null").groupBy("fold", "part").agg(F.count("*").alias("months"), F.min("month").alias("first"), F.max("month").alias("last"))


def baselines(matrix: DataFrame) -> DataFrame:
    """No change, last released value, and mean of released values, from each origin's own eligible months.

    Rates have six places; their sum is rounded to six, so that the mean does not depend on the order of addition.
    """
    pairs = eligible_origins(matrix)
    known = pairs.groupBy("month").agg((F.round(F.sum("y"), 6) / F.count("*")).alias("expanding_mean"), F.max_by("y", "train_month").alias("persistence"), F.count("*").alias("history"))
    return matrix.where("reason is null").join(known, "month").select("month", "actual_mom_pct", F.lit(0.0).alias("no_change"), "persistence", "expanding_mean", "history")


def scored(forecasts: DataFrame) -> DataFrame:
    error = F.col("estimate_mom_pct") - F.col("actual_mom_pct")
    return forecasts.withColumn("error", error).withColumn("right_way", (F.signum("estimate_mom_pct") == F.signum("actual_mom_pct")).cast("double"))


def metric_columns() -> list[Column]:
    return [F.count("*").alias("n"), F.avg(F.abs("error")).alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"), F.avg("error").alias("bias"), F.avg("right_way").alias("direction")]


def error_summary(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(*metric_columns())


def metric_bundle(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.groupBy(*keys).agg(*metric_columns(), F.median(F.abs("error")).alias("median_ae"), F.max(F.abs("error")).alias("max_ae"))


def rolling_evaluation(scores: DataFrame, keys: list[str], spans: tuple[int, ...] = (6, 12, 24)) -> DataFrame:
    """Metrics over the last 6, 12 and 24 calendar months of each key, and over all (0)."""
    number = month_number(F.col("target_month"))
    ranked = scores.withColumn("m", number).withColumn("last", F.max(number).over(Window.partitionBy(*keys)))
    spanned = ranked.withColumn("months", F.explode(F.array(*map(F.lit, (*spans, 0)))))
    return spanned.where((F.col("months") == 0) | (F.col("m") > F.col("last") - F.col("months"))).groupBy(*keys, "months").agg(*metric_columns())


def regime_metrics(scores: DataFrame, keys: list[str]) -> DataFrame:
    return scores.withColumn("regime", regime(F.col("actual_mom_pct"))).groupBy(*keys, "regime").agg(*metric_columns())


def paired_losses(scores: DataFrame, least: int = 6) -> DataFrame:
    """Mean difference of absolute errors of each pair of models over their common months.

    Pairs are made inside a month's array of models (a handful), not by joining the table to itself.
    """
    months = scores.groupBy("target_month").agg(F.array_sort(F.collect_list(F.struct("model_key", F.abs("error").alias("loss")))).alias("x"))
    first = months.select("target_month", "x", F.posexplode("x").alias("k", "a"))
    pairs = first.select(F.col("a.model_key").alias("model_a"), F.col("a.loss").alias("la"), F.explode(F.slice("x", F.col("k") + 2, F.size("x"))).alias("b"))
    pairs = pairs.select("model_a", F.col("b.model_key").alias("model_b"), (F.col("la") - F.col("b.loss")).alias("d"))
    return pairs.groupBy("model_a", "model_b").agg(F.count("*").alias("n"), F.avg("d").alias("mean_difference"), F.avg((F.col("d") < 0).cast("double")).alias("win_rate")).where(F.col("n") >= least)


def model_range(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    return forecasts.groupBy(*keys).agg(F.median("estimate_mom_pct").alias("median"), F.min("estimate_mom_pct").alias("low"), F.max("estimate_mom_pct").alias("high"), F.count("*").alias("n_models"))


def panel_gap(forecasts: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """One model's estimate less another's, by conditional aggregation."""
    of = lambda m: F.max(F.when(F.col("model_key") == m, F.col("estimate_mom_pct")))
    return forecasts.groupBy(*keys).agg(of(a).alias("a"), of(b).alias("b")).where("a is not null and b is not null").withColumn("gap", F.col("a") - F.col("b"))


def out_of_range(values: DataFrame, split_month: str, least: int = 12) -> DataFrame:
    """Per later month, how many values lie outside the range of the product's earlier ones, or have a short history."""
    past = values.where((F.col("month") < split_month) & F.col("value").isNotNull()).groupBy("product_name").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("*").alias("history"))
    now = values.where((F.col("month") >= split_month) & F.col("value").isNotNull())
    joined = now.join(past, "product_name", "left")
    return joined.groupBy("month").agg(F.count_if((F.col("value") < F.col("lo")) | (F.col("value") > F.col("hi"))).alias("outside"), F.count_if(F.coalesce("history", F.lit(0)) < least).alias("short_history"), F.count("*").alias("n_values"))


def attributions(values: DataFrame, coefficients: DataFrame) -> DataFrame:
    """Each product's standardised value times its fitted coefficient, of the model that was fitted for that month.

    coefficients: month, product_name, centre, scale, weight. A missing value contributes nothing.
    """
    held = values.join(coefficients, ["month", "product_name"])
    return held.withColumn("contribution", F.coalesce((F.col("value") - F.col("centre")) / F.col("scale"), F.lit(0.0)) * F.col("weight"))


def top_k(contributions: DataFrame, keys: list[str], k: int) -> DataFrame:
    line = Window.partitionBy(*keys).orderBy(F.round(F.abs("contribution"), 9).desc(), "product_name")
    return contributions.withColumn("rank", F.row_number().over(line).cast("long")).where(F.col("rank") <= k)


def newest_months(origins: DataFrame, n: int) -> DataFrame:
    """The newest n training months of each origin."""
    line = Window.partitionBy("month").orderBy(F.col("train_month").desc())
    return origins.withColumn("_r", F.row_number().over(line)).where(F.col("_r") <= n).drop("_r")


def simple_baselines(actuals: DataFrame, least: int = 12) -> DataFrame:
    """Per month after the first `least`: no change, the month before, and the mean of all before, whatever was released."""
    line = Window.orderBy("target_month")  # one row a month
    before = line.rowsBetween(Window.unboundedPreceding, -1)
    held = actuals.select("target_month", "actual_mom_pct", F.row_number().over(line).alias("r"), F.lag("actual_mom_pct").over(line).alias("persistence"), (F.round(F.sum("actual_mom_pct").over(before), 6) / F.count("*").over(before)).alias("expanding_mean"))
    return held.where(F.col("r") > least).select("target_month", "actual_mom_pct", F.lit(0.0).alias("no_change"), "persistence", "expanding_mean")
