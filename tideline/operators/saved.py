"""Coefficient tables as saved models: fitting by aggregation, predicting, trials and stress tests by joins with the table."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import ridge
from tideline.operators.features import masked
from tideline.operators.models import panel_of

#: A saved model: one row a version, model and product; the bias is the same in all of them.
TABLE = "version string, model_key string, product_name string, centre double, scale double, weight double, bias double, n_train long"
TOLERANCE = 1e-10  # between a stored forecast and what its saved model gives again


def marginal_models(long: DataFrame, training: DataFrame, models: dict[str, float], least: int = 12) -> DataFrame:
    """TABLE of the mean of single-product ridge regressions, fitted in one aggregation for all versions and penalties.

    long: month, product_name, value, actual_mom_pct. training: version, month. models: a penalty by model_key. Products
    with fewer than `least` values take no part; values are scaled by their own mean and population deviation, 1 at least.
    """
    held = training.join(long.where("value is not null"), "month")
    n, spread = F.count("*"), F.stddev_pop("value")
    fitted = held.groupBy("version", "product_name").agg(n.alias("n"), F.avg("value").alias("centre"), F.greatest(spread, F.lit(ridge.LEAST_SCALE)).alias("scale"), F.covar_pop("value", "actual_mom_pct").alias("both"), F.var_pop("value").alias("own"))
    level = training.join(long.select("month", "actual_mom_pct").distinct(), "month").groupBy("version").agg(F.avg("actual_mom_pct").alias("bias"), F.count("*").alias("n_train"))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("model_key"), F.lit(float(p)).alias("penalty")) for k, p in models.items())))
    fitted = fitted.where(F.col("n") >= least).withColumn("products", F.count("*").over(Window.partitionBy("version"))).select("*", kinds.alias("m"))
    weight = (F.col("n") * F.col("both") / F.col("scale")) / (F.col("n") * F.col("own") / F.pow("scale", F.lit(2)) + F.col("m.penalty")) / F.col("products")
    return fitted.withColumn("weight", weight).join(level, "version").select("version", "m.model_key", "product_name", "centre", "scale", "weight", "bias", "n_train")


def ridge_models(long: DataFrame, training: DataFrame, penalty: float = 100.0, least: int = 2) -> DataFrame:
    """TABLE of one ridge over all products a version; a group holds one row a month."""
    cells = long.groupBy("month", "actual_mom_pct").agg(F.array_sort(F.collect_list(F.struct("product_name", "sector", "value"))).alias("cells"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("month")
        names, x = panel_of(frame["cells"])
        found = ridge.fit(x, frame["actual_mom_pct"].to_numpy(float), penalty, least)
        table = pd.DataFrame({"product_name": [names[k] for k in found.use], "centre": found.centre, "scale": found.scale, "weight": found.weight})
        return table.assign(version=frame["version"].iloc[0], model_key="ridge", bias=found.bias, n_train=len(frame))[[c.split()[0] for c in TABLE.split(", ")]]

    return training.join(cells, "month").groupBy("version").applyInPandas(run, TABLE)


def contribution(value: Column) -> Column:
    """A product's part in an estimate; a missing value counts as the centre."""
    return F.coalesce((value - F.col("centre")) / F.col("scale"), F.lit(0.0)) * F.col("weight")


def frozen_features(long: DataFrame) -> DataFrame:
    """(month, feature_hash): a digest over each month's products and values in millionths."""
    part = F.concat_ws(":", "product_name", F.coalesce(F.round(F.col("value") * 1_000_000).cast("long").cast("string"), F.lit("-")))
    return long.groupBy("month").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(part)), ","), 256).alias("feature_hash"))


def predictions(wanted: DataFrame, table: DataFrame, features: DataFrame) -> DataFrame:
    """wanted (month, version, model_key, ..) with estimate, from the saved table and the month's values (month, product_name, value).

    A product of the table that the month lacks counts as missing, one that the table lacks is not read. Without its
    version a forecast has no estimate.
    """
    keys = ["version", "model_key"]
    parts = wanted.select("month", *keys).distinct().join(table, keys).join(features.select("month", "product_name", "value"), ["month", "product_name"], "left")
    sums = parts.groupBy("month", *keys).agg((F.max("bias") + F.sum(contribution(F.col("value")))).alias("estimate"))
    return wanted.join(sums, ["month", *keys], "left")


def newest_version(months: DataFrame, versions: DataFrame) -> DataFrame:
    """Each month with the last version that was fitted by then (an as-of join of calendars)."""
    return months.join(versions, F.col("version") <= F.col("month")).groupBy("month").agg(F.max("version").alias("version"))


def matched_forecasts(features: DataFrame, table: DataFrame, champion: DataFrame, challenger: DataFrame) -> DataFrame:
    """(month, feature_hash, role, version, model_key, estimate, groups_agree): both models' forecasts from the same frozen features.

    champion, challenger: month, version, model_key. Only months that both can predict are forecast. groups_agree: the
    sectors' contributions and the bias add up to the estimate within 2e-5.
    """
    role = lambda df, name: df.select("month", "version", "model_key", F.lit(name).alias("role"))
    wanted = role(champion, "champion").unionByName(role(challenger, "challenger"))
    made = predictions(wanted, table, features).where("estimate is not null")
    both = made.groupBy("month").agg(F.count("*").alias("n")).where("n = 2").select("month")
    parts = made.join(table, ["version", "model_key"]).join(features.select("month", "product_name", "sector", "value"), ["month", "product_name"], "left")
    groups = parts.groupBy("month", "role", "sector").agg(F.sum(contribution(F.col("value"))).alias("part"), F.max("bias").alias("bias"))
    sums = groups.groupBy("month", "role").agg((F.max("bias") + F.sum("part")).alias("again"))
    held = made.join(both, "month").join(sums, ["month", "role"]).join(frozen_features(features), "month")
    return held.select("month", "feature_hash", "role", "version", "model_key", "estimate", (F.abs(F.col("estimate") - F.col("again")) <= 2e-5).alias("groups_agree"))


def reprediction_faults(forecasts: DataFrame, table: DataFrame, features: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Stored forecasts that the store does not give again: its features have another digest (features), the saved model is
    gone (version), or model and features give another value (estimate). The check reads the store only."""
    again = predictions(forecasts.withColumnRenamed("estimate", "saved"), table, features).withColumnRenamed("estimate", "again")
    now = frozen_features(features).withColumnRenamed("feature_hash", "hash_now")
    held = again.join(now, "month", "left")
    off = F.coalesce(F.abs(F.col("saved") - F.col("again")) > tolerance, F.lit(True))
    fault = F.when(~F.col("feature_hash").eqNullSafe(F.col("hash_now")), "features").when(F.col("again").isNull(), "version").when(off, "estimate")
    return held.withColumn("fault", fault).where("fault is not null").select("month", "role", "version", "model_key", "saved", "again", "fault")


def score_trial(forecasts: DataFrame, actuals: DataFrame, cutoffs: DataFrame, faults: DataFrame) -> DataFrame:
    """One row a month: both errors and whether the challenger won, of forecasts made before the actual was public.

    forecasts: matched_forecasts() as stored. cutoffs: month, cutoff (when the features were frozen). actuals: month,
    actual_mom_pct, actual_published_at. Months with a forecast in faults are not scored.
    """
    of = lambda name: F.max(F.when(F.col("role") == name, F.col("estimate")))
    sides = forecasts.groupBy("month", "feature_hash").agg(of("champion").alias("champion"), of("challenger").alias("challenger"), F.max(F.when(F.col("role") == "challenger", F.col("version"))).alias("version"))
    held = sides.join(faults.select("month"), "month", "left_anti").join(cutoffs, "month").join(actuals, "month").where("cutoff < actual_published_at")
    error = lambda c: F.col(c) - F.col("actual_mom_pct")
    return held.select("month", "version", error("champion").alias("champion_error"), error("challenger").alias("challenger_error"), (F.abs(error("challenger")) < F.abs(error("champion"))).alias("won"))


def fold_months(matrix: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """(training, tests): version (the fold), month, of expanding time-series folds over the months in use."""
    used = matrix.where("reason is null").select("month")
    line = Window.orderBy("month")  # one row a month
    counted = used.select("month", F.row_number().over(line).alias("r"), F.count("*").over(Window.partitionBy()).alias("n"))
    folds = counted.withColumn("k", F.least(F.lit(most), F.greatest(F.lit(2), F.floor(F.col("n") / 6)))).withColumn("size", F.floor(F.col("n") / (F.col("k") + 1)))
    each = folds.select("month", "r", "n", "k", "size", F.explode(F.sequence(F.lit(1), F.col("k").cast("int"))).alias("fold"))
    end = F.col("n") - (F.col("k") - F.col("fold")) * F.col("size")
    of = lambda rows: each.where(rows).select(F.col("fold").cast("string").alias("version"), "month")
    return of(F.col("r") <= end - F.col("size")), of((F.col("r") > end - F.col("size")) & (F.col("r") <= end))


def stress_metrics(table: DataFrame, tests: DataFrame, long: DataFrame, share: int = 10) -> DataFrame:
    """Per model: out-of-fold errors of the clean rows and of the same rows with one cell in `share` missing, both from the
    same coefficients, and how far the estimates move on average."""
    models = table.select("version", "model_key").distinct()
    wanted = tests.join(models, "version")
    side = lambda rows, name: predictions(wanted, table, rows).withColumnRenamed("estimate", name)
    y = long.select("month", "actual_mom_pct").distinct()
    both = side(long, "clean").join(side(masked(long, share), "stressed"), ["month", "version", "model_key"]).join(y, "month")
    error = lambda c: F.col(c) - F.col("actual_mom_pct")
    numbers = [f(error(c)).alias(f"{c}_{name}") for c in ("clean", "stressed") for name, f in (("mae", lambda e: F.avg(F.abs(e))), ("rmse", lambda e: F.sqrt(F.avg(e * e))), ("bias", F.avg))]
    return both.groupBy("model_key").agg(F.count("*").alias("n"), *numbers, F.avg(F.abs(F.col("stressed") - F.col("clean"))).alias("mean_change"), F.count_if(F.abs(F.col("stressed") - F.col("clean")) > 1e-9).alias("n_moved"))
