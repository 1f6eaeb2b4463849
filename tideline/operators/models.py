"""Estimators over the long matrix: folds and models run side by side, rows of one small fold together."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import ridge

PARTS = "array<struct<product_name:string,centre:double,scale:double,weight:double>>"
FITTED = f"month string, model_key string, status string, estimate_mom_pct double, actual_mom_pct double, n_train long, training_end string, penalty double, least_history long, window long, bias double, parts {PARTS}"


def wide_rows(matrix_long: DataFrame) -> DataFrame:
    """One row a month: its products with value and group, its target and both times."""
    cell = F.struct("product_name", "sector", "value")
    return matrix_long.groupBy("month", "actual_mom_pct", "actual_published_at", "cutoff").agg(F.array_sort(F.collect_list(cell)).alias("cells"))


def fit_origins(rows: DataFrame, origins: DataFrame, model: str = "product_ridge", stable: bool = False, windows: tuple = (None,), least: int = 24) -> DataFrame:
    """One row an origin month: the model chosen and fitted on the months that were public at its cutoff, and its estimate.

    rows: wide_rows(). origins: month, train_month (eligible_origins()). An origin's group holds one row a month, so it
    is bounded by the calendar, and groups run side by side. status: fitted, or why there is no model. Models:
    product_ridge (columns are products), sector_first (means of each sector's products), benchmark_ridge (medians,
    indicators and leave-one-out choice; needs no inner folds), strength_ridge (medians, indicators, and a penalty chosen
    on the inner folds).
    """
    itself = origins.select("month").distinct().withColumn("train_month", F.col("month"))
    joined = origins.select("month", "train_month").unionByName(itself).join(rows.withColumnRenamed("month", "train_month"), "train_month")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("train_month")
        month = frame["month"].iloc[0]
        names, x = panel_of(frame["cells"], model == "sector_first")
        y = frame["actual_mom_pct"].to_numpy(float)
        train, now = np.flatnonzero(frame["train_month"] < month), np.flatnonzero(frame["train_month"] == month)
        row = {"month": month, "model_key": model, "status": "short_history", "actual_mom_pct": y[now][0], "n_train": len(train), "training_end": frame["train_month"].iloc[train[-1]] if len(train) else None, "parts": []}
        if len(train) >= least:
            try:
                row |= {"status": "fitted"} | fitted(names, x, y, train, now, frame)
            except ValueError as reason:
                row["status"] = str(reason)
        kinds = {"double": float, "long": "Int64"}
        return pd.DataFrame({c.split()[0]: pd.Series([row.get(c.split()[0])], dtype=kinds.get(c.split()[1], object)) for c in FITTED.split(", ")})

    def fitted(names, x, y, train, now, frame) -> dict:
        if model == "benchmark_ridge":
            found, penalty = ridge.fit_leave_one_out(x[train], y[train])
            return {"estimate_mom_pct": float(found(ridge.with_indicators(x[now], x[train]))[0]), "penalty": penalty, "bias": found.bias}
        public, cutoff = (frame[c].to_numpy("datetime64[ns]") for c in ("actual_published_at", "cutoff"))
        if model == "strength_ridge":
            penalty = ridge.choose_strength(x[train], y[train], public[train], cutoff[train])
            found = ridge.fit_filled(x[train], y[train], penalty)
            return {"estimate_mom_pct": float(found(ridge.with_indicators(x[now], x[train]))[0]), "penalty": penalty, "bias": found.bias}
        best = ridge.choose(x[train], y[train], public[train], cutoff[train], stable, windows)
        rows = train[-best.window :] if best.window else train
        found = ridge.fit(x[rows], y[rows], best.penalty, best.least, stable)
        parts = [{"product_name": names[k], "centre": float(c), "scale": float(s), "weight": float(w)} for k, c, s, w in zip(found.use, found.centre, found.scale, found.weight)]
        return {"estimate_mom_pct": float(found(x[now])[0]), "penalty": best.penalty, "least_history": best.least, "window": best.window, "bias": found.bias, "parts": parts}

    return joined.groupBy("month").applyInPandas(run, FITTED)


def panel_of(cells, by_sector: bool = False) -> tuple[list[str], np.ndarray]:
    """(names, months x names) of the months' cells, missing ones as NaN; by sector the means of its products."""
    key = "sector" if by_sector else "product_name"
    frame = pd.DataFrame([(k, c[key], c["value"]) for k, month in enumerate(cells) for c in month], columns=["k", "name", "value"])
    table = frame.pivot_table(index="k", columns="name", values="value", dropna=False).reindex(range(len(cells)))
    return list(table.columns), table.to_numpy(float)


def direct_tracker(values: DataFrame, origins: DataFrame, least: int = 24) -> DataFrame:
    """The geometric mean change of the origin's own month; nothing is fitted, but origins need as much history."""
    known = origins.groupBy("month").agg(F.count("*").alias("n_train"), F.max("train_month").alias("training_end")).where(F.col("n_train") >= least)
    return values.groupBy("month").agg((100 * F.expm1(F.avg("value") / 100)).alias("estimate_mom_pct")).join(known, "month")


def coefficients(fitted: DataFrame) -> DataFrame:
    """(month, product_name, centre, scale, weight) of fitted origins."""
    return fitted.select("month", F.explode("parts").alias("p")).select("month", "p.*")


def compared_fits(old: DataFrame, new: DataFrame) -> DataFrame:
    """Two ways of fitting, on the months that both could predict: errors side by side."""
    side = lambda df, name: df.where("status = 'fitted'").select("month", (F.col("estimate_mom_pct") - F.col("actual_mom_pct")).alias(name))
    return side(old, "old_error").join(side(new, "new_error"), "month")


def wide(matrix_long: DataFrame, products: list[str]) -> DataFrame:
    """One column a product, and an indicator where it is missing; products come from the catalog, so no pivot scan."""
    cells = [F.max(F.when(F.col("product_name") == p, F.col("value"))).alias(f"price__{p}") for p in products]
    rows = matrix_long.groupBy("month").agg(F.first("actual_mom_pct").alias("label"), *cells)
    for p in products:
        c = f"price__{p}"
        rows = rows.withColumn(f"missing__{p}", F.col(f"`{c}`").isNull().cast("double")).withColumn(c, F.coalesce(F.col(f"`{c}`"), F.lit(0.0)))
    return rows


def estimators(rows: int, label_sd: float, alpha: float = 25.0) -> dict[str, object]:
    """Spark ML estimators; regParam makes the ridge that of alpha on the sum of squares."""
    common = {"featuresCol": "features", "labelCol": "label", "seed": 7}
    return {
        "ridge": LinearRegression(featuresCol="features", labelCol="label", regParam=alpha * label_sd / max(rows, 1), elasticNetParam=0.0, standardization=False, solver="normal"),
        "boosting": GBTRegressor(maxIter=40, maxDepth=2, stepSize=0.1, **common),
        "forest": RandomForestRegressor(numTrees=50, maxDepth=4, **common),
    }


def fit_predict(train: DataFrame, test: DataFrame, features: list[str], model: str) -> DataFrame:
    assemble = VectorAssembler(inputCols=features, outputCol="features")
    train = assemble.transform(train)
    stats = train.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("sd")).first()
    fitted = estimators(stats["n"], stats["sd"] or 1.0)[model].fit(train)
    return fitted.transform(assemble.transform(test)).select("month", F.lit(model).alias("model_key"), F.col("prediction").alias("estimate_mom_pct"), F.col("label").alias("actual_mom_pct"))


def hybrid(a: DataFrame, b: DataFrame) -> DataFrame:
    """Equal mean of two models' predictions."""
    other = b.select("month", F.col("estimate_mom_pct").alias("other"))
    return a.join(other, "month").select("month", F.lit("hybrid").alias("model_key"), ((F.col("estimate_mom_pct") + F.col("other")) / 2).alias("estimate_mom_pct"), "actual_mom_pct")


def block_bootstrap(pairs: DataFrame, length: int = 3, draws: int = 1000, seed: int = 7) -> DataFrame:
    """Circular block bootstrap of the mean loss difference of each pair of models: exact 2.5 and 97.5 per cent bounds.

    pairs: model_a, model_b, target_month, d (with six places). Where a block starts follows from a digest of seed, pair, draw and block, so that any
    engine draws the same. Differences are whole millionths, whose sums do not depend on their order. Blocks are summed
    once for every start (a modular index join of months with their successors); a draw only looks sums up, and its last
    block is cut so that it has as many months as the pair.
    """
    keys = ["model_a", "model_b"]
    line = Window.partitionBy(*keys).orderBy("target_month")
    millionths = F.round(F.col("d") * 1_000_000).cast("long")
    held = pairs.select(*keys, millionths.alias("v"), (F.row_number().over(line) - 1).alias("r"), F.count("*").over(Window.partitionBy(*keys)).alias("n"))
    blocks = F.ceil(F.col("n") / length)
    spread = held.select(*keys, "n", "v", "r", (F.col("n") - (blocks - 1) * length).alias("rest"), F.explode(F.sequence(F.lit(0), F.lit(length - 1))).alias("j"))
    sums = spread.groupBy(*keys, F.pmod(F.col("r") - F.col("j"), F.col("n")).alias("start")).agg(F.sum("v").alias("whole"), F.sum(F.when(F.col("j") < F.col("rest"), F.col("v"))).alias("cut"))
    size = held.groupBy(*keys).agg(F.max("n").alias("n"), (F.sum("v") / F.count("*") / 1_000_000).alias("mean_difference"))
    drawn = size.select(*keys, "n", blocks.alias("blocks"), F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    drawn = drawn.select(*keys, "n", "blocks", "draw", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))).alias("block"))
    number = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), *keys, "draw", "block")), 1, 8), 16, 10).cast("long")
    drawn = drawn.withColumn("start", F.pmod(number, F.col("n"))).join(sums, [*keys, "start"])
    taken = F.when(F.col("block") == F.col("blocks") - 1, F.col("cut")).otherwise(F.col("whole"))
    means = drawn.groupBy(*keys, "draw").agg((F.sum(taken) / F.max("n") / 1_000_000).alias("mean"))
    bounds = means.groupBy(*keys).agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("p"))
    return size.join(bounds, keys).select(*keys, "n", "mean_difference", F.col("p")[0].alias("low"), F.col("p")[1].alias("high"))
