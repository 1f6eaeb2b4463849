"""Tree ensembles of each origin's own months, kept as tables of leaves: growing, prediction and attribution by joins."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.models import panel_of

CONDITION = "feature:string,low:double,high:double,missing:boolean,share:double"
LEAVES = f"month string, model_key string, tree int, leaf int, value double, cover double, conditions array<struct<{CONDITION}>>"
BASE = -1  # the tree whose only leaf holds the level that all others add to
MOST_BINS = 255


@dataclass(frozen=True)
class Growth:
    """How an ensemble grows. drawn: every tree sees a bootstrap sample and their mean is the estimate; else each follows
    the residuals of those before, at the rate."""

    trees: int
    leaves: int
    least: int
    rate: float = 1.0
    depth: int | None = None
    drawn: bool = False


# The settings of the product family.
GROWTHS = {"boosting": Growth(trees=150, leaves=4, least=8, rate=0.04), "forest": Growth(trees=100, leaves=16, least=1, depth=4, drawn=True)}


def binned(x: np.ndarray, most: int = MOST_BINS) -> tuple[np.ndarray, list[np.ndarray]]:
    """(codes, cuts): a column's cuts lie midway between its neighbouring values; a missing value has the code after all bins."""
    cuts = []
    for column in x.T:
        seen = np.unique(column[~np.isnan(column)])
        middle = (seen[:-1] + seen[1:]) / 2
        cuts.append(middle if len(middle) < most else middle[np.linspace(0, len(middle) - 1, most - 1).astype(int)])
    width = max(map(len, cuts), default=0) + 1
    codes = np.column_stack([np.where(np.isnan(c), width, np.searchsorted(k, c, "left")) for c, k in zip(x.T, cuts, strict=True)])
    return codes, cuts


def best_split(codes: np.ndarray, slope: np.ndarray, weight: np.ndarray, rows: np.ndarray, width: int, gaps: np.ndarray, least: int) -> tuple[float, int, int, bool] | None:
    """(gain, column, last bin of the left side, missing goes left) of the greatest gain; of equal ones the first.

    Slopes and weights are summed by (column, bin), and over the bins; a missing value is tried on both sides where the
    training rows have any, else it follows the heavier side.
    """
    columns = codes.shape[1]
    place = (codes[rows] + np.arange(columns) * (width + 1)).ravel()
    sums = [np.bincount(place, np.repeat((v * weight)[rows], columns), columns * (width + 1)).reshape(columns, width + 1) for v in (slope, np.ones_like(slope))]
    g, h = (s[0].sum() for s in sums)
    left = [np.stack([c, c + s[:, width:]], axis=2) for s in sums for c in (np.cumsum(s[:, :width], axis=1),)]
    (gl, hl), (gr, hr) = left, (g - left[0], h - left[1])
    allowed = (hl >= least) & (hr >= least) & (gaps[:, None, None] | (np.arange(2) == 0))
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(allowed, np.round(gl**2 / hl + gr**2 / hr - g**2 / h, 9), -np.inf)
    at = int(np.argmax(gain))
    column, last, side = np.unravel_index(at, gain.shape)
    if not gain.flat[at] > 0:
        return None
    return float(gain.flat[at]), int(column), int(last), bool(side) if gaps[column] else bool(hl.flat[at] > hr.flat[at])


def grow(codes: np.ndarray, cuts: list[np.ndarray], slope: np.ndarray, weight: np.ndarray, how: Growth) -> list[tuple[np.ndarray, dict]]:
    """The leaves of one tree as (rows, conditions): the leaf of greatest gain is split next, until there are enough."""
    width, gaps = max(map(len, cuts), default=0) + 1, (codes == max(map(len, cuts), default=0) + 1).any(axis=0)
    find = lambda rows, depth: None if how.depth == depth else best_split(codes, slope, weight, rows, width, gaps, how.least)
    every = np.flatnonzero(weight > 0)
    held = [(every, {}, 0, find(every, 0))]
    while len(held) < how.leaves:
        k = max(range(len(held)), key=lambda i: held[i][3][0] if held[i][3] else -1.0)
        rows, conditions, depth, split = held[k]
        if not split:
            break
        _, column, last, gap_left = split
        code, cover = codes[rows, column], weight[rows].sum()
        goes = np.where(code == width, gap_left, code <= last)
        cut = float(cuts[column][last]) if last < len(cuts[column]) else np.inf
        low, high, missing, share = conditions.get(column, (-np.inf, np.inf, True, 1.0))
        grown = []
        for side, bounds in ((True, (low, min(high, cut), missing and gap_left)), (False, (max(low, cut), high, missing and not gap_left))):
            part = rows[goes == side]
            grown.append((part, conditions | {column: (*bounds, share * weight[part].sum() / cover)}, depth + 1, find(part, depth + 1)))
        held[k : k + 1] = grown
    return [(rows, conditions) for rows, conditions, *_ in held]


def ensemble(x: np.ndarray, y: np.ndarray, how: Growth, seed: int = 7) -> list[tuple[int, int, float, float, dict]]:
    """(tree, leaf, value, cover, conditions by column): the level first, then each tree's leaves, whose values add up."""
    codes, cuts = binned(x)
    level = 0.0 if how.drawn else float(y.mean())
    out, estimate, rng = [(BASE, 0, level, float(len(y)), {})], np.full(len(y), level), np.random.default_rng(seed)
    for tree in range(how.trees):
        weight = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float) if how.drawn else np.ones(len(y))
        slope = -y if how.drawn else estimate - y
        for leaf, (rows, conditions) in enumerate(grow(codes, cuts, slope, weight, how)):
            cover = float(weight[rows].sum())
            value = -float((slope * weight)[rows].sum()) / cover * (1 / how.trees if how.drawn else how.rate)
            estimate[rows] += value
            out.append((tree, leaf, value, cover, conditions))
    return out


def grow_origins(rows: DataFrame, origins: DataFrame, model: str = "boosting", how: Growth | None = None, least: int = 24) -> DataFrame:
    """The leaves of each origin month's ensemble, grown on the months that were public at its cutoff.

    rows: models.wide_rows(). origins: month, train_month (eligible_origins()). An origin with fewer than `least` months
    has no leaves. A group holds one row a month, so it is bounded by the calendar, and origins grow side by side.
    """
    how = how or GROWTHS[model]
    joined = origins.select("month", "train_month").join(rows.withColumnRenamed("month", "train_month"), "train_month")

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("train_month")
        found = []
        if len(frame) >= least:
            names, x = panel_of(frame["cells"])
            for tree, leaf, value, cover, conditions in ensemble(x, frame["actual_mom_pct"].to_numpy(float), how):
                listed = [{"feature": names[k], "low": c[0], "high": c[1], "missing": bool(c[2]), "share": float(c[3])} for k, c in sorted(conditions.items())]
                found.append((frame["month"].iloc[0], model, tree, leaf, value, cover, listed))
        return pd.DataFrame(found, columns=[c.split()[0] for c in LEAVES.split(", ")])

    # Few bytes but much work a group: dealt over all cores, where Spark would put all of them into one task by their size.
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return joined.repartition(cores, "month").groupBy("month").applyInPandas(run, LEAVES)


def paths(leaves: DataFrame, values: DataFrame) -> DataFrame:
    """Each leaf with, per feature on its path, whether the month's own value goes along (1 or 0) and the share of training rows that did.

    values: month, product_name, value. A value that is null or absent goes where missing ones go.
    """
    each = leaves.where(F.col("tree") != BASE).select("month", "model_key", "tree", "leaf", F.col("value").alias("leaf_value"), F.explode_outer("conditions").alias("c"))
    each = each.select("*", F.col("c.feature").alias("feature"))
    seen = values.select("month", F.col("product_name").alias("feature"), "value")
    along = F.when(F.col("value").isNull(), F.col("c.missing")).otherwise((F.col("value") > F.col("c.low")) & (F.col("value") <= F.col("c.high")))
    step = F.when(F.col("feature").isNotNull(), F.struct("feature", along.cast("double").alias("along"), F.col("c.share").alias("share")))
    return each.join(seen, ["month", "feature"], "left").groupBy("month", "model_key", "tree", "leaf", "leaf_value").agg(F.array_sort(F.collect_list(step)).alias("path"))


def product_of(path: Column | str, field: str) -> Column:
    return F.aggregate(path, F.lit(1.0), lambda a, p: a * p[field])


def leaf_sum(part: Column) -> Column:
    """The sum of part over a group's leaves in the order of tree and leaf, so that its last digits do not depend on how rows
    arrive. An ensemble has a bounded number of leaves, whatever the panel."""
    parts = F.sort_array(F.collect_list(F.struct("tree", "leaf", part.alias("part"))))
    return F.aggregate(parts, F.lit(0.0), lambda a, x: a + x.part)


def ensemble_predictions(leaves: DataFrame, values: DataFrame) -> DataFrame:
    """(month, model_key, estimate, baseline): the level plus the leaves that the month's own values reach; the baseline is
    what the training shares give without any value."""
    level = leaves.where(F.col("tree") == BASE).select("month", "model_key", F.col("value").alias("level"))
    reached = paths(leaves, values).groupBy("month", "model_key").agg(leaf_sum(F.col("leaf_value") * product_of("path", "along")).alias("sum"), leaf_sum(F.col("leaf_value") * product_of("path", "share")).alias("mean"))
    part = lambda c: F.col("level") + F.coalesce(c, F.lit(0.0))
    return level.join(reached, ["month", "model_key"], "left").select("month", "model_key", part("sum").alias("estimate"), part("mean").alias("baseline"))


def shapley_weight(path: Column, feature: Column) -> Column:
    """The weight of one feature's step in a leaf: over all subsets of the others on the path, those inside go along as the
    month does, those outside by their share. Subsets of one size are a coefficient of the product of (share + along t)."""
    others = F.filter(path, lambda p: p.feature != feature)
    grown = lambda c, p: F.zip_with(F.concat(F.transform(c, lambda v: v * p.share), F.array(F.lit(0.0))), F.concat(F.array(F.lit(0.0)), F.transform(c, lambda v: v * p.along)), lambda a, b: a + b)
    coefficients = F.aggregate(others, F.array(F.lit(1.0)), grown)
    n = F.size(path)
    parts = F.transform(coefficients, lambda c, k: c * F.factorial(k) * F.factorial(n - 1 - k) / F.factorial(n))
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v)


def tree_attributions(leaves: DataFrame, values: DataFrame) -> DataFrame:
    """(month, model_key, product_name, contribution): how each product's value moves the estimate from the baseline, averaged
    over all orders in which the values could become known. Contributions and the baseline add up to the estimate."""
    each = paths(leaves, values).select("month", "model_key", "tree", "leaf", "leaf_value", "path", F.explode("path").alias("p"))
    part = F.col("leaf_value") * (F.col("p.along") - F.col("p.share")) * shapley_weight(F.col("path"), F.col("p.feature"))
    return each.groupBy("month", "model_key", F.col("p.feature").alias("product_name")).agg(leaf_sum(part).alias("contribution"))
