"""Ridge for every timing, panel and origin from expanding sums: a month's products are multiplied once, never refitted."""

from __future__ import annotations

from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators import ridge

TARGET = "~y"  # stands among the features, always seen; it sorts after them
GRID = "variant string, month string, panel string, status string, estimate_mom_pct double, actual_mom_pct double, n_train long, training_end string, penalty double, least_history long"
SUMS = ["xy", "x", "y", "n"]


def numbered_months(months: DataFrame) -> DataFrame:
    """variant, month, r (from 1 on), actual_mom_pct, actual_published_at, cutoff of the months in use. One row a month."""
    line = Window.partitionBy("variant").orderBy("month")
    return months.where("reason is null").select("variant", "month", F.row_number().over(line).cast("long").alias("r"), "actual_mom_pct", "actual_published_at", "cutoff")


def month_cells(values: DataFrame, months: DataFrame) -> DataFrame:
    """variant, r, feature, x, seen: every feature of a timing in every month, 0 and 0 where it is missing, and the target."""
    features = values.where("value is not null").select("variant", "feature").distinct()
    grid = months.select("variant", "month", "r").join(features, "variant")
    seen = grid.join(values.select("variant", "month", "feature", "value"), ["variant", "month", "feature"], "left")
    cells = seen.select("variant", "r", "feature", F.coalesce("value", F.lit(0.0)).alias("x"), F.col("value").isNotNull().cast("double").alias("seen"))
    return cells.unionByName(months.select("variant", "r", F.lit(TARGET).alias("feature"), F.col("actual_mom_pct").alias("x"), F.lit(1.0).alias("seen")))


def pair_sums(cells: DataFrame) -> DataFrame:
    """variant, r, f, g and the sums over the months up to r of x y, x where g is seen, y where f is seen, and both seen:
    one join of each month's cells with themselves, then running sums by pair."""
    left, right = (cells.select("variant", "r", F.col("feature").alias(k), F.col("x").alias(f"x_{k}"), F.col("seen").alias(f"s_{k}")) for k in "fg")
    pairs = left.join(right, ["variant", "r"]).where("f <= g")
    line = Window.partitionBy("variant", "f", "g").orderBy("r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    products = {"xy": F.col("x_f") * F.col("x_g"), "x": F.col("x_f") * F.col("s_g"), "y": F.col("s_f") * F.col("x_g"), "n": F.col("s_f") * F.col("s_g")}
    return pairs.select("variant", "r", "f", "g", *(F.sum(c).over(line).alias(k) for k, c in products.items()))


def gram_table(sums: DataFrame) -> DataFrame:
    """One row a timing and month: its pairs in order, to be looked up."""
    return sums.groupBy("variant", "r").agg(F.array_sort(F.collect_list(F.struct("f", "g", *SUMS))).alias("pairs"))


def training_sets(months: DataFrame, origins: DataFrame) -> DataFrame:
    """variant, month, fold, last, size: how many of the first months an origin (fold 0) and its validation blocks (1 to 3)
    may learn from, and the blocks' size.

    Targets are released in the order of months, so what is public at a time is a run of months from the first; the
    numbers tell if it is not (in_order).
    """
    n, k = ridge.INNER_BLOCKS, F.col("fold")
    rank = months.select("variant", F.col("month").alias("train_month"), F.col("r").alias("train_r"))
    outer = origins.join(rank, ["variant", "train_month"]).groupBy("variant", "month").agg(F.count("*").alias("last"), F.max("train_r").alias("most"))
    each = outer.withColumn("size", F.floor(F.col("last") / (n + 1))).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(n))))
    first = F.col("p_last") - (n + 1 - k) * F.col("size")  # months before the block
    each = each.select("variant", "month", F.col("last").alias("p_last"), "size", "fold").withColumn("first", first)
    starts = months.select("variant", (F.col("r") - 1).alias("first"), F.col("cutoff").alias("block_cutoff"))
    public = months.select("variant", "r", "actual_published_at")
    held = each.join(starts, ["variant", "first"]).join(public, "variant").where((F.col("r") <= F.col("first")) & (F.col("actual_published_at") < F.col("block_cutoff")))
    inner = held.groupBy("variant", "month", "fold", "first", "size").agg(F.count("*").alias("last"), F.max("r").alias("most"))
    inner = each.select("variant", "month", "fold", "first", "size").join(inner, ["variant", "month", "fold", "first", "size"], "left").fillna(0, ["last", "most"])
    outer = outer.select("variant", "month", F.lit(0).alias("fold"), F.col("last").alias("first"), F.floor(F.col("last") / (n + 1)).alias("size"), "last", "most")
    return outer.unionByName(inner).withColumn("in_order", F.col("last") == F.col("most"))


class Sums:
    """The sums of one training set as matrices over the features."""

    def __init__(self, names: list[str], pairs: list[dict]):
        at = {name: k for k, name in enumerate([*names, TARGET])}
        size = len(at)
        xy, x, n = np.zeros((size, size)), np.zeros((size, size)), np.zeros((size, size))
        for p in pairs:
            i, j = at[p["f"]], at[p["g"]]
            xy[i, j] = xy[j, i] = p["xy"]
            n[i, j] = n[j, i] = p["n"]
            x[i, j], x[j, i] = p["x"], p["y"]  # x[i, j]: of i where j is seen
        self.months = int(round(n[-1, -1]))
        self.level = x[-1, -1] / self.months if self.months else np.nan
        self.xy, self.x, self.n, self.with_target, self.target_seen = xy[:-1, :-1], x[:-1, :-1], n[:-1, :-1], xy[:-1, -1], x[-1, :-1]
        self.seen = np.diag(self.n)

    def usable(self, least: int, stable: bool) -> np.ndarray:
        use = np.flatnonzero(np.round(self.seen) == self.months if stable else np.round(self.seen) >= least)
        if not len(use):
            raise ValueError("no column has enough observations")
        return use

    def solve(self, penalty: float, least: int, stable: bool) -> ridge.Linear:
        """The ridge of the observed values' scale: scaled columns have mean 0, so that the bias is the target's mean."""
        use = self.usable(least, stable)
        centre = np.diag(self.x)[use] / self.seen[use]
        spread = np.sqrt(np.maximum(np.diag(self.xy)[use] / self.seen[use] - centre**2, 0.0))
        scale = np.maximum(spread, ridge.LEAST_SCALE)
        both = np.ix_(use, use)
        gram = self.xy[both] - centre[:, None] * self.x[both].T - self.x[both] * centre[None, :] + np.outer(centre, centre) * self.n[both]
        gram = gram / np.outer(scale, scale)
        right = (self.with_target[use] - centre * self.target_seen[use]) / scale
        weight = np.linalg.solve(gram + penalty * np.eye(len(use)), right)
        return ridge.Linear(use, centre, scale, weight, float(self.level))


def choose(sums: dict[int, Sums], blocks: dict[int, tuple[np.ndarray, np.ndarray]], stable: bool) -> tuple[float, int]:
    """(penalty, least history) of least mean absolute error over all blocks, by the same rules and ties as ridge.choose()."""
    if any(s.months < ridge.LEAST_RELEASED for s in sums.values()):
        raise ValueError("too few released targets before a validation block")
    found = []
    for penalty, least in product(ridge.PENALTIES, (2,) if stable else ridge.HISTORIES):
        try:
            losses = np.concatenate([np.abs(sums[k].solve(penalty, least, stable)(x) - y) for k, (x, y) in blocks.items()])
        except ValueError:
            continue
        found.append((round(float(losses.mean()), 12), -penalty, -least))
    if not found:
        raise ValueError("no candidate can be fitted")
    _, penalty, least = min(found)
    return -penalty, -least


def grid_predictions(values: DataFrame, months: DataFrame, origins: DataFrame, table: DataFrame, cells: DataFrame, least_months: int = 24) -> DataFrame:
    """One row a timing, origin and panel (union, stable): the chosen ridge's estimate, as models.fit_origins() gives it.

    values: variant, month, feature, value. months: numbered_months(). origins: variant, month, train_month. table:
    gram_table(). cells: month_cells(). A group holds four looked-up sums and the rows that the candidates are judged on.
    """
    sets = training_sets(months, origins)
    if sets.where("not in_order").take(1):
        raise ValueError("targets were not released in the order of their months")
    looked_up = sets.join(table.withColumnRenamed("r", "last"), ["variant", "last"], "left").select("variant", "month", "fold", "first", "size", "last", "pairs")
    whole = cells.groupBy("variant", "r").agg(F.array_sort(F.collect_list(F.struct("feature", F.when(F.col("seen") > 0, F.col("x")).alias("value")))).alias("cells"))
    ends = months.select("variant", F.col("month").alias("name"), "r", "actual_mom_pct")
    own = months.select("variant", "month", F.col("r").alias("own"))
    spans = sets.where("fold = 0").join(own, ["variant", "month"]).select("variant", "month", F.explode(F.array_append(F.when(F.col("size") > 0, F.sequence(F.col("last") - ridge.INNER_BLOCKS * F.col("size") + 1, F.col("last"))).otherwise(F.array("last")), F.col("own"))).alias("r"))
    rows = spans.join(whole, ["variant", "r"]).join(ends, ["variant", "r"])

    def run(key: tuple, grams: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        grams, held = grams.set_index("fold"), held.sort_values("r")
        outer = grams.loc[0]
        names = [c["feature"] for c in held["cells"].iloc[0] if c["feature"] != TARGET]
        x = np.array([[np.nan if c["value"] is None else c["value"] for c in month if c["feature"] != TARGET] for month in held["cells"]], float)
        y, r = held["actual_mom_pct"].to_numpy(float), held["r"].to_numpy()
        base = {"variant": key[0], "month": key[1], "n_train": int(outer["last"]), "training_end": held["name"][r == outer["last"]].iloc[0], "actual_mom_pct": float(y[-1])}
        sums = {}
        if outer["last"] >= least_months:
            sums = {k: Sums(names, [] if g["pairs"] is None else list(g["pairs"])) for k, g in grams.iterrows()}
        out = []
        for panel in ("union", "stable"):
            row = base | {"panel": panel, "status": "short_history"}
            if sums:
                try:
                    blocks = {k: (x[inside], y[inside]) for k in sums if k for inside in [(r > grams.loc[k, "first"]) & (r <= grams.loc[k, "first"] + outer["size"])]}
                    penalty, least = choose({k: s for k, s in sums.items() if k}, blocks, panel == "stable")
                    found = sums[0].solve(penalty, least, panel == "stable")
                    row |= {"status": "fitted", "estimate_mom_pct": float(found(x[-1:])[0]), "penalty": penalty, "least_history": least}
                except ValueError as reason:
                    row["status"] = str(reason)
            out.append(row)
        kinds = {"double": float, "long": "Int64"}
        return pd.DataFrame({c.split()[0]: pd.Series([o.get(c.split()[0]) for o in out], dtype=kinds.get(c.split()[1], object)) for c in GRID.split(", ")})

    keys = ["variant", "month"]
    looked_up, rows = (df.select(*(F.col(c).alias(c) for c in df.columns)) for df in (looked_up, rows))  # both stem from months: names of their own
    cores = cells.sparkSession.sparkContext.defaultParallelism  # few bytes but much work a group
    return looked_up.repartition(cores, *keys).groupBy(*keys).cogroup(rows.repartition(cores, *keys).groupBy(*keys)).applyInPandas(run, GRID)
