"""Tree ensembles against plain loops, and attributions against the average over all subsets."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import trees
from tideline.plans.queries import QUERIES, long_matrix


def panel(seed=3, rows=40, columns=5, gaps=0.2):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(rows, columns)), 1)  # ties
    y = np.where(np.nan_to_num(x[:, 0]) > 0.3, 2.0, -1.0) + np.nan_to_num(x[:, 1]) + rng.normal(scale=0.1, size=rows)
    x[rng.random(x.shape) < gaps] = np.nan
    x[:, columns - 1] = np.round(rng.normal(size=rows), 1)  # a column without gaps
    return x, y


def plain_split(x, slope, rows, least):
    best = None
    for k in range(x.shape[1]):
        gap = np.isnan(x[:, k]).any()
        seen = np.unique(x[~np.isnan(x[:, k]), k])
        for cut in [*((seen[:-1] + seen[1:]) / 2), np.inf]:
            for missing in (False, True) if gap else (False,):
                left = [i for i in rows if (missing if math.isnan(x[i, k]) else x[i, k] <= cut)]
                right = [i for i in rows if i not in set(left)]
                if min(len(left), len(right)) < least:
                    continue
                part = lambda r: sum(slope[i] for i in r) ** 2 / len(r)
                gain = round(part(left) + part(right) - part(rows), 9)
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, k, cut, missing if gap else len(left) > len(right), left, right
    return best


class Node:
    """A tree as nodes, the way it is walked by hand."""

    def __init__(self, rows):
        self.rows, self.split, self.value, self.left, self.right = rows, None, 0.0, None, None

    def leaves(self):
        return [*self.left.leaves(), *self.right.leaves()] if self.split else [self]

    def walk(self, x):
        if not self.split:
            return self.value
        _, k, cut, missing, *_ = self.split
        return (self.left if (missing if math.isnan(x[k]) else x[k] <= cut) else self.right).walk(x)

    def expected(self, x, known):
        """The value if only the columns in known are known: at others both sides count by their training rows."""
        if not self.split:
            return self.value
        _, k, cut, missing, *_ = self.split
        if k in known:
            return (self.left if (missing if math.isnan(x[k]) else x[k] <= cut) else self.right).expected(x, known)
        return sum(len(n.rows) * n.expected(x, known) for n in (self.left, self.right)) / len(self.rows)


def plain_boosting(x, y, how):
    level, estimate, forest = y.mean(), np.full(len(y), y.mean()), []
    for _ in range(how.trees):
        root = Node(list(range(len(y))))
        slope = estimate - y
        while len(root.leaves()) < how.leaves:
            found = [(plain_split(x, slope, n.rows, how.least), n) for n in root.leaves()]
            found = [f for f in found if f[0]]
            if not found:
                break
            split, node = max(found, key=lambda f: f[0][0])
            node.split, node.left, node.right = split, Node(split[4]), Node(split[5])
        for leaf in root.leaves():
            leaf.value = -how.rate * sum(slope[i] for i in leaf.rows) / len(leaf.rows)
            estimate[leaf.rows] += leaf.value
        forest.append(root)
    return level, forest


def as_leaves(spark, x, y, how, month="2020-01"):
    names = [f"f{k}" for k in range(x.shape[1])]
    rows = [(month, "boosting", tree, leaf, value, cover, [(names[k], *map(float, c[:2]), bool(c[2]), float(c[3])) for k, c in sorted(conditions.items())]) for tree, leaf, value, cover, conditions in trees.ensemble(x, y, how)]
    return spark.createDataFrame(rows, trees.LEAVES)


def as_values(spark, x):
    rows = [(f"2020-{k + 1:02d}", f"f{j}", None if math.isnan(v) else float(v)) for k, row in enumerate(x) for j, v in enumerate(row)]
    return spark.createDataFrame(rows, "month string, product_name string, value double")


HOW = trees.Growth(trees=6, leaves=4, least=4, rate=0.3)


@pytest.fixture(scope="module")
def small_model(spark):
    x, y = panel()
    now = np.vstack([x[:7], np.full((1, 5), np.nan), np.full((1, 5), 99.0), np.full((1, 5), -99.0)])
    one = as_leaves(spark, x, y, HOW)
    leaves = one.crossJoin(spark.range(len(now)).select(F.format_string("2020-%02d", F.col("id") + 1).alias("m"))).select(F.col("m").alias("month"), *(c for c in one.columns if c != "month"))
    return x, y, now, leaves, as_values(spark, now)


def test_predictions_equal_plain_boosting(small_model):
    x, y, now, leaves, values = small_model
    level, forest = plain_boosting(x, y, HOW)
    got = {r.month: r.estimate for r in trees.ensemble_predictions(leaves, values).collect()}
    for k, row in enumerate(now):
        assert got[f"2020-{k + 1:02d}"] == pytest.approx(level + sum(t.walk(row) for t in forest), abs=1e-9)


def test_attributions_equal_the_average_over_subsets(small_model):
    x, y, now, leaves, values = small_model
    level, forest = plain_boosting(x, y, HOW)
    got = {(r.month, r.product_name): r.contribution for r in trees.tree_attributions(leaves, values).collect()}
    totals = {r.month: (r.estimate, r.baseline) for r in trees.ensemble_predictions(leaves, values).collect()}
    n = x.shape[1]
    for k, row in enumerate(now):
        month = f"2020-{k + 1:02d}"
        of = lambda known: level + sum(t.expected(row, known) for t in forest)  # noqa: B023, E731
        for j in range(n):
            rest = [i for i in range(n) if i != j]
            want = sum(math.factorial(len(s)) * math.factorial(n - 1 - len(s)) / math.factorial(n) * (of({*s, j}) - of(set(s))) for size in range(n) for s in combinations(rest, size))
            assert got.get((month, f"f{j}"), 0.0) == pytest.approx(want, abs=1e-9)
        estimate, baseline = totals[month]
        assert baseline == pytest.approx(of(set()), abs=1e-9)
        assert baseline + sum(v for (m, _), v in got.items() if m == month) == pytest.approx(estimate, abs=2e-5)


def test_features_that_are_absent_go_where_missing_ones_go(spark, small_model):
    _, _, now, leaves, values = small_model
    null = trees.ensemble_predictions(leaves, values).where("month = '2020-08'").first()  # the row without any value
    absent = trees.ensemble_predictions(leaves, values.where("month <> '2020-08'")).where("month = '2020-08'").first()
    assert absent == null


@pytest.mark.parametrize("partitions", [1, 5])
def test_leaves_are_added_in_their_order(spark, partitions):
    """Sums are the same to the last digit, however the leaves are dealt: those of one plain loop over trees and leaves."""
    rng = np.random.default_rng(5)
    parts = [(tree, leaf, float(rng.normal() * 10.0 ** rng.integers(-3, 4))) for tree in range(30) for leaf in range(4)]
    rows = [("2020-01", "boosting", trees.BASE, 0, 0.25, 1.0, [])] + [("2020-01", "boosting", tree, leaf, v, 1.0, [("f0", -math.inf, 0.5, False, 0.5)]) for tree, leaf, v in parts]
    leaves = spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], trees.LEAVES).repartition(partitions)
    values = spark.createDataFrame([("2020-01", "f0", 0.0)], "month string, product_name string, value double")
    estimate = half = 0.0
    for _, _, v in parts:
        estimate, half = estimate + v, half + v * 0.5
    got = trees.ensemble_predictions(leaves, values).first()
    assert (got.estimate, got.baseline) == (0.25 + estimate, 0.25 + half)
    assert [r.contribution for r in trees.tree_attributions(leaves, values).collect()] == [half]


def test_a_target_without_spread_gives_its_level(spark):
    x, _ = panel()
    leaves = as_leaves(spark, x, np.full(len(x), 1.5), HOW)
    assert trees.ensemble_predictions(leaves, as_values(spark, x[:1])).first().estimate == pytest.approx(1.5)
    assert trees.tree_attributions(leaves, as_values(spark, x[:1])).isEmpty()


def test_forest_stays_within_its_targets_and_repeats():
    x, y = panel()
    how = trees.Growth(trees=20, leaves=16, least=1, depth=4, drawn=True)
    found = trees.ensemble(x, y, how)
    assert found == trees.ensemble(x, y, how)
    by_tree = {}
    for tree, _, value, cover, conditions in found[1:]:
        by_tree.setdefault(tree, []).append((value, cover))
        assert len(conditions) <= 4 and y.min() - 1e-9 <= value * how.trees <= y.max() + 1e-9
    assert all(sum(c for _, c in leaves) == len(y) and len(leaves) <= 16 for leaves in by_tree.values())


def test_origins_learn_from_their_eligible_months_only(spark, small):
    """The registered query against the plain version on the first origin with enough months."""
    got = QUERIES["boosted_origin_predictions"](spark, small).toPandas().set_index("month")
    pairs = QUERIES["eligible_origins"](spark, small).toPandas().set_index("month")
    assert set(got.index) == set(pairs.index) and (got["n_train"] == pairs.loc[got.index, "n_train"]).all()
    assert set(got[got["n_train"] < 24]["status"]) == {"short_history"} and got[got["n_train"] >= 24]["estimate_mom_pct"].map(math.isfinite).all()
    first = got[got["status"] == "fitted"].sort_index().iloc[0]
    held = long_matrix(spark, small).toPandas()
    table = held.pivot_table(index="month", columns="product_name", values="value", dropna=False)
    y = held.groupby("month")["actual_mom_pct"].first()
    train = table.index[table.index <= first["training_end"]]
    assert len(train) == first["n_train"]
    how = trees.GROWTHS["boosting"]
    level, forest = plain_boosting(table.loc[train].to_numpy(float), y[train].to_numpy(float), trees.Growth(10, how.leaves, how.least, how.rate))
    shorter = trees.ensemble(table.loc[train].to_numpy(float), y[train].to_numpy(float), trees.Growth(10, how.leaves, how.least, how.rate))
    assert len(shorter) == 1 + sum(len(t.leaves()) for t in forest)
    now = table.loc[first.name].to_numpy(float)

    def along(conditions):
        return all(missing if math.isnan(now[k]) else low < now[k] <= high for k, (low, high, missing, _) in conditions.items())

    assert sum(v for _, _, v, _, c in shorter if along(c)) == pytest.approx(level + sum(t.walk(now) for t in forest), abs=1e-9)


def test_registered_attributions_add_up(spark, small):
    got = QUERIES["tree_attribution"](spark, small).toPandas()
    sums = got.groupby("month")["contribution"].sum()
    ends = got.groupby("month")[["baseline", "estimate"]].first()
    assert len(sums) > 30 and ((ends["baseline"] + sums - ends["estimate"]).abs() < 2e-5).all()


@pytest.mark.parametrize("name", ["forest_origin_predictions", "hybrid_origin_predictions"])
def test_other_ensembles_give_every_origin_an_estimate(spark, small, name):
    got = QUERIES[name](spark, small).toPandas()
    fitted = got[got["estimate_mom_pct"].notna()]
    assert len(fitted) > 30 and fitted["month"].is_unique and fitted["estimate_mom_pct"].map(math.isfinite).all()
