"""The grid of looked-up normal equations against fits of each origin's rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import evaluation, gram, models, ridge
from tideline.plans.queries import QUERIES, VARIANTS, grid_inputs, training


def test_sums_solve_as_rows_do():
    rng = np.random.default_rng(2)
    x, y = rng.normal(3, 5, size=(40, 6)), rng.normal(size=40)
    x[rng.random(x.shape) < 0.25] = np.nan
    x[:, 5] = rng.normal(3, 5, size=40)
    names = [f"f{k}" for k in range(6)]
    cells, seen = np.nan_to_num(np.column_stack([x, y])), np.column_stack([~np.isnan(x), np.ones(40, bool)]).astype(float)
    keys = [*names, gram.TARGET]
    pairs = [{"f": keys[i], "g": keys[j], "xy": cells[:, i] @ cells[:, j], "x": cells[:, i] @ seen[:, j], "y": seen[:, i] @ cells[:, j], "n": seen[:, i] @ seen[:, j]} for i in range(7) for j in range(i, 7)]
    sums = gram.Sums(names, pairs)
    for penalty, least, stable in ((10.0, 2, False), (400.0, 30, False), (25.0, 2, True)):
        a, b = sums.solve(penalty, least, stable), ridge.fit(x, y, penalty, least, stable)
        assert list(a.use) == list(b.use) and np.allclose(a(x), b(x), atol=1e-9) and np.allclose(a.weight, b.weight, atol=1e-9)
    with pytest.raises(ValueError):
        sums.solve(10.0, 41, False)


def test_grid_equals_a_fit_of_each_origin(spark, small):
    got = QUERIES["candidate_grid_predictions"](spark, small).toPandas().set_index(["variant", "panel", "month"])
    assert set(got.index.get_level_values(0)) == set(VARIANTS) and set(got.index.get_level_values(1)) == {"union", "stable"}
    for variant in VARIANTS:
        held, months = training(spark, small, variant)
        used = months.where("reason is null").select("month", "actual_mom_pct", "actual_published_at", "cutoff")
        long = held.withColumn("product_name", F.concat_ws("__", "part", "product_name")).join(used, "month")
        rows, origins = models.wide_rows(long), evaluation.eligible_origins(months)
        for panel in ("union", "stable") if variant in ("twentieth", "early_carry") else ("union",):
            want = models.fit_origins(rows, origins, stable=panel == "stable").toPandas()
            assert len(want) == len(got.loc[variant, panel]) > 30
            for w in want.itertuples():
                g = got.loc[variant, panel, w.month]
                assert (g["status"], g["n_train"], g["training_end"]) == (w.status, w.n_train, w.training_end)
                if w.status == "fitted":
                    assert (g["penalty"], g["least_history"]) == (w.penalty, w.least_history)
                    assert math.isclose(g["estimate_mom_pct"], w.estimate_mom_pct, abs_tol=1e-6)


def test_running_sums_equal_plain_ones(spark, small):
    values, months, _ = grid_inputs(spark, small)
    frame, order = values.toPandas(), months.toPandas()
    got = QUERIES["gram_sums"](spark, small).toPandas()
    for variant in VARIANTS:
        line = order[order["variant"] == variant].sort_values("r")
        line = line[line["r"] < line["r"].max()]
        table = frame[frame["variant"] == variant].pivot_table(index="month", columns="feature", values="value", dropna=False).reindex(line["month"])
        table[gram.TARGET] = line["actual_mom_pct"].to_numpy()
        x, seen = np.nan_to_num(table.to_numpy(float)), (~np.isnan(table.to_numpy(float))).astype(float)
        at = {c: k for k, c in enumerate(table.columns)}
        mine = got[got["variant"] == variant]
        assert len(mine) == len(at) * (len(at) - 1) // 2
        for r in mine.itertuples():
            i, j = at[r.f], at[r.g]
            assert [r.xy, r.x, r.y, r.n] == pytest.approx([x[:, i] @ x[:, j], x[:, i] @ seen[:, j], seen[:, i] @ x[:, j], seen[:, i] @ seen[:, j]], abs=1e-3)


def test_targets_out_of_order_are_refused(spark, small):
    values, months, origins = grid_inputs(spark, small)
    late = months.withColumn("actual_published_at", F.when(F.col("r") == 5, F.col("actual_published_at") + F.expr("INTERVAL '400' DAY")).otherwise(F.col("actual_published_at")))
    assert gram.training_sets(months, origins).where("not in_order").isEmpty()
    assert not gram.training_sets(late, origins).where("not in_order").isEmpty()
