"""Coefficient tables as saved models: joins against plain arithmetic."""

import math

import numpy as np
import pytest

from tideline.operators import ridge, saved

LONG = "month string, product_name string, sector string, value double, actual_mom_pct double"


def panel(spark, months=30, products=4, seed=5):
    rng = np.random.default_rng(seed)
    names = [f"2020-{k + 1:02d}" if k < 12 else f"{2020 + k // 12}-{k % 12 + 1:02d}" for k in range(months)]
    x = rng.normal(scale=3, size=(months, products))
    x[rng.random(x.shape) < 0.15] = np.nan
    y = np.nan_to_num(x[:, 0]) * 0.4 + rng.normal(size=months)
    rows = [(m, f"p{j}", f"S{j % 2}", None if math.isnan(x[k, j]) else float(x[k, j]), float(y[k])) for k, m in enumerate(names) for j in range(products)]
    return names, x, y, spark.createDataFrame(rows, LONG)


def training(spark, names, n, version="v"):
    return spark.createDataFrame([(version, m) for m in names[:n]], "version string, month string")


def test_ridge_table_predicts_as_the_fit_does(spark):
    names, x, y, long = panel(spark)
    table = saved.ridge_models(long, training(spark, names, 24), penalty=25.0)
    wanted = spark.createDataFrame([(m, "v", "ridge") for m in names[24:]], "month string, version string, model_key string")
    got = {r.month: r.estimate for r in saved.predictions(wanted, table, long).collect()}
    want = ridge.fit(x[:24], y[:24], 25.0)(x[24:])
    assert [got[m] for m in names[24:]] == pytest.approx(list(want), abs=1e-10)


def test_marginal_table_is_the_mean_of_single_regressions(spark):
    names, x, y, long = panel(spark)
    table = saved.marginal_models(long, training(spark, names, 24), {"a": 10.0, "b": 1000.0}, least=12)
    wanted = spark.createDataFrame([(m, "v", k) for m in names[24:] for k in "ab"], "month string, version string, model_key string")
    got = {(r.month, r.model_key): r.estimate for r in saved.predictions(wanted, table, long).collect()}
    for key, penalty in (("a", 10.0), ("b", 1000.0)):
        for k in range(24, 30):
            parts = []
            for j in range(x.shape[1]):
                seen = ~np.isnan(x[:24, j])
                c, s = x[:24, j][seen].mean(), max(x[:24, j][seen].std(), 1.0)
                z = (x[:24, j][seen] - c) / s
                w = (z * (y[:24][seen] - y[:24][seen].mean())).sum() / ((z * z).sum() + penalty)
                parts.append(0.0 if math.isnan(x[k, j]) else w * (x[k, j] - c) / s)
            assert got[names[k], key] == pytest.approx(y[:24].mean() + np.mean(parts), abs=1e-9)


def test_products_with_few_values_and_lost_versions(spark):
    names, _, _, long = panel(spark)
    few = long.where("not (product_name = 'p3' and month > '2020-06')")
    table = saved.marginal_models(few, training(spark, names, 24), {"a": 10.0}, least=12)
    assert {r.product_name for r in table.collect()} == {"p0", "p1", "p2"}
    wanted = spark.createDataFrame([(names[25], "v", "a"), (names[25], "gone", "a")], "month string, version string, model_key string")
    got = {r.version: r.estimate for r in saved.predictions(wanted, table, long.where("product_name <> 'p0'")).collect()}
    assert got["gone"] is None and math.isfinite(got["v"])


def trial(spark):
    names, _, _, long = panel(spark)
    both = training(spark, names, 18, "2020-01").union(training(spark, names, 24, "2022-01"))
    table = saved.marginal_models(long, both, {"champion": 100.0, "challenger": 10.0})
    months = spark.createDataFrame([(m,) for m in names[24:]], "month string")
    of = lambda key, *versions: saved.newest_version(months, spark.createDataFrame([(v,) for v in versions], "version string")).selectExpr("month", "version", f"'{key}' as model_key")
    return names, long, table, saved.matched_forecasts(long, table, of("champion", "2020-01"), of("challenger", "2020-01", "2022-01"))


def test_both_models_forecast_from_the_same_features(spark):
    names, long, table, made = trial(spark)
    rows = made.collect()
    assert len(rows) == 12 and all(r.groups_agree for r in rows)
    assert {(r.role, r.version) for r in rows} == {("champion", "2020-01"), ("challenger", "2022-01")}
    assert len({(r.month, r.feature_hash) for r in rows}) == 6
    assert saved.reprediction_faults(made, table, long).isEmpty()


def test_the_store_shows_what_was_changed(spark):
    from pyspark.sql import functions as F

    names, long, table, made = trial(spark)
    when = lambda m, c, v: F.when(F.col("month") == m, v).otherwise(F.col(c))
    forged = made.withColumn("estimate", when(names[24], "estimate", F.col("estimate") + 1e-9))
    shifted = long.withColumn("value", when(names[25], "value", F.col("value") + 1))
    found = lambda f, t, v: {(r.month, r.role, r.fault) for r in saved.reprediction_faults(f, t, v).collect()}
    assert found(forged, table, long) == {(names[24], role, "estimate") for role in ("champion", "challenger")}
    assert found(made, table, shifted) == {(names[25], role, "features") for role in ("champion", "challenger")}
    assert found(made, table.where("model_key = 'champion'"), long) == {(m, "challenger", "version") for m in names[24:]}
    lost = found(made, table, long.where(F.col("month") != names[26]))
    assert lost == {(names[26], role, "features") for role in ("champion", "challenger")}


def test_trials_score_what_was_made_in_time(spark):
    names, long, table, made = trial(spark)
    faults = saved.reprediction_faults(made, table, long)
    actuals = long.select("month", "actual_mom_pct").distinct().selectExpr("month", "actual_mom_pct", "cast(concat(month, '-20') as timestamp) as actual_published_at")
    cutoffs = long.select("month").distinct().selectExpr("month", f"cast(concat(month, if(month = '{names[27]}', '-20', '-10')) as timestamp) as cutoff")
    got = {r.month: r for r in saved.score_trial(made, actuals, cutoffs, faults).collect()}
    assert set(got) == set(names[24:]) - {names[27]}
    y = {r.month: r.actual_mom_pct for r in actuals.collect()}
    estimates = {(r.month, r.role): r.estimate for r in made.collect()}
    for m, r in got.items():
        errors = [estimates[m, role] - y[m] for role in ("champion", "challenger")]
        assert [r.champion_error, r.challenger_error] == pytest.approx(errors) and r.won == (abs(errors[1]) < abs(errors[0]))


def test_stress_uses_the_same_coefficients(spark):
    names, _, _, long = panel(spark)
    table = saved.marginal_models(long, training(spark, names, 24, "1"), {"a": 10.0})
    tests = spark.createDataFrame([("1", m) for m in names[24:]], "version string, month string")
    none = saved.stress_metrics(table, tests, long, share=10**9).first()
    every = saved.stress_metrics(table, tests, long, share=1).first()
    assert none.n == 6 and none.mean_change == 0 and none.stressed_mae == none.clean_mae == every.clean_mae
    y = {r.month: r.actual_mom_pct for r in long.select("month", "actual_mom_pct").distinct().collect()}
    bias = table.first().bias  # with every cell missing only the bias is left
    assert every.stressed_mae == pytest.approx(np.mean([abs(bias - y[m]) for m in names[24:]]))
