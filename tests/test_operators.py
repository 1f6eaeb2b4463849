"""Hand-computed cases of the as-of, feature, model and lifecycle operators."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.functions import releases as rel
from tideline.operators import asof, catalog, evaluation, features, ingest, models, products, registry, ridge, specs, validation

PRICES = [("2026-06", 3, 100.0, "2026-07-04"), ("2026-07", 1, 100.0, "2026-07-14"), ("2026-07", 2, 100.0, "2026-07-24"), ("2026-07", 3, 110.0, "2026-08-04"), ("2026-08", 1, 110.0, "2026-08-14"), ("2026-08", 2, 121.0, "2026-08-24"), ("2026-08", 3, 10000.0, "2026-09-04")]
SCHEMA = "product_name string, category string, sector string, release_month string, ord int, price double, published_at timestamp_ntz, retrieved_at timestamp_ntz, source_url string, content_sha256 string"


def release(month, ord, price, day, retrieved=None, url="u"):
    at = dt.datetime.fromisoformat(f"{day} 01:30:00")
    got = dt.datetime.fromisoformat(f"{retrieved} 02:00:00") if retrieved else at + dt.timedelta(minutes=30)
    return ("steel", "C", "S", month, ord, price, at, got, f"{url}/{month}/{ord}", f"{url}{month}{ord}{price}")


def panel(spark, prices=PRICES, more=()):
    return spark.createDataFrame([release(*p) for p in prices] + list(more), SCHEMA)


def cut(text):
    return F.lit(text).cast("timestamp_ntz")


def change(df, month, first_only=False):
    got = [r.change_pct for r in features.survey_change(features.survey_cells(df), first_only=first_only).where(F.col("month") == month).collect()]
    return got[0] if got else None


def test_survey_change_of_two_windows(spark):
    held = asof.select_available(panel(spark), cut("2026-09-04 00:00:00"))
    assert change(held, "2026-08") == pytest.approx(100 * (math.sqrt(110 * 121) / 100 - 1))
    assert held.where("release_month = '2026-08' and ord = 3").isEmpty()


def test_early_change(spark):
    held = asof.select_available(panel(spark, PRICES[:5]), cut("2026-08-14 15:00:00"))
    assert change(held, "2026-08", first_only=True) == pytest.approx(10.0)
    assert {r.state for r in asof.vintage_state(held).where("release_month = '2026-08'").collect()} == {"early"}


def test_late_correction_is_not_known_before_it_was_retrieved(spark):
    late = [release("2026-08", 1, 999.0, "2026-08-14", "2026-09-01")]
    price = lambda at, strict: {r.price for r in asof.select_available(panel(spark, more=late), cut(at), strict).where("release_month = '2026-08' and ord = 1").collect()}
    assert price("2026-08-24 15:00:00", True) == {110.0}
    assert price("2026-09-02 15:00:00", True) == {999.0}
    assert price("2026-08-24 15:00:00", False) == {999.0}


def test_midpoint_imputation(spark):
    rows = [p for p in PRICES if p[:2] != ("2026-08", 1)]
    cells = features.log_price_cells(asof.select_available(panel(spark, rows), cut("2026-08-24 15:00:00")))
    assert features.midpoint_imputed(cells).where("imputed").select(F.exp("c1")).first()[0] == pytest.approx(115.5)
    early = features.log_price_cells(asof.select_available(panel(spark, rows), cut("2026-08-15 00:00:00")))
    assert features.midpoint_imputed(early).where("imputed").isEmpty()


def test_twentieth_change_uses_the_second_windows_only(spark):
    scaled = [(m, k, p * (17 if k != 2 else 1), d) for m, k, p, d in PRICES]
    for prices in (PRICES, scaled):
        got = features.twentieth_change(features.log_price_cells(panel(spark, prices))).where("month = '2026-08'").first()
        assert got.change_pct == pytest.approx(21.0)


def test_trimmed_mean(spark):
    df = spark.createDataFrame([("a", float(x)) for x in [*range(9), 1000]] + [("a", None), ("b", None)], "k string, change_pct double")
    got = {r.k: r for r in features.trimmed_mean(df, ["k"]).collect()}
    assert got["a"].trimmed == 4.5 and got["a"].n == 10 and got["b"].trimmed is None


def test_identities(spark):
    df = spark.createDataFrame([("铝锭(A00)", "吨", "p_4b78aecc4ad2673a"), ("无烟煤(洗中块)", "吨", "p_b74ad31919d3dab3"), ("烧碱(液碱,32%)", "吨", "p_aaab792e0f7a512c")], "n string, u string, want string")
    assert all(r.got == r.want for r in df.select("want", rel.surrogate_id(F.col("n"), F.col("u")).alias("got")).collect())
    names = spark.createDataFrame([(" 铜 （1＃） ",), ("铜(1#)",)], "name string")
    assert {r.normalised for r in ingest.normalised_names(names).collect()} == {"铜(1#)"}


def test_titles_and_windows(spark):
    df = spark.createDataFrame([("prices 2026—08 (21－end)",), ("2014.3 prices 1–10",), ("nothing",)], "t string")
    month, window = rel.title_month_window(F.col("t"))
    assert [tuple(r) for r in df.select(month, window).collect()] == [("2026-08", "21-end"), ("2014-03", "1-10"), (None, None)]
    ends = spark.range(1).select(*(rel.window_end(F.lit("2024-02"), F.lit(k)).cast("string") for k in (1, 2, 3))).first()
    assert list(ends) == ["2024-02-10", "2024-02-20", "2024-02-29"]


def test_ridge_on_what_was_observed():
    new, old = np.array([np.nan] * 95 + [1.0, 2, 3, 4, 5]), np.linspace(-3, 3, 100)
    x, y = np.column_stack([new, old]), 2 * old + 1
    model = ridge.fit(x, y, 10.0, 2)
    assert model.centre[0] == 3 and model.scale[0] == pytest.approx(math.sqrt(2)) and (model.parts(x[:95])[:, 0] == 0).all()
    assert list(ridge.fit(x, y, 10.0, 12).use) == [1] and list(ridge.fit(x, y, 10.0, stable=True).use) == [1]
    assert np.allclose(model.parts(x).sum(axis=1) + model.bias, model(x))
    swapped = ridge.fit(x[:, ::-1], y, 10.0, 2)
    assert np.allclose(swapped(x[:, ::-1]), model(x))
    with pytest.raises(ValueError):
        ridge.fit(x[:3, :1], y[:3], 10.0, 2)


@pytest.mark.parametrize("rows,columns", [(30, 4), (6, 20)])
def test_ridge_is_the_closed_form(rows, columns):
    rng = np.random.default_rng(3)
    z, y = rng.normal(size=(rows, columns)), rng.normal(size=rows)
    weight, bias = ridge.solve(z, y, 7.0)
    both = np.column_stack([z, np.ones(rows)])
    penalty = np.diag([7.0] * columns + [0.0])
    assert np.allclose(np.append(weight, bias), np.linalg.solve(both.T @ both + penalty, both.T @ y))


def test_leave_one_out_choice_is_that_of_refitting():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(25, 5))
    y = x @ np.array([1.0, 0, 0, -1, 0.5]) + rng.normal(size=25)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    grid = (0.1, 1.0, 10.0, 100.0)

    def error(penalty):
        out = []
        for k in range(25):
            keep = np.arange(25) != k
            weight, bias = ridge.solve(z[keep], y[keep], penalty)
            out.append((y[k] - z[k] @ weight - bias) ** 2)
        return np.mean(out)

    model, penalty = ridge.fit_leave_one_out(x, y, grid)
    assert penalty == min(grid, key=error)
    weight, bias = ridge.solve(z, y, penalty)
    assert np.allclose(model(x), z @ weight + bias)
    x[3, 2] = np.nan
    filled = ridge.with_indicators(x, x)
    assert filled.shape == (25, 6) and filled[3, 2] == np.median(np.delete(x[:, 2], 3)) and filled[:, 5].sum() == 1


def test_choice_uses_targets_that_were_public():
    """The first half follows one rule, the second another; when the second's targets come out late they teach nothing."""
    rng = np.random.default_rng(5)
    n = 80
    x = rng.normal(size=(n, 3)) * 3
    y = np.where(np.arange(n) < 40, 0.0, 2.0) * x[:, 0] + rng.normal(size=n) * 0.1
    month = np.arange(n) * np.timedelta64(30, "D") + np.datetime64("2000-01-01")
    cutoff, early = month + np.timedelta64(20, "D"), month + np.timedelta64(40, "D")
    late = np.where(np.arange(n) < 40, early, cutoff[-1] + np.timedelta64(1, "D"))
    open_choice, guarded = ridge.choose(x, y, early, cutoff), ridge.choose(x, y, late, cutoff)
    assert guarded.error > open_choice.error + 0.3
    windowed = ridge.choose(x, y, early, cutoff, windows=(None, 20))
    assert windowed.window == 20 and windowed.error < open_choice.error
    with pytest.raises(ValueError):
        ridge.choose(x, y, np.full(n, cutoff[-1]), cutoff)


def test_equal_candidates_take_the_larger_penalty_and_longer_history():
    x, y = np.zeros((40, 2)), np.ones(40)
    when = np.arange(40) * np.timedelta64(1, "D") + np.datetime64("2000-01-01")
    got = ridge.choose(x, y, when, when + np.timedelta64(12, "h"), windows=(60, None))
    assert (got.penalty, got.window) == (1600.0, None) and got.least == 2  # only two observations are in every fold


def test_fitted_origins(spark):
    rng = np.random.default_rng(6)
    months = [f"{2000 + k // 12}-{k % 12 + 1:02d}" for k in range(40)]
    at = lambda m, day: dt.datetime.fromisoformat(f"{m}-{day:02d}")
    cells, target = rng.normal(size=(40, 3)), {}
    for k, m in enumerate(months):
        target[m] = float(cells[k] @ [1.0, -1.0, 0.5])
    rows = [(m, p, f"S{c % 2}", float(cells[k][c]), target[m], at(m, 28), at(m, 20)) for k, m in enumerate(months) for c, p in enumerate("abc")]
    long = spark.createDataFrame(rows, "month string, product_name string, sector string, value double, actual_mom_pct double, actual_published_at timestamp_ntz, cutoff timestamp_ntz")
    origins = evaluation.eligible_origins(long.select("month", "cutoff", "actual_mom_pct", "actual_published_at").distinct().withColumn("reason", F.lit(None).cast("string")))
    wide = models.wide_rows(long)
    fitted = models.fit_origins(wide, origins)
    got = {r.month: r for r in fitted.collect()}
    assert got[months[10]].status == "short_history" and got[months[39]].status == "fitted" and got[months[39]].n_train == 39 and got[months[39]].training_end == months[38]
    last = ridge.fit(cells[:39], np.array([target[m] for m in months[:39]]), got[months[39]].penalty, got[months[39]].least_history)
    assert got[months[39]].estimate_mom_pct == pytest.approx(float(last(cells[39:])[0]))
    given = evaluation.attributions(long, models.coefficients(fitted)).groupBy("month").agg(F.sum("contribution").alias("c"))
    assert all(r.c + got[r.month].bias == pytest.approx(got[r.month].estimate_mom_pct) for r in given.collect())
    sector = {r.month: r for r in models.fit_origins(wide, origins, "sector_first").collect()}
    assert [p.product_name for p in sector[months[39]].parts] == ["S0", "S1"]
    assert models.compared_fits(fitted, models.fit_origins(wide, origins, windows=(None, 30))).count() == sum(r.status == "fitted" for r in got.values())
    assert all(r.status == "fitted" for m, r in ((r.month, r) for r in models.fit_origins(wide, origins, "benchmark_ridge").collect()) if m > months[24])


def test_a_late_correction_is_in_later_months_only(spark):
    """The second window of July is corrected in September: August's features keep what was known, a far cutoff does not."""
    late = [release("2026-07", 2, 200.0, "2026-09-10", url="v")]
    obs = panel(spark, more=late)
    own = features.cells_at(obs, evaluation.feature_cutoffs(obs, "twentieth"))
    change = lambda cells: cells.where("month = '2026-08'").select((F.exp(F.col("c2") - F.col("p2"))).alias("x")).first().x
    assert change(own) == pytest.approx(1.21)
    assert change(features.log_price_cells(asof.select_available(obs, cut("2027-01-01")))) == pytest.approx(121 / 200)


def test_a_page_is_read_as_it_was_retrieved_last(spark):
    """A correction with an earlier stamp on the same page: the page shows it, the period keeps the later publication."""
    early = [("steel", "C", "S", "2026-08", 1, 5.0, dt.datetime(2026, 8, 13), dt.datetime(2026, 8, 30), "u/2026-08/1", "fix")]
    obs = panel(spark, more=early).where("release_month = '2026-08' and ord = 1")
    price = lambda grain: [r.price for r in asof.select_available(obs, cut("2026-09-09"), grain=grain).collect()]
    assert price(asof.SNAPSHOT) == [5.0] and price(asof.PERIOD) == [110.0]


def test_early_carry_keeps_the_price_changes(spark):
    got = {(r.part, round(r.value, 6)) for r in features.timing_changes(features.log_price_cells(panel(spark))).where("month = '2026-08' and variant = 'early_carry'").collect()}
    assert got == {("price", round(100 * math.log(1.1), 6)), ("carry", 0.0)}


def test_training_matrix_names_why_a_month_is_out(spark):
    acts = [("2026-07", 1.0, "2026-08-10"), ("2026-08", 2.0, "2026-08-20"), ("2026-09", 3.0, "2026-10-10")]
    actuals = spark.createDataFrame([(m, v, dt.datetime.fromisoformat(d)) for m, v, d in acts], "target_month string, actual_mom_pct double, published_at timestamp_ntz")
    _, matrix = products.training_matrix(panel(spark), actuals, "twentieth")
    assert {r.month: r.reason for r in matrix.collect()} == {"2026-06": "no_release", "2026-07": "no_comparable", "2026-08": "actual_already_public"}
    values, matrix = products.training_matrix(panel(spark), actuals.where("target_month <> '2026-08'"), "early")
    assert {r.month: r.reason for r in matrix.collect()} == {"2026-06": "no_release", "2026-07": "no_comparable", "2026-08": "no_actual"}


def test_imputed_months_reach_the_features(spark):
    obs = panel(spark, [p for p in PRICES if p[:2] != ("2026-08", 1)])
    cutoffs = evaluation.feature_cutoffs(obs, "twentieth")
    value = lambda months: products.variant_values(obs, "early", cutoffs, months).where("month = '2026-08'").first().value
    assert value(None) is None and value(["2026-07"]) is None and value(["2026-08"]) == pytest.approx(100 * math.log(115.5 / 100))
    rows = {r.month: r for r in products.feature_rows(obs, "early", cutoffs, ["2026-08"]).collect()}
    assert rows["2026-08"].imputed and rows["2026-08"].feature_values == {"price__steel": pytest.approx(100 * math.log(1.155))}
    plain = {r.month: r for r in products.feature_rows(obs, "early", cutoffs).collect()}
    assert plain["2026-08"].structural_missing == ["price__steel"] and plain["2026-08"].feature_hash != rows["2026-08"].feature_hash


def test_canonical_rows(spark):
    rows = [(" 铜 （1＃） ", " 吨", "一、有色金属", 7.0, "2024-02", 3, "x"), ("玻璃", "箱", "二、其他", 1.0, "2024-02", 1, "x"), ("铝", "千克", "二、其他", -1.0, "2024-02", 2, "x"), ("铝", "千克", "二、其他", None, "2024-02", 2, "x")]
    got = products.canonical(spark.createDataFrame(rows, "raw_name string, raw_unit string, raw_category string, price double, release_month string, ord int, content_sha256 string"))
    first = got.where("raw_unit = ' 吨'").first()
    assert (first.product_name, first.product_specification, first.continuity_group, first.unit, first.category) == ("铜(1#)", "1#", "铜", "CNY/tonne", "有色金属")
    assert (str(first.period_start), str(first.period_end), str(first.period_midpoint)) == ("2024-02-21", "2024-02-29", "2024-02-25")
    assert sorted(r.status for r in got.collect()) == ["invalid_price", "invalid_price", "ok", "unknown_unit"]
    assert {(r.observation_period, r.passed) for r in products.release_qa(got, 1).collect()} == {("2024-02:1", False), ("2024-02:2", False), ("2024-02:3", True)}


def test_times_and_small_functions(spark):
    assert rel.parse_as_of("2026-01-31T20:00:00+00:00").isoformat() == "2026-02-01T04:00:00+08:00"
    with pytest.raises(ValueError):
        rel.parse_as_of("2026-01-31T20:00:00")
    row = spark.createDataFrame([(dt.datetime(2026, 1, 31, 20), "2024-02", float("nan"), 3)], "t timestamp_ntz, m string, v double, ord int").select(
        rel.default_month(F.col("t")).alias("month"), rel.month_name(F.col("m")).alias("name"), rel.json_safe(F.col("v")).alias("safe"), rel.json_safe(F.lit(1.5)).alias("kept"), rel.is_month(F.col("m")).alias("good"), rel.is_month(F.lit("2024-13")).alias("bad"),
        rel.release_id(F.col("m"), F.lit("1-10"), F.col("t")).alias("id"), rel.window_midpoint(F.col("m"), F.col("ord")).cast("string").alias("middle"), rel.category_name(F.lit("十一、化工")).alias("category")).first()
    assert tuple(row) == ("2026-02", "February 2024", None, 1.5, True, False, "2024-02:1-10:2026-01-31 20:00:00", "2024-02-25", "化工")


def test_specs(spark):
    table = specs.spec_table(spark)
    assert specs.of_vintage(table, "early").count() == 5 and specs.of_vintage(table, "final").count() == 7
    features_ = spark.createDataFrame([("2024-01", "product__a", "1.5"), ("2024-01", "twentieth_product__a", "x"), ("2024-02", "other", "1")], "month string, feature string, value string")
    read = {(r.model_key, r.feature) for r in specs.columns_of(features_, table).collect()}
    assert ("product_level_ridge", "product__a") in read and ("product_level_ridge", "twentieth_product__a") not in read and ("twentieth_to_twentieth_direct", "twentieth_product__a") in read
    saved = spark.createDataFrame([(1, "twentieth_product__a"), (2, "product__a")], "position int, feature string")
    assert sorted((r.month, r.position, r.value) for r in specs.in_saved_order(features_, saved).where("month = '2024-01'").collect()) == [("2024-01", 1, None), ("2024-01", 2, 1.5)]
    named = {r.model_key: r.label for r in specs.labelled(spark.createDataFrame([("random_forest",), ("unknown",)], "model_key string"), table).collect()}
    assert named == {"random_forest": "Random forest", "unknown": "unknown"}
    assert [r[0] for r in spark.createDataFrame([("category_factor",), ("ridge",)], "m string").select(specs.is_active(F.col("m"))).collect()] == [False, True]
    fits = spark.createDataFrame([("b", "final", s[0], 20, 0.1, 0.2, 0.0, 0.5) for s in specs.SPECS], "bundle string, vintage string, model_key string, n int, mae double, rmse double, bias double, direction double")
    matrix = spark.createDataFrame([("b", dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1), "pseudo_real_time")] * 40, "bundle string, cutoff timestamp_ntz, actual_published_at timestamp_ntz, realtime_status string")
    check = lambda f=fits, m=matrix: {k for k, v in specs.bundle_checks(f, m, table).first().asDict().items() if v is False} - {"validated"}
    assert specs.bundle_checks(fits, matrix, table).first().validated and check() == set()
    assert check(fits.where("model_key <> 'random_forest'")) == {"expected_models_fitted", "core_models_fitted"}
    assert check(fits.where("model_key <> 'twentieth_to_twentieth_ridge'")) == {"expected_models_fitted", "final_benchmarks_fitted"}
    early = fits.where("model_key not like 'twentieth%'").withColumn("vintage", F.lit("early"))
    assert check(early) == set()
    assert check(fits.withColumn("mae", F.lit(float("nan")))) == check(fits.withColumn("bias", F.lit(None).cast("double"))) == {"all_metrics_finite"}
    assert check(fits.withColumn("n", F.lit(11))) == {"enough_predictions"} and check(m=matrix.limit(35)) == {"at_least_36_months"}
    assert check(m=matrix.withColumn("cutoff", F.col("actual_published_at"))) == {"publication_precedes_actual"} and check(m=matrix.withColumn("realtime_status", F.lit(None).cast("string"))) == {"label_present"}
    assert check(m=matrix.limit(0)) == {"at_least_36_months", "publication_precedes_actual", "label_present"}



def test_baskets(spark):
    rows = [(m, k, p, "x") for m, k, ps in (("2026-01", 1, "ab"), ("2026-01", 2, "ab"), ("2026-01", 3, "ac"), ("2026-02", 1, "ac"), ("2026-02", 2, "abc")) for p in ps]
    obs = spark.createDataFrame(rows, "release_month string, ord int, product_name string, category string")
    got = [(r.version, str(r.effective_from), str(r.effective_to), list(r.added), list(r.removed)) for r in catalog.basket_epochs(obs).orderBy("version").collect()]
    assert got == [(1, "2026-01-01", "2026-01-20", ["a", "b"], []), (2, "2026-01-21", "2026-02-10", ["c"], ["b"]), (3, "2026-02-11", "None", ["b"], [])]


def test_registry(spark):
    key = ["target_month", "vintage", "model_key", "feature_hash"]
    row = lambda m, v: (m, "early", "ridge", "h", v)
    make = lambda rows: spark.createDataFrame(rows, ", ".join(f"{k} string" for k in key) + ", estimate_mom_pct double")
    stored = make([row("2026-01", 0.1)])
    assert registry.append(stored, make([row("2026-01", 0.1 + 1e-14), row("2026-02", 0.2), row("2026-02", 0.2)])).count() == 2
    with pytest.raises(ValueError):
        registry.append(stored, make([row("2026-01", 0.2)]))
    nothing, nan = None, float("nan")
    cases = {"batch": [row("2026-02", 1.0), row("2026-02", 9.0)], "null": [row("2026-01", nothing)], "stored": [row("2026-01", 0.1 + 1e-9)]}
    for fault, batch in cases.items():
        assert [r.fault for r in registry.conflicts(stored, make(batch)).collect()] == [fault]
        with pytest.raises(ValueError, match=fault):
            registry.append(stored, make(batch))
    assert [r.fault for r in registry.conflicts(stored, make([row("2026-03", nan), row("2026-03", 1.0)])).collect()] == ["null"]
    assert [r.fault for r in registry.conflicts(make([row("2026-01", nothing)]), stored).collect()] == ["stored"]


def test_drift_and_promotion(spark):
    errors = [0.1] * 8 + [0.6] * 4
    rows = [(f"2025-{k + 1:02d}", "final", "old", "h", e) for k, e in enumerate(errors)] + [(f"2025-{k + 1:02d}", "final", "new", "h", e / 2) for k, e in enumerate(errors)]
    scores = spark.createDataFrame(rows, "target_month string, vintage string, model_key string, feature_hash string, error double")
    saved = spark.createDataFrame([("old", "final", 0.1), ("new", "final", 0.6)], "model_key string, vintage string, reference_mae double")
    reasons = lambda df: {r.model_key: r.reasons for r in registry.drift_triggers(df, saved, ["model_key", "vintage"]).collect()}
    assert reasons(scores) == {"old": "error,bias,refresh", "new": "bias,refresh"}
    assert reasons(scores.where("target_month < '2025-04'")) == {"old": "", "new": ""}
    assert [r.promoted for r in registry.promotion_decisions(scores, "old").collect()] == [True]
    assert [r.promoted for r in registry.promotion_decisions(scores, "new").collect()] == [False]
    other = scores.withColumn("feature_hash", F.when(F.col("model_key") == "new", "other").otherwise(F.col("feature_hash")))
    assert registry.matched_pairs(other, "old").isEmpty()


def test_journal(spark):
    kinds = [("initialized", "c0", "k"), ("trial_requested", "c1", "k"), ("refit_failed", "c1", "k"), ("challenger_fitted", "c1", "k"), ("trial_decided", "c1", "k"), ("promoted", "c1", "k"), ("challenger_fitted", "c2", "k"), ("trial_requested", "c2", "k"), ("trial_cancelled", "c2", "k"), ("adopted", "c3", "k2"), ("trial_requested", "c4", "k2")]
    rows = spark.createDataFrame([(n, kind, dt.datetime(2026, 1, n + 1), key, cycle, str(n)) for n, (kind, cycle, key) in enumerate(kinds)], "sequence long, kind string, as_of timestamp_ntz, key string, cycle_id string, payload string")
    journal = registry.chained(rows)
    assert registry.chain_breaks(journal).isEmpty()
    faults = lambda df: {(r.sequence, r.fault) for r in registry.chain_breaks(df).collect()}
    assert faults(journal.where("sequence <> 4")) == {(5, "gap")}
    assert faults(journal.withColumn("payload", F.when(F.col("sequence") == 3, "x").otherwise(F.col("payload")))) == {(3, "changed")}
    at = lambda n, c, v: F.when(F.col("sequence") == n, v).otherwise(F.col(c))
    again = lambda df, n: df.withColumn("event_id", at(n, "event_id", rel.event_digest()))
    assert faults(journal.withColumn("previous_event", at(6, "previous_event", F.lit("x")))) == {(6, "changed")}
    assert faults(again(journal.withColumn("previous_event", at(6, "previous_event", F.lit("x"))), 6)) == {(6, "forged"), (7, "forged")}
    assert faults(again(journal.withColumn("previous_event", at(0, "previous_event", F.lit("x"))), 0)) == {(0, "gap"), (1, "forged")}
    # An event rewritten with its id is seen at the next one; if that one's pointer is mended, at its id.
    forged = again(journal.withColumn("payload", at(3, "payload", F.lit("x"))), 3)
    assert faults(forged) == {(4, "forged")}
    new = forged.where("sequence = 3").first().event_id
    assert faults(forged.withColumn("previous_event", at(4, "previous_event", F.lit(new)))) == {(4, "changed")}
    # What is rewritten before the chain is made changes every later id of its key, and none of others.
    other = {r.sequence: r.event_id for r in registry.chained(rows.withColumn("payload", at(3, "payload", F.lit("x")))).collect()}
    assert {n for n, i in other.items() if i != {r.sequence: r.event_id for r in journal.collect()}[n]} == {3, 4, 5, 6, 7, 8}
    cycles = {r.cycle_id: (r.status, r.requested_at.day, r.n_failed) for r in registry.replay_cycles(journal).collect()}
    assert cycles == {"c1": ("promoted", 2, 1), "c2": ("cancelled", 8, 0), "c4": ("requested", 11, 0)}
    ids = {r.sequence: r.event_id for r in journal.collect()}
    got = {r.key: (r.champion, r.completed_at.day) for r in registry.replay_champions(journal).collect()}
    assert got == {"k": (ids[5], 5), "k2": (ids[9], 10)}


def test_audits_and_bundles(spark):
    make = lambda *rows: spark.createDataFrame(rows, "forecast_id string, estimate_mom_pct double")
    saved = make(("a", 1.0), ("b", 2.0), ("c", 3.0))
    assert {r.forecast_id for r in registry.changed_predictions(saved, make(("a", 1.0 + 1e-12), ("b", 2.1)), ["forecast_id"]).collect()} == {"b", "c"}
    models_ = lambda *rows: spark.createDataFrame(rows, "key string, bundle string")
    got = registry.composite_bundle(models_(("x", "old"), ("y", "old")), models_(("y", "new")), ["key"])
    assert sorted(tuple(r) for r in got.collect()) == [("x", "old"), ("y", "new")]


def test_release_checks(spark):
    rows = [("2026-01", 1, "s", f"p{k}", 10.0) for k in range(45)] + [("2026-01", 2, "s", f"p{k}", 11.0) for k in range(5)] + [("2026-01", 3, "s", "p1", -1.0), ("2026-01", 3, "s", "p1", None)]
    obs = spark.createDataFrame(rows, "release_month string, ord int, snapshot string, product_name string, price double")
    got = {r.ord: r for r in validation.release_validation(validation.with_changes(obs)).collect()}
    assert got[1].status == "ok" and got[2].status == "warning" and got[3].status == "error" and got[3].duplicates == 1
    assert validation.missing_columns(obs.drop("price")) == ["price"]


TABLE = "<table><tr><td>menu</td></tr></table><table><tr><th>产品名称</th><th>单位</th><th>本期价格(元)</th><th>比上期价格涨跌(元)</th><th>涨跌幅(%)</th></tr><tr><td colspan=5>一、黑色金属</td></tr><tr><td>螺纹钢&nbsp;(Φ20mm)</td><td>吨</td><td>3420.5</td><td>-10.2</td><td>-0.3</td></tr><tr><td>线材</td><td>吨</td><td>3500.0</td><td>-</td><td>-</td></tr><tr><td colspan=5>二、有色金属</td></tr><tr><td>电解铜</td><td>吨</td><td>70000</td><td>+5</td><td>0.0</td></tr></table>"


def test_price_tables():
    assert ingest.price_rows(TABLE) == [(2, "一、黑色金属", "螺纹钢 (Φ20mm)", "吨", 3420.5, -10.2, -0.3), (5, "二、有色金属", "电解铜", "吨", 70000.0, 5.0, 0.0)]
    assert ingest.price_rows("<table><tr><td>产品名称</td></tr></table>") == [] == ingest.price_rows(None)


def test_ingestion(spark):
    page = lambda url, title, html: (url, title, html, dt.datetime(2026, 8, 25))
    body = f"<p>2026/08/24 09:30</p>{TABLE}"
    pages = [page("u1", "市场价格 2026年8月 (11-20)", body), page("u2", "市场价格 2026年8月 (11-20)", body), page("u3", "2026-09 (1-10)", "请开启JavaScript并刷新该页"), page("u4", "About us", body + " "), page("u5", "2026-07 (1-10)", "no stamp"), page("known", "2026-06 (1-10)", body + "x")]
    incoming = spark.createDataFrame(pages, "source_url string, title string, html string, retrieved_at timestamp_ntz")
    stored = spark.createDataFrame([("known", "digest")], "source_url string, content_sha256 string")
    new, errors = ingest.ingest(stored, incoming)
    assert [(r.source_url, r.release_month, r.window, str(r.published_at)) for r in new.collect()] == [("u1", "2026-08", "11-20", "2026-08-24 01:30:00")]
    assert {(r.source_url, r.reason) for r in errors.collect()} == {("u3", "challenge"), ("u4", "no_release_in_title"), ("u5", "no_publication_time")}
    index = spark.createDataFrame([('<a href="u1">价格 2026年8月 (11-20)</a><a href="u6">2026年8月份工业生产者出厂价格</a><a href="u7">Home</a><a href="u8">价格 2026年10月 (1-10)</a>',)], "html string")
    links = ingest.discovered_links(index)
    assert {(r.url, r.kind) for r in links.collect()} == {("u1", "ten_day"), ("u6", "ppi"), ("u7", "other"), ("u8", "ten_day")}
    assert {r.url for r in ingest.link_range(links, "2026-08", "2026-09").collect()} == {"u1", "u6"}


def test_stream_of_snapshots(spark, tmp_path):
    from tideline.streaming.arrivals import append_to, new_snapshots, stream_table

    at = dt.datetime(2026, 1, 1)
    make = lambda ids: spark.createDataFrame([(i, at) for i in ids], "content_sha256 string, retrieved_at timestamp")
    source, sink, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    for ids in (["a", "b", "a"], ["b", "c"]):
        make(ids).write.mode("append").parquet(source)
        append_to(new_snapshots(stream_table(spark, source, make([]).schema)), sink, marks).awaitTermination()
    assert sorted(r.content_sha256 for r in spark.read.parquet(sink).collect()) == ["a", "b", "c"]


def test_files(spark, tmp_path):
    from tideline.sources import files

    path = str(tmp_path / "t.csv")
    (tmp_path / "t.csv").write_text("a,b\n1,\nx,2.5\n")
    got = files.typed(files.read_strings(spark, path, ["a", "b"]), {"a": "int", "b": "double"})
    assert sorted((r.a, r.b) for r in got.collect() if r.a) == [(1, None)] and got.count() == 2
    assert files.read_strings(spark, str(tmp_path / "none"), ["a"]).count() == 0
    make = lambda *rows: spark.createDataFrame(rows, "k string, v double")
    out = str(tmp_path / "out")
    assert files.write_once(make(("a", 1.0)), out, ["k"], "v") == 1
    assert files.write_once(make(("a", 1.0), ("b", 2.0)), out, ["k"], "v") == 1
    with pytest.raises(ValueError):
        files.write_once(make(("a", 9.0)), out, ["k"], "v")
    for batch in ([("z", 1.0), ("z", 9.0)], [("a", None)], [("z", None)], [("z", float("nan"))]):
        with pytest.raises(ValueError):
            files.write_once(make(*batch), out, ["k"], "v")
    assert files.write_once(make(("c", 3.0), ("c", 3.0 + 1e-13), ("a", 1.0 - 1e-13)), out, ["k"], "v") == 1
    assert sorted(map(tuple, spark.read.parquet(out).collect())) == [("a", 1.0), ("b", 2.0), ("c", 3.0)]


def test_vintages_versions_and_models(spark, tmp_path):
    from pyspark.ml.regression import LinearRegression, LinearRegressionModel
    from pyspark.ml.linalg import Vectors

    from tideline.sources import files

    make = lambda *rows: spark.createDataFrame(rows, "k string, v double")
    root = str(tmp_path / "vintages")
    tables = {"features": make(("a", 1.0)), "manifest": make(("m", 2.0)), "products": make(("p", 3.0))}
    assert files.write_vintage(root, "2026-01", tables) and not files.write_vintage(root, "2026-01", tables)
    with pytest.raises(ValueError):
        files.write_vintage(root, "2026-01", tables | {"manifest": make(("m", 9.0))})
    root = str(tmp_path / "versions")
    for version, value in (("2026-01", 1.0), ("2026-02", 2.0)):
        files.write_version(make(("a", value)), root, version)
    assert [r.v for r in files.newest_version(spark, root).collect()] == [2.0]
    data = spark.createDataFrame([(Vectors.dense([float(k)]), 2.0 * k) for k in range(5)], ["features", "label"])
    model, root = LinearRegression().fit(data), str(tmp_path / "models")
    files.save_model(model, root, "good", True)
    files.save_model(model, root, "bad", False)
    assert files.load_model(LinearRegressionModel, root, "good").coefficients == model.coefficients
    with pytest.raises(ValueError):
        files.load_model(LinearRegressionModel, root, "bad")
    assert files.load_model(LinearRegressionModel, root, "bad", require_validated=False).intercept == model.intercept


def test_forecast_trees(spark, tmp_path):
    from tideline.sources import files

    for month, model in (("2026-01", "a"), ("2026-02", "b")):
        (tmp_path / month / model).mkdir(parents=True)
        (tmp_path / month / model / "forecast.json").write_text('{\n "target_month": "%s",\n "estimate": 1.5\n}' % month)
    got = files.read_forecast_tree(spark, str(tmp_path), "target_month string, estimate double, note string")
    assert sorted((r.target_month, r.estimate, r.note) for r in got.collect()) == [("2026-01", 1.5, None), ("2026-02", 1.5, None)]


def test_lifecycle(spark):
    from tideline.plans import lifecycle

    at = lambda k: dt.datetime(2026, 1 + k, 9)
    rows = [("final", m, f"2025-{k + 1:02d}", "h", e * (0.4 + 0.1 * k), at(k)) for k in range(6) for m, e in (("old", 1.0), ("new", 0.2), ("worse", 2.0))]
    scores = spark.createDataFrame(rows, "vintage string, model_key string, target_month string, feature_hash string, error double, actual_published_at timestamp_ntz")
    saved = spark.createDataFrame([(m, "final", 0.2) for m in ("old", "new", "worse")], "model_key string, vintage string, reference_mae double")
    events = {(r.event_type, r.model_key) for r in lifecycle.cycle_events(scores, saved, "old", cut("2026-07-01")).collect()}
    assert events == {("trigger", "old"), ("trial", "new"), ("trial", "worse"), ("promotion", "new"), ("rejection", "worse")}
    assert lifecycle.cycle_events(scores, saved, "old", cut("2026-02-01")).isEmpty()
    assert [r.champion for r in lifecycle.champions(lifecycle.cycle_events(scores, saved, "old", cut("2026-07-01")), "old").collect()] == ["new"]


def test_hours_close_with_the_watermark(spark, tmp_path):
    from tideline.streaming.arrivals import append_to, hourly_events, stream_table

    make = lambda *hours: spark.createDataFrame([(dt.datetime(2026, 1, 1, h, 30), "click", 1.5) for h in hours], "ts timestamp, event_type string, value double")
    source, sink, marks = (str(tmp_path / n) for n in ("in", "out", "marks"))
    for hours in ((1, 1, 2), (3, 9), (2,)):  # the last comes too late
        make(*hours).write.mode("append").parquet(source)
        append_to(hourly_events(stream_table(spark, source, make().schema)), sink, marks).awaitTermination()
    assert sorted((r.hour.hour, r.n, r.value) for r in spark.read.parquet(sink).collect()) == [(1, 2, 3.0), (2, 1, 1.5), (3, 1, 1.5)]


def test_strength_is_chosen_on_inner_blocks():
    """Against plain normal equations with the bias as an unpenalised column."""
    rng = np.random.default_rng(9)
    x, y = rng.normal(size=(40, 3)), rng.normal(size=40)
    x[rng.random(x.shape) < 0.2] = np.nan
    times = np.arange(40)

    def plain(train, target, now, penalty):
        medians = np.nanmedian(train, axis=0)
        gaps = np.isnan(train).any(axis=0)
        full = lambda v: np.column_stack([np.where(np.isnan(v), medians, v), np.isnan(v)[:, gaps]])
        a, b = full(train), full(now)
        m, s = a.mean(axis=0), np.where(a.std(axis=0) > 0, a.std(axis=0), 1.0)
        design = np.column_stack([np.ones(len(a)), (a - m) / s])
        free = np.diag([0.0, *[penalty] * (design.shape[1] - 1)])
        return np.column_stack([np.ones(len(b)), (b - m) / s]) @ np.linalg.solve(design.T @ design + free, design.T @ target)

    for penalty in ridge.STRENGTHS:
        assert ridge.fit_filled(x[:30], y[:30], penalty)(ridge.with_indicators(x[30:], x[:30])) == pytest.approx(plain(x[:30], y[:30], x[30:], penalty))
    losses = {p: np.mean(np.concatenate([np.abs(plain(x[:k], y[:k], x[k : k + 10], p) - y[k : k + 10]) for k in (10, 20, 30)])) for p in ridge.STRENGTHS}
    assert ridge.choose_strength(x, y, times, times + 0.5) == min(losses, key=losses.get)
    with pytest.raises(ValueError):
        ridge.choose_strength(x, y, times + 100, times)
