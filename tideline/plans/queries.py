"""Registered queries of the panel engine, over the panel that sources.proxy derives from the given tables."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions import releases as rel
from tideline.operators import asof, catalog, discovery, evaluation, features, gram, ingest, models, products, quality, registry, ridge, saved, specs, trees, validation
from tideline.plans import lifecycle
from tideline.sources import files, proxy, publish
from tideline.streaming import arrivals, landing
from tideline.streaming import lifecycle as carried

CUTOFF = "1999-03-26 12:00:00"  # of the queries that ask what was known at a time; all others have none
SINCE = "1997-01"  # month from which on the saved models were in use
CHAMPION = "sector_first"  # the model in use; some challengers beat it and some do not
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def at(text: str = CUTOFF) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def r6(c: Column | str, places: int = 6) -> Column:
    return F.round(c, places) + F.lit(0.0)


def rounded(df: DataFrame, *names: str, places: int = 6) -> DataFrame:
    return df.withColumns({n: r6(n, places) for n in names})


def scored_metrics(df: DataFrame, *more: str) -> DataFrame:
    """Means of numbers with six places, rounded where halves do not occur."""
    return rounded(df, *(m for m in METRICS if m in df.columns), *more, places=9)


def known(spark, sf_dir) -> DataFrame:
    return asof.select_available(proxy.observations(spark, sf_dir), at())


def available(spark, sf_dir) -> DataFrame:
    return asof.select_available(proxy.observations(spark, sf_dir), None)


def cells(spark, sf_dir) -> DataFrame:
    return features.log_price_cells(available(spark, sf_dir))


def values(spark, sf_dir, variant: str = "twentieth") -> DataFrame:
    return features.timing_changes(cells(spark, sf_dir)).where(F.col("variant") == variant)


def first_actuals(spark, sf_dir) -> DataFrame:
    return asof.known_actuals(proxy.actuals(spark, sf_dir), None)


def training(spark, sf_dir, variant: str = "twentieth", **more) -> tuple[DataFrame, DataFrame]:
    """(values, matrix), each month's as its own cutoff knew it."""
    return products.training_matrix(proxy.observations(spark, sf_dir), first_actuals(spark, sf_dir), variant, **more)


def matrix(spark, sf_dir, variant: str = "twentieth") -> DataFrame:
    return training(spark, sf_dir, variant)[1]


def scores(spark, sf_dir) -> DataFrame:
    return evaluation.scored(asof.prerelease(proxy.forecasts(spark, sf_dir), proxy.actuals(spark, sf_dir), ["target_month", "model_key", "vintage"]))


SNAPSHOT_COLUMNS = ["release_month", "ord", "product_name", "snapshot", "price"]
METRICS = ["mae", "rmse", "bias", "direction"]


@query
def asof_strict(spark, sf_dir):
    return known(spark, sf_dir).select(*SNAPSHOT_COLUMNS)


@query
def asof_publication(spark, sf_dir):
    return asof.select_available(proxy.observations(spark, sf_dir), at(), strict=False).select(*SNAPSHOT_COLUMNS)


@query
def latest_snapshot_per_url(spark, sf_dir):
    found = asof.select_available(proxy.observations(spark, sf_dir), at(), grain=asof.SNAPSHOT)
    return found.groupBy("release_month", "ord", "source_url", "content_sha256").agg(F.count("*").alias("n_rows"))


@query
def latest_snapshot_per_period(spark, sf_dir):
    return known(spark, sf_dir).groupBy("release_month", "ord", "snapshot", "content_sha256").agg(F.count("*").alias("n_rows"))


@query
def vintage_state(spark, sf_dir):
    return asof.vintage_state(known(spark, sf_dir))


def _actuals(policy):
    def run(spark, sf_dir):
        return asof.known_actuals(proxy.actuals(spark, sf_dir), at(), policy).select("target_month", "actual_mom_pct", "published_at")

    return run


QUERIES |= {"actuals_first": _actuals("first"), "actuals_last_published": _actuals("last_published"), "actuals_last_retrieved": _actuals("last_retrieved")}


@query
def forecast_prerelease_latest(spark, sf_dir):
    found = asof.prerelease(proxy.forecasts(spark, sf_dir), proxy.actuals(spark, sf_dir), ["target_month", "model_key"])
    return found.select("target_month", "model_key", "vintage", "forecast_id", "estimate_mom_pct", "actual_mom_pct")


@query
def latest_saved_forecast(spark, sf_dir):
    return asof.latest_saved(proxy.forecasts(spark, sf_dir), at(), ["model_key"]).select("model_key", "target_month", "vintage", "forecast_id", "estimate_mom_pct")


@query
def log_price_cells(spark, sf_dir):
    names = ["p1", "p2", "p3", "c1", "c2", "c3"]
    return rounded(cells(spark, sf_dir), *names).select("product_name", "month", *names)


@query
def survey_change(spark, sf_dir):
    changes = features.survey_change(features.survey_cells(available(spark, sf_dir)))
    return rounded(changes, "change_pct").select("product_name", "month", "change_pct")


@query
def survey_change_early(spark, sf_dir):
    changes = features.survey_change(features.survey_cells(available(spark, sf_dir)), first_only=True)
    return rounded(changes, "change_pct").select("product_name", "month", "change_pct")


@query
def twentieth_change(spark, sf_dir):
    return rounded(features.twentieth_change(cells(spark, sf_dir)), "change_pct").select("product_name", "month", "change_pct")


def _timing(variant):
    def run(spark, sf_dir):
        return rounded(values(spark, sf_dir, variant), "value").select("product_name", "month", "part", "value")

    return run


QUERIES |= {"final_two_window_change": _timing("final"), "early_change": _timing("early"), "early_carry_change": _timing("early_carry")}


@query
def midpoint_imputation(spark, sf_dir):
    return rounded(features.midpoint_imputed(cells(spark, sf_dir)), "c1").where("imputed").select("product_name", "month", "c1")


@query
def global_summary(spark, sf_dir):
    return rounded(features.global_summary(features.twentieth_change(cells(spark, sf_dir)), ["month"]), "mean", "median", "sd", "missing")


@query
def category_summary(spark, sf_dir):
    return rounded(features.group_means(features.twentieth_change(cells(spark, sf_dir)), ["month", "category"], "change_pct"), "mean", "missing")


@query
def trimmed_index(spark, sf_dir):
    return rounded(features.trimmed_mean(features.twentieth_change(cells(spark, sf_dir)), ["month"]), "trimmed")


@query
def geometric_tracker(spark, sf_dir):
    return rounded(features.geometric_tracker(values(spark, sf_dir), ["month"]), "tracker")


@query
def sector_means(spark, sf_dir):
    return rounded(features.group_means(values(spark, sf_dir), ["month", "sector"], "value"), "mean", "missing")


@query
def feature_hash(spark, sf_dir):
    return features.feature_hash(available(spark, sf_dir), ["release_month"], [F.col("ord").cast("string"), F.col("content_sha256")])


@query
def product_dim(spark, sf_dir):
    found = catalog.product_dim(available(spark, sf_dir))
    return found.withColumns({c: F.col(c).cast("string") for c in ("first_seen", "last_seen")})


@query
def basket_epochs(spark, sf_dir):
    joined = lambda c: F.array_join(c, ",").alias(c)
    return catalog.basket_epochs(available(spark, sf_dir)).select("version", F.col("effective_from").cast("string"), F.col("effective_to").cast("string"), joined("products"), joined("added"), joined("removed"))


@query
def basket_at_date(spark, sf_dir):
    dates = proxy.table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("at")).distinct()
    found = catalog.basket_at(dates, catalog.basket_epochs(available(spark, sf_dir)))
    return found.select(F.col("at").cast("string").alias("held_on"), "version", "matches")


@query
def basket_membership_qa(spark, sf_dir):
    held = available(spark, sf_dir)
    return catalog.membership_gaps(held, catalog.basket_epochs(held))


@query
def basket_spans(spark, sf_dir):
    return catalog.span_versions(catalog.basket_epochs(available(spark, sf_dir)))


@query
def surrogate_ids(spark, sf_dir):
    return available(spark, sf_dir).select("product_name", "category").distinct().select("product_name", "category", rel.surrogate_id(F.col("product_name"), F.col("category")).alias("product_id"))


@query
def release_validation(spark, sf_dir):
    """Releases in which each fault occurs: a reported rate that is wrong or odd, prices that are no number or not positive,
    blank and repeated names, and too few products."""
    number, month = F.substring_index("product_name", "#", -1).cast("int"), F.substring("release_month", 6, 2).cast("int")
    at = lambda n, m: (F.col("number") == n) & (F.col("moy") == m)
    held = validation.with_changes(proxy.observations(spark, sf_dir)).withColumns({"number": number, "moy": month})
    held = held.withColumns({
        "product_name": F.when(at(11, 7), "  ").otherwise(F.col("product_name")), "change": F.when(~(F.col("number").isin(7, 13) & F.col("moy").isin(6, 9)), F.col("change")),
        "price": F.when(at(7, 6), -F.col("price")).when(~at(13, 9), F.col("price")), "reported_pct": F.col("reported_pct") + F.when(at(3, 4), 2.0).when(at(5, 5), 0.5).otherwise(0.0),
    })
    return validation.release_validation(held.unionByName(held.where(at(12, 8))), minimum_products=20)


@query
def coverage_gaps(spark, sf_dir):
    return catalog.coverage_gaps(available(spark, sf_dir))


@query
def panel_diagnostics(spark, sf_dir):
    return rounded(catalog.panel_diagnostics(available(spark, sf_dir)), "coverage")


def long_matrix(spark, sf_dir, variant: str = "twentieth") -> DataFrame:
    held, months = training(spark, sf_dir, variant)
    used = months.where("reason is null").select("month", "actual_mom_pct", "actual_published_at", "cutoff")
    return held.join(used, "month")


@query
def training_matrix_long(spark, sf_dir):
    return rounded(long_matrix(spark, sf_dir), "value").select("month", "product_name", "value", "actual_mom_pct", "cutoff")


def _matrix_of(variant):
    def run(spark, sf_dir):
        held = long_matrix(spark, sf_dir, variant)
        return rounded(held, "value").select("month", "product_name", "part", "value", "actual_mom_pct", "cutoff")

    return run


QUERIES |= {"training_matrix_final": _matrix_of("final"), "training_matrix_early": _matrix_of("early"), "training_matrix_early_carry": _matrix_of("early_carry")}


@query
def training_exclusions(spark, sf_dir):
    return matrix(spark, sf_dir).select("month", F.coalesce("reason", F.lit("used")).alias("reason"), "n_values")


@query
def training_exclusions_early(spark, sf_dir):
    return matrix(spark, sf_dir, "early").select("month", F.coalesce("reason", F.lit("used")).alias("reason"), "n_values")


def cancelled_months(spark, sf_dir) -> list[str]:
    """Months without a first window: the policy's scenario months. A few literals."""
    gaps = catalog.coverage_gaps(available(spark, sf_dir)).where("ord = 1")
    return [r.release_month for r in gaps.select("release_month").orderBy("release_month").collect()]


@query
def imputed_early_values(spark, sf_dir):
    """Early changes at the second window's time, with the midpoint where the first survey was cancelled."""
    obs = proxy.observations(spark, sf_dir)
    months = cancelled_months(spark, sf_dir)
    held = products.variant_values(obs, "early", evaluation.feature_cutoffs(obs, "final"), months).where(F.col("month").isin(*months))
    return rounded(held, "value").select("month", "product_name", "value")


@query
def feature_rows(spark, sf_dir):
    """Feature rows of the timing early_carry: how many values, what is missing, the sources and the hash over them."""
    obs = proxy.observations(spark, sf_dir)
    found = products.feature_rows(obs, "early_carry", evaluation.feature_cutoffs(obs, "early_carry"))
    return found.select("month", "n_values", F.array_join("structural_missing", ",").alias("missing"), F.size("sources").cast("long").alias("n_sources"), "feature_hash")


@query
def feature_vintages(spark, sf_dir):
    found = features.feature_vintages(available(spark, sf_dir))
    numbers = [c for c in found.columns if c.startswith(("survey_", "twentieth_")) and not c.endswith("_n")]
    return rounded(found, *numbers).drop("sources")


@query
def long_features(spark, sf_dir):
    return rounded(features.long_features(available(spark, sf_dir)), "value")


@query
def spec_columns(spark, sf_dir):
    """How many features each model of the final vintage reads, by prefix, in the order of display."""
    table = specs.spec_table(spark)
    read = specs.columns_of(features.long_features(available(spark, sf_dir)), specs.of_vintage(table, "final"))
    return specs.labelled(read.groupBy("model_key").agg(F.count("*").alias("n_features")), table).select("position", "model_key", "label", "n_features")


@query
def saved_order_features(spark, sf_dir):
    """Each later month's values in the feature order of a model that was saved at the end of 1998: new ones are not read, lost ones are null."""
    wide = features.long_features(available(spark, sf_dir)).where("feature like 'twentieth_product__%'")
    order = wide.where("month < '1999-01'").groupBy("feature").agg(F.count("value").alias("n")).withColumn("position", F.row_number().over(Window.orderBy("feature")))
    return rounded(specs.in_saved_order(wide.where("month >= '1999-01'"), order), "value").select("month", "position", "feature", "value")


def _benchmark(vintage):
    def run(spark, sf_dir):
        held = products.benchmark_values(proxy.observations(spark, sf_dir), vintage)
        return rounded(held, "change_pct").select("product_name", "month", "change_pct", "state")

    return run


QUERIES |= {"benchmark_values_early": _benchmark("early"), "benchmark_values_final": _benchmark("final")}


def raw_panel(spark, sf_dir) -> DataFrame:
    """The panel as pages name things: full-width brackets and blanks, units, ordinals before categories."""
    number = F.substring_index("product_name", "#", -1).cast("int")
    unit = F.when(number % 3 == 0, " 吨").when(number % 3 == 1, "千克").otherwise("张")
    raw = available(spark, sf_dir).withColumns({"raw_name": F.concat("product_name", F.lit(" （Ａ"), (number % 4).cast("string"), F.lit("）")), "raw_unit": F.when(number == 23, "箱").otherwise(unit), "raw_category": F.concat(F.element_at(F.array(*map(F.lit, "一二三四五")), number % 5 + 1), F.lit("、"), F.col("category"))})
    return raw.drop("product_name", "category")


@query
def canonical_panel(spark, sf_dir):
    found = products.canonical(raw_panel(spark, sf_dir))
    dates = {c: F.col(c).cast("string") for c in ("period_start", "period_end", "period_midpoint")}
    return found.withColumns(dates).select("product_id", "product_name", "product_specification", "continuity_group", "unit", "category", "absolute_price", "observation_period", *dates, "status")


@query
def canonical_release_qa(spark, sf_dir):
    return products.release_qa(products.canonical(raw_panel(spark, sf_dir)), 25)


@query
def eligible_origins(spark, sf_dir):
    return evaluation.eligible_origins(matrix(spark, sf_dir)).groupBy("month").agg(F.count("*").alias("n_train"), F.max("train_month").alias("training_end"))


@query
def fold_table(spark, sf_dir):
    return evaluation.fold_table(matrix(spark, sf_dir))


@query
def baseline_forecasts(spark, sf_dir):
    return evaluation.baselines(matrix(spark, sf_dir))


@query
def masked_panel(spark, sf_dir):
    return rounded(features.masked(values(spark, sf_dir)), "value").select("product_name", "month", "masked", "value")


@query
def error_summary(spark, sf_dir):
    return scored_metrics(evaluation.error_summary(scores(spark, sf_dir), ["model_key", "vintage"]))


@query
def metric_bundle(spark, sf_dir):
    return scored_metrics(evaluation.metric_bundle(scores(spark, sf_dir), ["model_key"]), "median_ae", "max_ae")


@query
def rolling_eval_6_12_24(spark, sf_dir):
    return scored_metrics(evaluation.rolling_evaluation(scores(spark, sf_dir), ["model_key", "vintage"]))


@query
def regime_metrics(spark, sf_dir):
    return scored_metrics(evaluation.regime_metrics(scores(spark, sf_dir), ["model_key"]))


def final_scores(spark, sf_dir):
    return scores(spark, sf_dir).where("vintage = 'final'")


@query
def paired_losses(spark, sf_dir):
    return scored_metrics(evaluation.paired_losses(final_scores(spark, sf_dir)), "mean_difference", "win_rate")


@query
def model_range(spark, sf_dir):
    return rounded(evaluation.model_range(proxy.forecasts(spark, sf_dir), ["target_month", "vintage"]), "median", "low", "high")


@query
def panel_gap(spark, sf_dir):
    return rounded(evaluation.panel_gap(proxy.forecasts(spark, sf_dir), ["target_month", "vintage"], "sector_first", "product_ridge"), "a", "b", "gap")


@query
def out_of_range_features(spark, sf_dir):
    return evaluation.out_of_range(values(spark, sf_dir), "1998-01")


def registry_halves(spark, sf_dir):
    """Forecasts stored so far, and an incoming batch that repeats some of them, partly with another value."""
    every = proxy.forecasts(spark, sf_dir).select(*registry.KEY, "estimate_mom_pct")
    stored = every.where("target_month < '1999-01'")
    return stored, every.where("target_month >= '1998-07'").withColumn("estimate_mom_pct", F.when((F.col("target_month") == "1998-08") & (F.col("model_key") == "boosting"), F.round(F.col("estimate_mom_pct") + 1, 6)).otherwise(F.col("estimate_mom_pct")))


def offending_batch(spark, sf_dir):
    """The stored forecasts, and a batch with repeats (fine), values that differ by less than the tolerance (fine), nulls,
    two values for a key, and values that are stored otherwise."""
    stored, incoming = registry_halves(spark, sf_dir)
    value, of = F.col("estimate_mom_pct"), lambda month, model: (F.col("target_month") == month) & (F.col("model_key") == model)
    changed = F.when(of("1998-09", "no_change") | of("1999-04", "sector_first"), F.lit(None).cast("double")).when(of("1998-10", "product_ridge"), value + 1e-13).otherwise(value)
    twice = incoming.where(of("1999-02", "persistence")).withColumn("estimate_mom_pct", F.round(value + 8, 6))
    return stored, incoming.withColumn("estimate_mom_pct", changed).unionByName(incoming.where("target_month = '1999-03'")).unionByName(twice)


@query
def registry_conflicts(spark, sf_dir):
    found = registry.conflicts(*offending_batch(spark, sf_dir))
    return rounded(found, "lowest", "highest", "stored_value").drop("feature_hash")


@query
def idempotent_append(spark, sf_dir):
    """What is stored after the batch without the keys that must be refused."""
    stored, incoming = offending_batch(spark, sf_dir)
    held = registry.append(stored, incoming.join(registry.conflicts(stored, incoming).select(*registry.KEY), registry.KEY, "left_anti"))
    return held.groupBy("model_key", "vintage").agg(F.count("*").alias("n"), r6(F.sum("estimate_mom_pct")).alias("total"))


@query
def appended_actuals(spark, sf_dir):
    """Released values after a batch that repeats the first values, once again, and brings revisions."""
    every = proxy.actuals(spark, sf_dir).select("target_month", "content_sha256", "actual_mom_pct", "published_at")
    stored = proxy.actuals(spark, sf_dir).where("version = 1 and target_month < '1999-01'").select(*every.columns)
    held = registry.append_actuals(stored, every.unionByName(every.where("target_month >= '1998-01'")))
    return held.groupBy("target_month").agg(F.count("*").alias("n"), r6(F.min_by("actual_mom_pct", "published_at")).alias("first"), r6(F.max_by("actual_mom_pct", "published_at")).alias("last"))


@query
def rebuilt_audit(spark, sf_dir):
    stored, incoming = registry_halves(spark, sf_dir)
    changed = registry.changed_values(stored, incoming, ["target_month", "vintage", "model_key"], "estimate_mom_pct")
    return changed.groupBy("change", "model_key").agg(F.count("*").alias("n"))


@query
def journal_chain_check(spark, sf_dir):
    return registry.chain_breaks(proxy.journal(spark, sf_dir, intact=False)).select("sequence", "fault", "kind")


@query
def journal_replay(spark, sf_dir):
    return registry.replay_champions(proxy.journal(spark, sf_dir))


@query
def journal_cycles(spark, sf_dir):
    return registry.replay_cycles(proxy.journal(spark, sf_dir))


def fresh_scores(spark, sf_dir) -> DataFrame:
    return scores(spark, sf_dir).where(F.col("target_month") >= SINCE)


@query
def drift_trigger(spark, sf_dir):
    """Outcomes since each model's last comparison: three models were compared a few months ago, others never."""
    line = Window.partitionBy("model_key", "vintage").orderBy(F.col("target_month").desc())
    since = F.when(F.col("model_key") == "persistence", 3).when(F.col("model_key") == "sector_first", 10).when(F.col("model_key") == "product_ridge", 4).otherwise(1000)
    held = fresh_scores(spark, sf_dir).withColumn("k", F.row_number().over(line)).where(F.col("k") <= since)
    found = registry.drift_triggers(held, proxy.saved_metrics(spark, sf_dir, SINCE), ["model_key", "vintage"])
    return scored_metrics(found, "recent_mae", "recent_bias")


@query
def drift_diagnosis(spark, sf_dir):
    """The months since the models were put to use: values outside the range of training, short histories, missing ones."""
    held = values(spark, sf_dir)
    missing = held.where(F.col("month") >= SINCE).groupBy("month").agg(F.count_if(F.col("value").isNull()).alias("structural_missing"))
    return evaluation.out_of_range(held, SINCE).join(missing, "month")


@query
def trial_pairs(spark, sf_dir):
    found = registry.matched_pairs(fresh_scores(spark, sf_dir), CHAMPION)
    return found.select("vintage", "model_key", "target_month", r6("error").alias("error"), r6("old").alias("old_error"))


@query
def promotion_interval(spark, sf_dir):
    """The descriptive interval of each challenger's loss difference over its first six months."""
    pairs = registry.matched_pairs(fresh_scores(spark, sf_dir), CHAMPION)
    line = Window.partitionBy("vintage", "model_key").orderBy("target_month")
    first = pairs.withColumn("r", F.row_number().over(line)).where("r <= 6")
    d = first.select(F.col("model_key").alias("model_a"), F.col("vintage").alias("model_b"), "target_month", (F.abs("error") - F.abs("old")).alias("d"))
    found = rounded(models.block_bootstrap(d, length=2, draws=2000), "mean_difference", "low", "high", places=9)
    return found.withColumnsRenamed({"model_a": "model_key", "model_b": "vintage"})


@query
def late_forecasts(spark, sf_dir):
    found = registry.late_forecasts(proxy.forecasts(spark, sf_dir), proxy.actuals(spark, sf_dir))
    return found.select("target_month", "model_key", "vintage", "forecast_id")


@query
def forecast_audit(spark, sf_dir):
    """Saved forecasts of which every seventh month was changed afterwards, against what the models give again."""
    again = proxy.forecasts(spark, sf_dir)
    month = F.substring("target_month", 6, 2).cast("int")
    saved = again.withColumn("estimate_mom_pct", F.when(month % 7 == 0, F.round(F.col("estimate_mom_pct") + 0.001, 6)).otherwise(F.col("estimate_mom_pct")))
    return registry.changed_predictions(saved, again, ["forecast_id"]).select("forecast_id", r6("saved").alias("saved"), r6("again").alias("again"))


@query
def composite_bundle(spark, sf_dir):
    """The models in use, with the promoted ones in place of their predecessors, and the label of each."""
    active = proxy.saved_metrics(spark, sf_dir, SINCE).select("vintage", "model_key", F.lit("first").alias("bundle"))
    promoted = registry.promotion_decisions(fresh_scores(spark, sf_dir), CHAMPION).where("promoted").select("vintage", "model_key", F.lit("trial").alias("bundle"))
    found = registry.composite_bundle(active, promoted, ["vintage", "model_key"])
    return found.select(specs.spec_key("vintage", "model_key").alias("key"), "bundle", specs.is_active(F.col("model_key")).alias("active"))


BUNDLES = {"complete": "final", "core": "early", "no_direct": "final", "no_ridge": "final", "short": "final", "broken": "final", "unlabelled": "final", "few_months": "final", "late": "final"}


@query
def bundle_checks(spark, sf_dir):
    """Bundles that pass and bundles that fail each check. A specified model has the scores of one of the saved ones."""
    bundle = lambda *names: F.col("bundle").isin(*names)
    named = spark.createDataFrame(list(BUNDLES.items()), "bundle string, bundle_vintage string")
    line = Window.partitionBy("model_key").orderBy(F.col("target_month").desc())
    ranked = final_scores(spark, sf_dir).withColumn("k", F.row_number().over(line))
    table = specs.spec_table(spark)
    keys = F.element_at(F.array(*(F.lit(m[0]) for m in proxy.MODELS)), F.col("position") % 5 + 1)
    wanted = named.join(table, F.expr("array_contains(vintages, bundle_vintage)")).select("bundle", "bundle_vintage", F.col("model_key").alias("spec"), keys.alias("model_key"))
    wanted = wanted.where(~(bundle("no_direct") & (F.col("spec") == "twentieth_to_twentieth_direct")) & ~(bundle("no_ridge") & (F.col("spec") == "product_level_ridge")))
    held = wanted.join(ranked, "model_key").where(~bundle("short") | (F.col("k") <= 8))
    fits = evaluation.error_summary(held, ["bundle", "bundle_vintage", "spec"]).withColumnsRenamed({"bundle_vintage": "vintage", "spec": "model_key"})
    fits = fits.withColumn("mae", F.when(bundle("broken") & (F.col("model_key") == "random_forest"), float("nan")).otherwise(F.col("mae")))
    used = matrix(spark, sf_dir).where("reason is null")
    last = used.agg(F.max("month").alias("last"))
    rows = named.select("bundle").join(used.join(last), ~bundle("few_months") | (F.col("month") < "1997-01"))
    late = F.when(bundle("late") & (F.col("month") == F.col("last")), F.col("cutoff")).otherwise(F.col("actual_published_at"))
    status = F.when(~bundle("unlabelled"), "pseudo_real_time")
    return specs.bundle_checks(fits, rows.withColumns({"actual_published_at": late, "realtime_status": status}), table)


@query
def promotion_decision(spark, sf_dir):
    found = registry.promotion_decisions(fresh_scores(spark, sf_dir), CHAMPION)
    return scored_metrics(found, *(c for c in found.columns if c.endswith(("_mae", "_rmse", "_bias")) and not c.startswith("rule_")), "win_rate")


@query
def lifecycle_events(spark, sf_dir):
    return lifecycle.cycle_events(fresh_scores(spark, sf_dir), proxy.saved_metrics(spark, sf_dir, SINCE), CHAMPION, at()).drop("event_id")


@query
def lifecycle_champions(spark, sf_dir):
    events = lifecycle.cycle_events(fresh_scores(spark, sf_dir), proxy.saved_metrics(spark, sf_dir, SINCE), CHAMPION, at())
    return lifecycle.champions(events, CHAMPION)


def release_pages(spark, sf_dir):
    """Release pages as they would be scraped: title, stamp and price table of each stored snapshot, made from the panel.

    A product's first release has a dash for its change, and one release in sixteen is a challenge page.
    """
    cell = lambda *c: F.concat(F.lit("<td>"), F.concat(*c), F.lit("</td>"))
    dash = lambda c, form: F.coalesce(F.format_string(form, c), F.lit("-"))
    obs = validation.with_changes(proxy.observations(spark, sf_dir))
    row = F.concat(F.lit("<tr>"), cell(F.col("product_name")), cell(F.lit("&nbsp;t ")), cell(F.format_string("%.4f", "price")), cell(dash(F.col("change"), "%.4f")), cell(dash(F.col("reported_pct"), "%.1f")), F.lit("</tr>"))
    roman = F.element_at(F.array(*map(F.lit, ("I. ", "II. ", "III. ", "IV. ", "V. "))), F.substring("category", 2, 1).cast("int") + 1)
    rows = F.transform(F.array_sort(F.collect_list(F.struct("category", "product_name", F.concat(roman, "category").alias("head"), row.alias("row")))), lambda x: F.concat(F.lit("<tr><td colspan=5>"), x.head, F.lit("</td></tr>"), x.row))
    title = F.concat_ws(" ", F.lit("Market prices"), F.first("release_month"), F.concat(F.lit("("), F.first("window"), F.lit(")")))
    table = F.concat(F.lit("<h1>"), title, F.lit("</h1><p>"), F.date_format(F.first("published_at") + F.expr("INTERVAL '8' HOUR"), "yyyy/MM/dd HH:mm"), F.lit("</p><table><tr><th>menu</th></tr></table><table><tr><th>Product</th><th>Unit</th><th>Price</th><th>Change</th><th>%</th></tr>"), F.array_join(rows, ""), F.lit("</table>"))
    odd = F.col("content_sha256").startswith("0")
    pages = obs.groupBy("source_url", "content_sha256").agg(title.alias("title"), table.alias("page"), F.first("retrieved_at").alias("retrieved_at"))
    return pages.select(F.concat_ws("#", "source_url", F.substring("content_sha256", 1, 8)).alias("source_url"), "title", F.when(odd, "<p>Please enable JavaScript and refresh the page</p>").otherwise(F.col("page")).alias("html"), "retrieved_at")


@query
def html_price_extract(spark, sf_dir):
    return ingest.extract_prices(release_pages(spark, sf_dir)).select("source_url", "category", "product_name", "unit", "price", "change", "change_pct")


@query
def ingested_pages(spark, sf_dir):
    """New snapshots of a landing zone in which the releases before 1998 are stored already."""
    pages = release_pages(spark, sf_dir)
    stored = pages.where("title < 'Market prices 1998'").select("source_url", F.sha2("html", 256).alias("content_sha256"))
    new, errors = ingest.ingest(stored, pages)
    return new.select("source_url", "release_month", "window", F.col("published_at").cast("timestamp_ntz").alias("published_at"), F.lit("stored").alias("outcome")).unionByName(errors.select("source_url", F.col("reason").alias("outcome")), allowMissingColumns=True)


@query
def release_links(spark, sf_dir):
    """Links of an index page of all releases, by title, and those of a range of months."""
    link = F.concat(F.lit('<li><a class="t" href="'), F.col("source_url"), F.lit('">'), F.col("title"), F.lit("</a></li>"))
    index = release_pages(spark, sf_dir).groupBy(F.substring("title", 15, 4)).agg(F.array_join(F.collect_list(link), "").alias("html"))
    return ingest.link_range(ingest.discovered_links(index), "1996-03", "1999-02").select("url", "title", "kind", "month")


@query
def release_titles(spark, sf_dir):
    title = F.concat(F.lit("Prices of goods, "), F.regexp_replace("release_month", "-0?", "–"), F.lit(" ("), F.regexp_replace("window", "-", "—"), F.lit(")"))
    rows = proxy.observations(spark, sf_dir).select("release_month", "window", title.alias("title")).distinct()
    month, window = rel.title_month_window(F.col("title"))
    return rows.select("title", month.alias("month"), window.alias("window"))


def headlines(spark, sf_dir) -> DataFrame:
    """target_month, version and the text of each released rate."""
    way = F.when(F.col("actual_mom_pct") > 0, "rose").when(F.col("actual_mom_pct") < 0, "fell").otherwise("was unchanged")
    text = F.concat(F.lit("Producer prices month-on-month "), way, F.lit(" by "), F.format_string("%.2f", F.abs("actual_mom_pct")), F.lit("%, year-on-year up 9.9%"))
    return proxy.actuals(spark, sf_dir).select("target_month", "version", text.alias("text"))


@query
def headline_changes(spark, sf_dir):
    return headlines(spark, sf_dir).select("target_month", "version", ingest.headline_change(F.col("text")).alias("headline"))


@query
def page_links(spark, sf_dir):
    """Links of all kinds: of the raw pages, of an index of the releases, and of the headlines' pages."""
    link = lambda url, title: F.concat(F.lit('<a href="'), url, F.lit('">'), title, F.lit("</a>"))
    released = release_pages(spark, sf_dir).select(link(F.col("source_url"), F.col("title")).alias("html"))
    rates = headlines(spark, sf_dir).select(link(F.concat_ws("/", F.lit("https://stats.example.org/ppi"), "target_month", F.col("version").cast("string")), F.col("text")).alias("html"))
    links = ingest.discovered_links(proxy.table(spark, sf_dir, "pages").select("html").unionByName(released).unionByName(rates))
    return links.groupBy("kind").agg(F.count("*").alias("n"))


@query
def page_hosts(spark, sf_dir):
    url = F.col("url")
    pages = proxy.table(spark, sf_dir, "pages")
    return pages.select("page_id", rel.allowed_url(url, "blog.thths.example.com", "/").alias("allowed"), ingest.is_challenge(F.col("html")).alias("challenge"))


@query
def status_counts(spark, sf_dir):
    obs, act, fc = proxy.observations(spark, sf_dir), proxy.actuals(spark, sf_dir), proxy.forecasts(spark, sf_dir)
    count = lambda df, name, last: df.agg(F.lit(name).alias("kind"), F.count("*").alias("n"), F.max(last).alias("last"))
    return count(obs, "observations", "release_month").unionByName(count(act, "actuals", "target_month")).unionByName(count(fc, "forecasts", "target_month"))


def fits(spark, sf_dir, model: str = "product_ridge", **more) -> DataFrame:
    rows = models.wide_rows(long_matrix(spark, sf_dir))
    return models.fit_origins(rows, evaluation.eligible_origins(matrix(spark, sf_dir)), model, **more)


PREDICTED = ["month", "model_key", "status", "estimate_mom_pct", "actual_mom_pct", "n_train", "training_end", "penalty", "least_history", "window"]


@query
def nested_cv_predictions(spark, sf_dir):
    return fits(spark, sf_dir).select(*PREDICTED)


@query
def stable_panel_predictions(spark, sf_dir):
    return fits(spark, sf_dir, stable=True).select(*PREDICTED)


@query
def sector_first_predictions(spark, sf_dir):
    return fits(spark, sf_dir, "sector_first").select(*PREDICTED)


@query
def benchmark_ridge_predictions(spark, sf_dir):
    return fits(spark, sf_dir, "benchmark_ridge").select(*PREDICTED)


@query
def strength_ridge_predictions(spark, sf_dir):
    return fits(spark, sf_dir, "strength_ridge").select(*PREDICTED)


@query
def adaptive_window_predictions(spark, sf_dir):
    return fits(spark, sf_dir, windows=ridge.WINDOWS).select(*PREDICTED)


@query
def refit_comparison(spark, sf_dir):
    """All history against a chosen window, on the months that both could predict."""
    return models.compared_fits(fits(spark, sf_dir), fits(spark, sf_dir, windows=ridge.WINDOWS))


def grown(spark, sf_dir, model: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(long matrix, origins, leaves of each origin's ensemble), each written once, as a saved model and its data are."""
    held = files.stored(long_matrix(spark, sf_dir), "long-matrix")
    origins = files.stored(evaluation.eligible_origins(matrix(spark, sf_dir)), "origins")
    return held, origins, files.stored(trees.grow_origins(models.wide_rows(held), origins, model), f"{model}-leaves")


def _ensemble(model):
    def run(spark, sf_dir):
        held, origins, leaves = grown(spark, sf_dir, model)
        known = origins.groupBy("month").agg(F.count("*").alias("n_train"), F.max("train_month").alias("training_end"))
        found = known.join(held.select("month", "actual_mom_pct").distinct(), "month").join(trees.ensemble_predictions(leaves, held), "month", "left")
        status = F.when(F.col("estimate").isNull(), "short_history").otherwise("fitted")
        found = rounded(found.withColumn("status", status).withColumn("model_key", F.lit(model)), "estimate", "baseline")
        return found.select("month", "model_key", "status", "n_train", "training_end", F.col("estimate").alias("estimate_mom_pct"), "baseline", "actual_mom_pct")

    return run


QUERIES |= {"boosted_origin_predictions": _ensemble("boosting"), "forest_origin_predictions": _ensemble("forest")}


@query
def tree_attribution(spark, sf_dir):
    """Each product's part in each month's boosted estimate, beside the baseline and the estimate that they add up to."""
    held, _, leaves = grown(spark, sf_dir, "boosting")
    parts = trees.tree_attributions(leaves, held).join(trees.ensemble_predictions(leaves, held), ["month", "model_key"])
    return rounded(parts, "contribution", "baseline", "estimate", places=9).select("month", "product_name", "contribution", "baseline", "estimate")


@query
def hybrid_origin_predictions(spark, sf_dir):
    """The equal mean of the ridge and the boosted estimate of each origin that has both."""
    boosted = QUERIES["boosted_origin_predictions"](spark, sf_dir).where("status = 'fitted'")
    return rounded(models.hybrid(fits(spark, sf_dir).where("status = 'fitted'"), boosted), "estimate_mom_pct")


def contributions(spark, sf_dir) -> DataFrame:
    return evaluation.attributions(long_matrix(spark, sf_dir).select("month", "product_name", "sector", "value"), models.coefficients(fits(spark, sf_dir)))


@query
def top_k_attribution(spark, sf_dir):
    return rounded(evaluation.top_k(contributions(spark, sf_dir), ["month"], 6), "contribution").select("month", "rank", "product_name", "contribution")


@query
def attribution_groups(spark, sf_dir):
    return rounded(contributions(spark, sf_dir).groupBy("month", "sector").agg(F.sum("contribution").alias("contribution")), "contribution")


@query
def newest_training_months(spark, sf_dir):
    """What is left of each origin's training months with a window of 24."""
    kept = evaluation.newest_months(evaluation.eligible_origins(matrix(spark, sf_dir)), 24)
    return kept.groupBy("month").agg(F.count("*").alias("n_train"), F.min("train_month").alias("training_start"))


@query
def historical_baselines(spark, sf_dir):
    return evaluation.simple_baselines(first_actuals(spark, sf_dir))


@query
def direct_tracker_predictions(spark, sf_dir):
    held = long_matrix(spark, sf_dir)
    return rounded(models.direct_tracker(held, evaluation.eligible_origins(matrix(spark, sf_dir))), "estimate_mom_pct")


def _split(spark, sf_dir):
    """(train, test, features): products come from the catalog, so that no product is left out."""
    long = long_matrix(spark, sf_dir)
    names = [r.product_name for r in long.select("product_name").distinct().orderBy("product_name").collect()]  # one dimension
    rows = models.wide(long, names)
    columns = [c for c in rows.columns if c.startswith(("price__", "missing__"))]
    return rows.where("month < '2000-01'"), rows.where("month >= '2000-01'"), columns


@query
def ridge_predictions(spark, sf_dir):
    return models.fit_predict(*_split(spark, sf_dir), "ridge")


@query
def forest_predictions(spark, sf_dir):
    return models.fit_predict(*_split(spark, sf_dir), "forest")


@query
def gbt_predictions(spark, sf_dir):
    train, test, names = _split(spark, sf_dir)
    boosted = models.fit_predict(train, test, names, "boosting")
    return boosted.unionByName(models.hybrid(models.fit_predict(train, test, names, "ridge"), boosted))


@query
def block_bootstrap_ci(spark, sf_dir):
    s = final_scores(spark, sf_dir).select("target_month", "model_key", F.abs("error").alias("loss"))
    other = s.select("target_month", F.col("model_key").alias("model_b"), F.col("loss").alias("lb"))
    pairs = s.join(other, "target_month").where("model_key < model_b").select(F.col("model_key").alias("model_a"), "model_b", "target_month", (F.col("loss") - F.col("lb")).alias("d"))
    return rounded(models.block_bootstrap(pairs), "mean_difference", "low", "high", places=9)


@query
def hourly_events(spark, sf_dir):
    """Events by hour and type, as a stream of what has arrived closes them: hours beyond the watermark are not out yet."""
    where = files.run_path(spark, "hourly-events")
    stream = arrivals.stream_table(spark, sf_dir, proxy.table(spark, sf_dir, "events").schema, "events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    arrivals.append_to(arrivals.hourly_events(stream), f"{where}/out", f"{where}/marks").awaitTermination()
    found = spark.read.schema("hour timestamp, event_type string, n long, value double").parquet(f"{where}/out")
    return found.select(F.col("hour").cast("timestamp_ntz").alias("hour"), "event_type", "n", r6("value").alias("value"))


PENALTIES = {"champion": 100.0, "challenger": 10.0}


def trial_store(spark, sf_dir) -> dict[str, DataFrame]:
    """What a trial keeps: frozen features, the versioned coefficient table, and both models' forecasts, each written once.

    The champion was fitted at the first origin with enough months since it was put to use; the challenger is fitted
    again at the first origin of each later year, and the newest one by then forecasts.
    """
    held, months = training(spark, sf_dir)
    months = files.stored(months, "trial-months")
    used = months.where("reason is null").select("month", "actual_mom_pct", "actual_published_at", "cutoff")
    features = files.stored(held.join(used, "month"), "trial-features")
    origins = files.stored(evaluation.eligible_origins(months), "trial-origins")
    ready = origins.groupBy("month").agg(F.count("*").alias("n")).where((F.col("n") >= 24) & (F.col("month") >= SINCE)).select("month")
    start = ready.agg(F.min("month").alias("version"))
    later = ready.join(start, F.col("month") > F.col("version")).groupBy(F.substring("month", 1, 4)).agg(F.min("month").alias("version")).select("version")
    versions = files.stored(start.withColumn("role", F.lit("champion")).unionByName(later.withColumn("role", F.lit("challenger"))), "trial-versions")
    fitted = saved.marginal_models(features, origins.join(versions.select(F.col("version").alias("month")), "month", "left_semi").select(F.col("month").alias("version"), F.col("train_month").alias("month")), PENALTIES)
    table = files.stored(fitted.join(versions.withColumnRenamed("role", "model_key"), ["version", "model_key"], "left_semi"), "trial-models")
    of = lambda role: saved.newest_version(ready, versions.where(F.col("role") == role).select("version")).withColumn("model_key", F.lit(role))
    forecasts = files.stored(saved.matched_forecasts(features, table, of("champion"), of("challenger")), "trial-forecasts")
    return {"features": features, "models": table, "forecasts": forecasts, "months": used, "origins": origins, "versions": versions}


@query
def saved_coefficients(spark, sf_dir):
    return rounded(trial_store(spark, sf_dir)["models"], "centre", "scale", "weight", "bias")


@query
def matched_forecasts(spark, sf_dir):
    return rounded(trial_store(spark, sf_dir)["forecasts"], "estimate")


def damaged(store: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """A store that was changed afterwards: forecasts of July, features of one product in March, and a lost version."""
    month = F.substring("month", 6, 2)
    shifted = F.when((month == "03") & F.col("product_name").endswith("#11"), F.col("value") + 1).otherwise(F.col("value"))
    return store | {
        "forecasts": store["forecasts"].withColumn("estimate", F.when(month == "07", F.col("estimate") + 1e-6).otherwise(F.col("estimate"))),
        "features": store["features"].withColumn("value", shifted), "models": store["models"].where("not (model_key = 'challenger' and version like '1999%')"),
    }


@query
def reprediction_faults(spark, sf_dir):
    store = damaged(trial_store(spark, sf_dir))
    return rounded(saved.reprediction_faults(store["forecasts"], store["models"], store["features"]), "saved", "again")


@query
def trial_scores(spark, sf_dir):
    """The trial's months as they are scored: without those that the store does not give again."""
    store = damaged(trial_store(spark, sf_dir))
    faults = saved.reprediction_faults(store["forecasts"], store["models"], store["features"])
    times = store["months"]
    found = saved.score_trial(store["forecasts"], times.select("month", "actual_mom_pct", "actual_published_at"), times.select("month", "cutoff"), faults)
    return rounded(found, "champion_error", "challenger_error")


@query
def stress_metrics(spark, sf_dir):
    held, months = training(spark, sf_dir)
    months = files.stored(months, "stress-months")
    features = files.stored(held.join(months.where("reason is null").select("month", "actual_mom_pct"), "month"), "stress-features")
    train, tests = saved.fold_months(months)
    table = files.stored(saved.marginal_models(features, train, {"marginal_10": 10.0, "marginal_100": 100.0, "marginal_1600": 1600.0}), "stress-models")
    return scored_stress(saved.stress_metrics(table, tests, features))


@query
def stress_metrics_ridge(spark, sf_dir):
    """The same of one ridge over all products, fitted once a fold."""
    held, months = training(spark, sf_dir)
    months = files.stored(months, "stress-months")
    features = files.stored(held.join(months.where("reason is null").select("month", "actual_mom_pct"), "month"), "stress-features")
    train, tests = saved.fold_months(months)
    return scored_stress(saved.stress_metrics(files.stored(saved.ridge_models(features, train), "stress-models"), tests, features))


def scored_stress(df: DataFrame) -> DataFrame:
    return rounded(df, *(c for c in df.columns if c not in ("model_key", "n", "n_moved")))


def lifecycle_arrivals(spark, sf_dir) -> DataFrame:
    """The events as a lifecycle's, a week of a user as a cycle; some come five days late and some are of no known kind."""
    events = proxy.table(spark, sf_dir, "events")
    number = F.get_json_object("props", "$.k").cast("long")
    kind = F.when(F.col("event_id") % 29 == 6, "renamed").otherwise(F.element_at(F.array(*map(F.lit, proxy.EVENT_KINDS)), (number % 8 + 1).cast("int")))
    at = F.when(F.col("event_id") % 23 == 4, F.col("ts") - F.expr("INTERVAL '5' DAY")).otherwise(F.col("ts"))
    week = F.floor(F.dayofyear("ts") / 7).cast("string")
    return events.select(F.col("event_id").alias("sequence"), F.col("user_id").cast("string").alias("key"), F.concat_ws("-", F.col("user_id").cast("string"), week).alias("cycle_id"), kind.alias("kind"), at.alias("as_of"))


@query
def lifecycle_stream(spark, sf_dir):
    """Every event's outcome as a stream that arrives in four files, judged against the state carried from file to file."""
    where = files.run_path(spark, "lifecycle-stream")
    events = lifecycle_arrivals(spark, sf_dir)
    quarter = F.floor(4 * F.col("sequence") / (events.agg(F.max("sequence")).first()[0] + 1))
    for k in range(4):  # one after the other, as files arrive
        events.where(quarter == k).coalesce(1).write.mode("append").parquet(f"{where}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")
    arrivals.append_to(carried.judged_stream(stream), f"{where}/out", f"{where}/marks").awaitTermination()
    return spark.read.schema(carried.JUDGED).parquet(f"{where}/out").select("sequence", "key", "kind", "outcome")


@query
def landed_pages(spark, sf_dir):
    """Release pages as raw files that arrive in two lots, the second with copies under other names, new pages, and archives
    of pages without an address and pages that are no release; each stored address with the prices that were read, each
    fault once."""
    where = files.run_path(spark, "landing")
    page = F.concat(F.lit('<link rel="canonical" href="'), "source_url", F.lit('">'), "html")
    pages = files.stored(release_pages(spark, sf_dir).select("source_url", "title", page.alias("raw")), "raw-pages")
    old = F.substring("title", 15, 4) < "1998"
    html = F.concat(F.lit("<h1>"), F.col("page_id").cast("string"), F.lit("</h1>"))
    others = proxy.table(spark, sf_dir, "pages").select(F.when(F.col("page_id") % 5 == 0, html).otherwise(F.concat(F.lit('<link rel="canonical" href="'), F.coalesce("url", F.lit("none")), F.lit('">'), html)).alias("raw"))
    for k, lot in enumerate((pages.where(old), pages)):
        # a page a file; the releases are few whatever the input, the other pages grow with it
        named = lot.select("raw", F.lit(k).alias("lot")).repartition(8)
        named.write.partitionBy("lot").option("maxRecordsPerFile", 1).option("lineSep", "\r").mode("append").text(f"{where}/in")
        if k:
            others.select(F.encode("raw", "UTF-8").alias("content")).write.option("maxRecordsPerFile", 1000).parquet(f"{where}/in/archives")
        arrived = landing.landed_files(spark, f"{where}/in", "*.txt", 400).select("content", "modificationTime").union(landing.landed_archives(spark, f"{where}/in", "*.parquet", 400))
        landing.ingest_landing(arrived, where).awaitTermination()
    prices = landing.batches(spark, where, "prices", ingest.ROWS).groupBy("source_url").agg(F.count("price").alias("n_prices"))
    stored = landing.batches(spark, where, "snapshots", landing.SNAPSHOT).join(prices, "source_url", "left")
    done = stored.select("source_url", "release_month", "window", F.lit("stored").alias("outcome"), F.coalesce("n_prices", F.lit(0).cast("long")).alias("n_prices"))
    faults = landing.batches(spark, where, "errors", landing.ERROR).select("source_url", F.col("reason").alias("outcome"), F.lit(0).cast("long").alias("n_prices")).distinct()
    return done.unionByName(faults, allowMissingColumns=True)


class Interrupted(Exception):
    """What stands for a crash below."""


@query
def published_bundle(spark, sf_dir):
    """What readers see after the models in use, then the bundle with the promoted ones, were published, the latter cut off
    before its pointer and recovered, and a third that was cut off in the middle and dropped."""
    root = files.run_path(spark, "bundles")
    start = proxy.saved_metrics(spark, sf_dir, SINCE).select("vintage", "model_key", F.lit("first").alias("bundle"))
    promoted = registry.promotion_decisions(fresh_scores(spark, sf_dir), CHAMPION).where("promoted").select("vintage", "model_key", F.lit("trial").alias("bundle"))

    def cut_off(name, df, step):
        def stop(done):
            if done == step:
                raise Interrupted

        try:
            publish.publish(spark, root, name, {"models": df}, stop)
        except Interrupted:
            publish.recover(spark, root)

    publish.publish(spark, root, "first", {"models": start})
    cut_off("trial", registry.composite_bundle(start, promoted, ["vintage", "model_key"]), "manifest")
    cut_off("lost", start.limit(0), "table models")
    return publish.read_active(spark, root, "models").select(specs.spec_key("vintage", "model_key").alias("key"), "bundle", F.lit(publish.active(spark, root)).alias("active_bundle"))


VARIANTS = ("twentieth", "final", "early", "early_carry")


def grid_inputs(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(values, months, origins) of all timings, each written once."""
    each = {v: training(spark, sf_dir, v) for v in VARIANTS}
    feature = F.concat_ws("__", "part", "product_name").alias("feature")
    join = lambda frames: functools.reduce(DataFrame.unionByName, frames)
    months = files.stored(join([m.withColumn("variant", F.lit(v)) for v, (_, m) in each.items()]), "grid-months")
    values = files.stored(join([h.select(F.lit(v).alias("variant"), "month", feature, "value") for v, (h, _) in each.items()]), "grid-values")
    used = months.where("reason is null")
    origins = join([evaluation.eligible_origins(used.where(F.col("variant") == v)).select(F.lit(v).alias("variant"), "month", "train_month") for v in VARIANTS])
    return values.join(used.select("variant", "month"), ["variant", "month"], "left_semi"), gram.numbered_months(months), files.stored(origins, "grid-origins")


@query
def candidate_grid_predictions(spark, sf_dir):
    """Every timing, panel and origin in one job: normal equations are looked up in sums that run over the months."""
    values, months, origins = grid_inputs(spark, sf_dir)
    cells = files.stored(gram.month_cells(values, months), "grid-cells")
    table = files.stored(gram.gram_table(gram.pair_sums(cells)), "grid-sums")
    return rounded(gram.grid_predictions(values, months, origins, table, cells), "estimate_mom_pct")


@query
def gram_sums(spark, sf_dir):
    """The sums that the grid looks up, of each timing's last month but one: per pair of features, rounded."""
    values, months, _ = grid_inputs(spark, sf_dir)
    last = months.groupBy("variant").agg((F.max("r") - 1).alias("r"))
    found = gram.pair_sums(gram.month_cells(values, months)).join(last, ["variant", "r"], "left_semi")
    return rounded(found.where(F.col("f") != F.col("g")), "xy", "x", "y", places=4).select("variant", "f", "g", "xy", "x", "y", F.col("n").cast("long").alias("n"))


@query
def quality_violations(spark, sf_dir):
    """Every rule that a saved forecast breaks, in a store with models that were fitted too late, lost or changed, changed
    features, and sources that were retrieved after the forecast was frozen."""
    obs, store = proxy.observations(spark, sf_dir), trial_store(spark, sf_dir)
    times, month = store["months"], F.substring("month", 6, 2)
    sets = store["versions"].select(F.col("version").alias("month"), F.col("version"), F.col("role").alias("model_key")).join(store["origins"], "month")
    public = times.select(F.col("month").alias("train_month"), "actual_published_at")
    manifest = sets.join(public, "train_month").groupBy("version", "model_key").agg(F.max("train_month").alias("training_end"), F.max("actual_published_at").alias("training_published")).join(quality.artifact_hashes(store["models"]), ["version", "model_key"])
    version = F.when((month == "06") & (F.col("role") == "challenger"), "2001-01").when(month == "09", "none").otherwise(F.col("version"))
    forecasts = store["forecasts"].withColumn("version", version).join(times.select("month", (F.col("cutoff") + F.expr("INTERVAL '3' DAY")).alias("as_of")), "month")
    table = store["models"].withColumn("weight", F.when(F.col("version").startswith("1999"), F.col("weight") + 0.001).otherwise(F.col("weight")))
    used = features.snapshots_at(obs, evaluation.feature_cutoffs(obs)).where("ord = 2")
    keys = ["release_month", "ord", "content_sha256"]
    sources = used.join(obs.select(*keys, "published_at", "retrieved_at").distinct(), keys)
    return quality.violations(forecasts, manifest, table, damaged(store)["features"], sources)


@query
def reparsed_actuals(spark, sf_dir):
    """All stored headlines parsed again, against what was recorded: other signs every fifth month, months that were not
    recorded, and values whose page is gone."""
    text = headlines(spark, sf_dir).withColumn("value", ingest.headline_change(F.col("text")))
    month = F.substring("target_month", 6, 2)
    recorded = text.where(month != "11").withColumn("value", F.when(month.cast("int") % 5 == 0, -F.col("value")).otherwise(F.col("value")))
    rebuilt = text.where(~((month == "02") & (F.col("version") == 2)))
    return registry.changed_values(recorded, rebuilt, ["target_month", "version"], "value").select("target_month", "version", r6("was").alias("was"), r6("now").alias("now"), "change")


def dated_links(spark, sf_dir) -> DataFrame:
    """Stored index entries: each release page on its day, and all raw pages on one day, more than a search shows."""
    released = proxy.observations(spark, sf_dir).select(F.to_date("published_at").alias("day"), F.col("source_url").alias("url")).distinct()
    return released.unionByName(proxy.table(spark, sf_dir, "pages").select(F.lit("1999-09-09").cast("date").alias("day"), F.concat_ws("#", F.coalesce("url", F.lit("")), "page_id").alias("url")))


@query
def bisected_discovery(spark, sf_dir):
    """The date ranges to be asked for, where a search shows four pages of five links."""
    found = discovery.bisected_ranges(dated_links(spark, sf_dir), 5, 4)
    return found.select(F.col("start").cast("string"), F.col("end").cast("string"), "n_links", "n_pages", "alone")


@query
def discovered_once(spark, sf_dir):
    """Every link with how many of the ranges hold it, and the pages that are to be fetched by then: counts by answer."""
    links = dated_links(spark, sf_dir).distinct()
    ranges = discovery.bisected_ranges(links, 5, 4)
    held = links.join(ranges, (F.col("day") >= F.col("start")) & (F.col("day") <= F.col("end")), "left").groupBy("day", "url").agg(F.count("start").alias("ranges"))
    pages = discovery.fetch_plan(ranges).agg(F.count("*").alias("n_pages"))
    return held.groupBy("ranges").agg(F.count("*").alias("n_links")).join(pages).select("ranges", "n_links", "n_pages")


@query
def scalar_texts(spark, sf_dir):
    """Month literals that are valid or not, names of months, the publisher's month, and numbers that JSON can hold."""
    number, turn = F.get_json_object("props", "$.k").cast("int"), F.col("event_id") % 5
    text = F.when(turn == 0, F.date_format("ts", "yyyy-MM")).when(turn == 1, "2024-13").when(turn == 2, "24-1").when(turn == 3, " 2024-01")
    value = F.when(number % 7 == 0, float("nan")).when(number % 11 == 0, float("inf")).when(number % 13 == 0, float("-inf")).otherwise(F.col("value"))
    rows = proxy.table(spark, sf_dir, "events").select("event_id", "ts", text.alias("text"), value.alias("number"))
    month = F.date_format("ts", "yyyy-MM")
    return rows.select("event_id", F.coalesce(rel.is_month(F.col("text")), F.lit(False)).alias("is_month"), rel.month_name(month).alias("month_name"), rel.default_month(F.col("ts")).alias("publisher_month"), rel.json_safe(F.col("number")).alias("number"))


def saved_rows(spark, sf_dir) -> DataFrame:
    """Saved forecasts, one in five without an estimate."""
    lost = (F.col("model_key") == "boosting") & (F.substring("target_month", 6, 2).cast("int") % 2 == 0)
    return proxy.forecasts(spark, sf_dir).select("target_month", "vintage", "model_key", F.when(~lost, F.col("estimate_mom_pct")).alias("estimate_mom_pct"))


@query
def csv_roundtrip(spark, sf_dir):
    """Written as text, read back as strings with the empty one missing, and typed."""
    where = files.run_path(spark, "csv")
    saved_rows(spark, sf_dir).write.option("header", True).csv(where)
    return rounded(files.typed(files.read_strings(spark, where, ["target_month", "vintage", "model_key", "estimate_mom_pct"]), {"estimate_mom_pct": "double"}), "estimate_mom_pct")


@query
def forecast_tree(spark, sf_dir):
    """Written as a tree of JSON files by month and model, and read back in one scan."""
    where = files.run_path(spark, "tree")
    held = saved_rows(spark, sf_dir).withColumns({"m": F.col("target_month"), "k": F.col("model_key")})
    held.repartition(8, "m").write.partitionBy("m", "k").option("maxRecordsPerFile", 1).json(where)  # one forecast a file
    found = files.read_forecast_tree(spark, where, "target_month string, vintage string, model_key string, estimate_mom_pct double", "*.json")
    return rounded(found, "estimate_mom_pct")


@query
def write_once_batches(spark, sf_dir):
    """How many rows each of four batches added to a table that takes each key once; the last two repeat others."""
    where = files.run_path(spark, "once")
    rows = proxy.forecasts(spark, sf_dir).select("target_month", "vintage", "model_key", "estimate_mom_pct")
    month = F.col("target_month")
    batches = [rows.where(month < "1998-01"), rows.where(month.between("1997-06", "1999-12")), rows.where(month.between("1997-06", "1999-12")), rows.where(month < "1999-01")]
    added = [(k, files.write_once(b, where, ["target_month", "vintage", "model_key"], "estimate_mom_pct")) for k, b in enumerate(batches)]
    return spark.createDataFrame(added, "batch long, n_new long").join(spark.read.schema(rows.schema).parquet(where).agg(F.count("*").alias("n_stored"), r6(F.sum("estimate_mom_pct")).alias("total")))


@query
def stored_vintages(spark, sf_dir):
    """The features of each year stored as one vintage, all tables or none; storing them again changes nothing."""
    root = files.run_path(spark, "vintages")
    long = files.stored(long_matrix(spark, sf_dir).select("month", "product_name", F.round(F.col("value") * 1_000_000).cast("long").alias("millionths")), "vintage-values")
    months = long.groupBy("month").agg(F.count("*").alias("n"))
    first = [files.write_vintage(root, "all", {"values": long, "months": months}) for _ in range(2)]
    held = spark.read.schema(long.schema).parquet(f"{root}/key=all/values").groupBy("month").agg(F.sum("millionths").alias("total"))
    return held.join(spark.read.schema(months.schema).parquet(f"{root}/key=all/months"), "month").select("month", "n", "total", F.lit(first[0]).alias("written"), F.lit(first[1]).alias("again"))
