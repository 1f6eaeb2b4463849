"""Append-only registries, the event journal, drift triggers and promotion decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.releases import event_content, event_digest

TOLERANCE = 1e-12
KEY = ["target_month", "vintage", "model_key", "feature_hash"]


def conflicts(stored: DataFrame, incoming: DataFrame, keys: list[str] | None = None, value: str = "estimate_mom_pct", tolerance: float = TOLERANCE) -> DataFrame:
    """Keys of a batch that must be refused: lowest and highest incoming value, the stored one, and the fault.

    null: a value is null or NaN. batch: the batch itself holds two values for the key. stored: the key is stored with
    another value, or without one. The batch is reduced to one row a key, map-side, before it meets what is stored.
    """
    keys = keys or KEY
    given = F.when(~F.isnan(value), F.col(value))
    batch = incoming.groupBy(*keys).agg(F.min(given).alias("lowest"), F.max(given).alias("highest"), (F.count("*") - F.count(given)).alias("_none"))
    held = batch.join(stored.select(*keys, F.col(value).alias("stored_value"), F.lit(True).alias("_held")), keys, "left")
    near = lambda a, b: F.coalesce(F.abs(F.col(a) - F.col(b)) <= tolerance, F.lit(False))
    fault = F.when(F.col("_none") > 0, "null").when(~near("lowest", "highest"), "batch").when(F.col("_held") & ~near("lowest", "stored_value"), "stored")
    return held.withColumn("fault", fault).where("fault is not null").drop("_none", "_held")


def new_rows(stored: DataFrame, incoming: DataFrame, keys: list[str] | None = None, value: str = "estimate_mom_pct") -> DataFrame:
    """Incoming rows with a key that is not stored yet, once each: of equal ones that with the least value and columns."""
    keys = keys or KEY
    rest = [value, *(c for c in incoming.columns if c not in {*keys, value})]
    once = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_row")).select(*keys, "_row.*").select(*incoming.columns)
    return once.join(stored.select(*keys), keys, "left_anti")


def append(stored: DataFrame, incoming: DataFrame, keys: list[str] | None = None, value: str = "estimate_mom_pct") -> DataFrame:
    """Idempotent append: equal rows are a no-op; a null, two values for a key, or a changed value is an error."""
    if found := conflicts(stored, incoming, keys, value).take(1):
        raise ValueError(f"a batch is refused ({found[0]['fault']}): {found[0]}")
    return stored.unionByName(new_rows(stored, incoming, keys, value), allowMissingColumns=True)


def append_actuals(stored: DataFrame, incoming: DataFrame) -> DataFrame:
    """Released values that are not stored yet, by month and content digest, after those that are: a page that was read
    again adds nothing, a revision has a digest of its own and is kept beside the first."""
    keys = ["target_month", "content_sha256"]
    return stored.unionByName(new_rows(stored, incoming, keys, "actual_mom_pct"), allowMissingColumns=True)


def changed_values(previous: DataFrame, rebuilt: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Audit of a full re-derivation: keys added, removed or with a changed value (a full outer join)."""
    a, b = previous.select(*keys, F.col(value).alias("was")), rebuilt.select(*keys, F.col(value).alias("now"))
    return a.join(b, keys, "full_outer").where("not (was <=> now)").withColumn("change", F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed"))


def chained(events: DataFrame) -> DataFrame:
    """events with step (from 1 on in their key), previous_event and event_id: each id covers the one before it.

    A chain can only be made in order, so each key's events are folded in one row; a key is one model's lifecycle.
    Checking a chain needs no order and is a join (chain_breaks).
    """
    names = [c for c in events.columns if c != "key"]
    held = events.withColumn("_content", event_content()).groupBy("key").agg(F.array_sort(F.collect_list(F.struct("sequence", "_content", *(c for c in names if c != "sequence")))).alias("_events"))
    first = F.lit("")
    last = lambda ids: F.when(F.size(ids) == 0, first).otherwise(F.element_at(ids, -1))
    ids = F.aggregate("_events", F.array().cast("array<string>"), lambda acc, e: F.concat(acc, F.array(F.sha2(F.concat_ws("|", last(acc), e["_content"]), 256))))
    each = held.select("key", "_events", ids.alias("_ids")).select("key", "_ids", F.posexplode("_events").alias("_k", "_e"))
    at = lambda k: F.get("_ids", k)
    return each.select("key", *(F.col(f"_e.{c}").alias(c) for c in names), (F.col("_k") + 1).cast("long").alias("step"), at(F.col("_k") - 1).alias("previous_event"), at(F.col("_k")).alias("event_id"))


def chain_breaks(journal: DataFrame) -> DataFrame:
    """Events whose columns and named predecessor no longer give their id (changed), or that do not follow the one before
    in their key: it is missing (gap), or another one is named (forged).

    An event that was rewritten along with its id no longer is what the next one names; if that is mended too, the next
    one's id fails, and so on to the end. The predecessor is found by its step, so that a long journal is dealt by key
    and step and never ordered in one task.
    """
    before = journal.select("key", (F.col("step") + 1).alias("step"), F.col("event_id").alias("last"))
    held = journal.join(before, ["key", "step"], "left")
    broken = ~F.col("previous_event").eqNullSafe(F.col("last"))
    fault = F.when(F.col("event_id") != event_digest(), "changed").when(broken & F.col("last").isNull(), "gap").when(broken, "forged")
    return held.withColumn("fault", fault).where("fault is not null")


#: What a cycle's status is after an event; a failed refit changes none.
STATUS = {"trial_requested": "requested", "challenger_fitted": "testing", "trial_decided": "decided", "trial_cancelled": "cancelled", "promoted": "promoted"}


def replay_champions(journal: DataFrame) -> DataFrame:
    """Per key: the event that set its champion last, and the last event that completed a comparison.

    The fold is an aggregation: the last event by sequence wins, so it runs map-side and in any order.
    """
    last = lambda kinds, c: F.max_by(F.when(F.col("kind").isin(*kinds), F.col(c)), F.when(F.col("kind").isin(*kinds), F.col("sequence")))
    return journal.groupBy("key").agg(last(("initialized", "adopted", "promoted"), "event_id").alias("champion"), last(("trial_decided", "adopted"), "as_of").alias("completed_at"), F.count("*").alias("n_events"))


def replay_cycles(journal: DataFrame) -> DataFrame:
    """Per requested cycle: its status after all its events, when it was requested last, and how many refits failed.

    Events before the cycle's first request are unknown to it and count for nothing.
    """
    first = journal.where("kind = 'trial_requested'").groupBy("cycle_id").agg(F.min("sequence").alias("since"))
    held = journal.join(first, "cycle_id").where(F.col("sequence") >= F.col("since"))
    status = F.lit(None).cast("string")
    for kind, name in STATUS.items():
        status = F.when(F.col("kind") == kind, name).otherwise(status)
    held = held.withColumn("status", status)
    return held.groupBy("key", "cycle_id").agg(
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("sequence"))).alias("status"), F.max(F.when(F.col("kind") == "trial_requested", F.col("as_of"))).alias("requested_at"), F.count_if(F.col("kind") == "refit_failed").alias("n_failed"),
    )


def drift_triggers(scores: DataFrame, reference: DataFrame, keys: list[str], window: int = 4, ratio: float = 1.5, increase: float = 0.15, bias: float = 0.25, refresh: int = 12) -> DataFrame:
    """Whether a key's last outcomes call for a new trial, and why.

    scores: outcomes since the last comparison. reference: keys, reference_mae, as saved with the model. Reasons: error
    (recent MAE above both bounds on the reference), bias, refresh (so many outcomes without a trial). With fewer than
    `window` outcomes there is no reason yet.
    """
    line = Window.partitionBy(*keys).orderBy(F.col("target_month").desc())
    ranked = scores.withColumn("r", F.row_number().over(line))
    recent = F.col("r") <= window
    held = ranked.groupBy(*keys).agg(F.avg(F.when(recent, F.abs("error"))).alias("recent_mae"), F.avg(F.when(recent, F.col("error"))).alias("recent_bias"), F.count("*").alias("outcomes")).join(reference, keys)
    enough = F.col("outcomes") >= window
    error = enough & (F.col("recent_mae") > F.greatest(ratio * F.col("reference_mae"), F.col("reference_mae") + increase))
    biased = enough & (F.abs("recent_bias") > bias)
    reasons = F.array_compact(F.array(F.when(error, F.lit("error")), F.when(biased, F.lit("bias")), F.when(enough & (F.col("outcomes") >= refresh), F.lit("refresh"))))
    return held.withColumn("reasons", F.array_join(reasons, ",")).withColumn("triggered", F.size(reasons) > 0)


def promotion_rules(relative: float = 0.05, absolute: float = 0.02, rmse: float = 1.0, bias: float = 0.05, wins: float = 0.5) -> dict[str, Column]:
    gain = F.col("champion_mae") - F.col("challenger_mae")
    return {
        "relative_gain": gain >= relative * F.col("champion_mae"), "absolute_gain": gain >= absolute, "rmse_ratio": F.col("challenger_rmse") <= rmse * F.col("champion_rmse"),
        "bias": F.abs("challenger_bias") - F.abs("champion_bias") <= bias, "wins": F.col("win_rate") >= wins,
    }


def matched_pairs(scores: DataFrame, champion: str, keys: tuple[str, ...] = ("vintage",)) -> DataFrame:
    """Every challenger's outcomes beside the champion's, from the same features of the same months."""
    same = [*keys, "target_month", "feature_hash"]
    of = scores.select(*same, "model_key", "error")
    base = of.where(F.col("model_key") == champion).select(*same, F.col("error").alias("old"))
    return of.where(F.col("model_key") != champion).join(base, same)


def promotion_decisions(scores: DataFrame, champion: str, first: int = 6, keys: tuple[str, ...] = ("vintage",)) -> DataFrame:
    """Every challenger against the champion on their first common months; promoted if all five rules hold."""
    pairs = matched_pairs(scores, champion, keys)
    line = Window.partitionBy(*keys, "model_key").orderBy("target_month")
    pairs = pairs.withColumn("r", F.row_number().over(line)).where(F.col("r") <= first)
    rms = lambda c: F.sqrt(F.avg(F.col(c) * F.col(c)))
    held = pairs.groupBy(*keys, "model_key").agg(
        F.count("*").alias("n"), F.avg(F.abs("old")).alias("champion_mae"), F.avg(F.abs("error")).alias("challenger_mae"), rms("old").alias("champion_rmse"), rms("error").alias("challenger_rmse"),
        F.avg("old").alias("champion_bias"), F.avg("error").alias("challenger_bias"), F.avg((F.abs("error") < F.abs("old")).cast("double")).alias("win_rate"),
    )
    held = held.where(F.col("n") >= first)
    for name, rule in promotion_rules().items():
        held = held.withColumn(f"rule_{name}", rule)
    every = F.lit(True)
    for name in promotion_rules():
        every = every & F.col(f"rule_{name}")
    return held.withColumn("promoted", every)


def changed_predictions(saved: DataFrame, again: DataFrame, keys: list[str], value: str = "estimate_mom_pct", tolerance: float = 1e-10) -> DataFrame:
    """Saved forecasts that the model no longer gives, or that it was not asked for: what a re-prediction check must find empty."""
    return saved.select(*keys, F.col(value).alias("saved")).join(again.select(*keys, F.col(value).alias("again")), keys, "left").where(F.col("again").isNull() | (F.abs(F.col("saved") - F.col("again")) > tolerance))


def late_forecasts(forecasts: DataFrame, actuals: DataFrame) -> DataFrame:
    """Forecasts that were made when an actual of their month was public: none of them may be scored as prospective."""
    public = actuals.groupBy("target_month").agg(F.min("published_at").alias("actual_published_at"))
    return forecasts.join(public, "target_month").where(F.col("as_of") >= F.col("actual_published_at"))


def composite_bundle(active: DataFrame, promoted: DataFrame, keys: list[str]) -> DataFrame:
    """The active models with the promoted ones in place of those of the same key; all others stay."""
    return active.join(promoted.select(*keys), keys, "left_anti").unionByName(promoted, allowMissingColumns=True)
