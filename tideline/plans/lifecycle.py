"""The champion and challenger cycle: trigger, trial, decision, as rows of an event journal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators import registry


def known_scores(scores: DataFrame, as_of: Column) -> DataFrame:
    """Outcomes whose actual was public at the time."""
    return scores.where(F.col("actual_published_at") <= as_of)


def cycle_events(scores: DataFrame, reference: DataFrame, champion: str, as_of: Column, most_trials: int = 2) -> DataFrame:
    """Events of one run per vintage: triggered champions, the trials opened (at most `most_trials`), and decisions.

    Nothing later than as_of is used. A trial goes to the challengers of least error so far; a decision is made on the
    first common months and promotes only if every rule holds.
    """
    held = known_scores(scores, as_of)
    due = registry.drift_triggers(held, reference, ["model_key", "vintage"]).where((F.col("model_key") == champion) & F.col("triggered"))
    triggers = due.select("vintage", F.lit("trigger").alias("event_type"), F.lit(champion).alias("model_key"), F.col("reasons").alias("payload"))
    ranked = held.where(F.col("model_key") != champion).groupBy("vintage", "model_key").agg(F.round(F.avg(F.abs("error")), 9).alias("mae"))
    best = ranked.groupBy("vintage").agg(F.slice(F.array_sort(F.collect_list(F.struct("mae", "model_key"))), 1, most_trials).alias("best"))
    trials = best.join(due.select("vintage"), "vintage", "left_semi").select("vintage", F.explode("best").alias("b"))
    opened = trials.select("vintage", F.lit("trial").alias("event_type"), F.col("b.model_key").alias("model_key"), F.lit("").alias("payload"))
    decided = registry.promotion_decisions(held, champion).join(opened.select("vintage", "model_key"), ["vintage", "model_key"], "left_semi")
    decisions = decided.select("vintage", F.when(F.col("promoted"), "promotion").otherwise("rejection").alias("event_type"), "model_key", F.lit("").alias("payload"))
    events = triggers.unionByName(opened).unionByName(decisions)
    return events.withColumn("event_id", F.sha2(F.concat_ws("|", "vintage", "event_type", "model_key", "payload", as_of.cast("string")), 256))


def champions(events: DataFrame, start: str) -> DataFrame:
    """The champion of each vintage after the events of one run: the promoted challenger, else the one before."""
    promoted = events.where("event_type = 'promotion'").groupBy("vintage").agg(F.min("model_key").alias("new"))
    return events.select("vintage").distinct().join(promoted, "vintage", "left").select("vintage", F.coalesce("new", F.lit(start)).alias("champion"))
