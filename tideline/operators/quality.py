"""Assertions on saved forecasts as a table of violations, which must be empty."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.saved import frozen_features


def artifact_hashes(table: DataFrame) -> DataFrame:
    """version, model_key, artifact_hash: a digest over a saved model's coefficients in millionths."""
    whole = lambda c: F.round(F.col(c) * 1_000_000).cast("long").cast("string")
    line = F.concat_ws(":", "product_name", *map(whole, ("centre", "scale", "weight", "bias")))
    return table.groupBy("version", "model_key").agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), ","), 256).alias("artifact_hash"))


def violations(forecasts: DataFrame, manifest: DataFrame, table: DataFrame, features: DataFrame, sources: DataFrame) -> DataFrame:
    """(month, role, version, violation): every rule that a saved forecast breaks.

    forecasts: month, role, version, model_key, feature_hash, as_of. manifest: version, model_key, training_end,
    training_published, artifact_hash, as written when the model was saved. table, features: the store as it is now.
    sources: month and the published_at and retrieved_at of each snapshot behind its features. Rules: overlap (the
    training reaches the forecast's month), later_target (it used a target that was not public by as_of), features and
    artifact (the store has another digest), source (a snapshot was not published and retrieved by as_of), no_model.
    """
    known = forecasts.join(manifest.select("version", "model_key", "training_end", "training_published", F.col("artifact_hash").alias("saved_hash")), ["version", "model_key"], "left")
    now = artifact_hashes(table).withColumnRenamed("artifact_hash", "hash_now")
    last = sources.groupBy("month").agg(F.max(F.greatest("published_at", "retrieved_at")).alias("last_source"))
    held = known.join(now, ["version", "model_key"], "left").join(frozen_features(features).withColumnRenamed("feature_hash", "features_now"), "month", "left").join(last, "month", "left")
    broken = lambda holds: ~F.coalesce(holds, F.lit(False))
    there = F.col("saved_hash").isNotNull()
    rules: dict[str, Column] = {
        "no_model": ~there, "overlap": there & broken(F.col("training_end") < F.col("month")), "later_target": there & broken(F.col("training_published") <= F.col("as_of")),
        "features": ~F.col("feature_hash").eqNullSafe(F.col("features_now")), "artifact": there & ~F.col("saved_hash").eqNullSafe(F.col("hash_now")), "source": broken(F.col("last_source") <= F.col("as_of")),
    }
    named = F.array_compact(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())))
    return held.select("month", "role", "version", F.explode(named).alias("violation"))
