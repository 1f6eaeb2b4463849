"""Bitemporal selection: what was known of which release at a cutoff."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SNAPSHOT = ["release_month", "ord", "source_url"]
PERIOD = ["release_month", "ord"]


def eligible(obs: DataFrame, cutoff: Column | None, strict: bool = True) -> DataFrame:
    """Rows published by the cutoff and, if strict, retrieved by it too; without a cutoff all."""
    if cutoff is None:
        return obs
    known = F.col("published_at") <= cutoff
    return obs.where(known & (F.col("retrieved_at") <= cutoff) if strict else known)


def latest_by(df: DataFrame, keys: list[str], order: list[Column], keep: str = "last") -> DataFrame:
    """One row a key: the last or first in a total order. Ties need a last sort key that is unique."""
    order = [c.desc_nulls_last() if keep == "last" else c.asc_nulls_last() for c in order]
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def latest_snapshots(obs: DataFrame, grain: list[str]) -> DataFrame:
    """The rows of each grain's newest stored snapshot: of a page the one retrieved last, whatever stamp it carries; of a
    period the one published last, then retrieved last.

    The snapshots are found by aggregation (a few columns, combined map-side) and joined back, so that wide
    observations are never sorted by window.
    """
    order = ["retrieved_at", "published_at"] if "source_url" in grain else ["published_at", "retrieved_at"]
    newest = obs.groupBy(*grain).agg(F.max(F.struct(*order, "content_sha256")).alias("s")).select(*grain, "s.content_sha256")
    return obs.join(newest, [*grain, "content_sha256"], "left_semi")


def select_available(obs: DataFrame, cutoff: Column | None, strict: bool = True, grain: list[str] | None = None) -> DataFrame:
    return latest_snapshots(eligible(obs, cutoff, strict), grain or PERIOD)


def vintage_state(available: DataFrame) -> DataFrame:
    """Per month: final if the month's first two windows and the carry-in are there, early without the second."""
    here = available.select("release_month", "ord").distinct()
    carry = here.where("ord = 3").select(F.date_format(F.add_months(F.to_date(F.concat("release_month", F.lit("-01"))), 1), "yyyy-MM").alias("release_month"), F.lit(0).alias("ord"))
    has = lambda k: F.max((F.col("ord") == k).cast("int")) == 1
    flags = here.unionByName(carry).groupBy("release_month").agg(has(0).alias("carry"), has(1).alias("first"), has(2).alias("second"))
    state = F.when(F.col("carry") & F.col("first") & F.col("second"), "final").when(F.col("carry") & F.col("first"), "early").otherwise("not_ready")
    return flags.withColumn("state", state)


def known_actuals(actuals: DataFrame, cutoff: Column | None, policy: str = "first") -> DataFrame:
    """One actual a month of those published and retrieved by the cutoff: first, last published, or last retrieved."""
    order = {"first": ["published_at", "retrieved_at"], "last_published": ["published_at", "retrieved_at"], "last_retrieved": ["retrieved_at", "published_at"]}[policy]
    held = eligible(actuals, cutoff)
    pick = F.min if policy == "first" else F.max
    return held.groupBy("target_month").agg(pick(F.struct(*order, "content_sha256", "actual_mom_pct")).alias("a")).select("target_month", "a.actual_mom_pct", "a.published_at", "a.retrieved_at")


def latest_saved(forecasts: DataFrame, cutoff: Column, keys: list[str]) -> DataFrame:
    """The last frozen forecast of each key at the cutoff."""
    return latest_by(forecasts.where(F.col("as_of") <= cutoff), keys, [F.col("as_of"), F.col("forecast_id")])


def prerelease(forecasts: DataFrame, actuals: DataFrame, keys: list[str]) -> DataFrame:
    """The last forecast of each key made before its actual was published: an as-of join on month with as_of < published_at."""
    first = actuals.groupBy("target_month").agg(F.min(F.struct("published_at", "retrieved_at", "content_sha256", "actual_mom_pct")).alias("a")).select("target_month", "a.actual_mom_pct", F.col("a.published_at").alias("actual_published_at"))
    held = forecasts.join(first, "target_month").where("as_of < actual_published_at")
    return latest_by(held, keys, [F.col("as_of"), F.col("forecast_id")])
