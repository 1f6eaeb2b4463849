"""The panel's source tables, derived from the order and part tables: prices, released actuals, saved forecasts, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.functions.releases import event_digest, month_start, release_url, window_end, window_name
from tideline.operators.registry import chained

MODELS = (("no_change", 0.0, 0.0), ("persistence", 1.0, 0.0), ("sector_first", 0.6, 0.2), ("product_ridge", 0.4, -0.1), ("boosting", 0.8, 0.4))
VINTAGES = (("early", 14), ("final", 24), ("late", 44))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices by product, month and ten-day window, in the stored snapshots of each release.

    Every release has a full snapshot and most an early one. Some second windows were corrected later: the page keeps its
    address, and carries a later stamp or, in May, an earlier one. Some October surveys of the first window were
    cancelled, and the basket lost and gained products. `part` is a dimension; Spark broadcasts it where its statistics
    say that it is small, else both sides are shuffled by part; prices are aggregated map-side after that.
    """
    day = F.dayofmonth("l_shipdate")
    lines = table(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice", "l_linestatus", "l_shipdate")
    cells = lines.join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("product_name")), "l_partkey")
    cells = cells.groupBy(F.date_format("l_shipdate", "yyyy-MM").alias("release_month"), F.when(day <= 10, 1).when(day <= 20, 2).otherwise(3).alias("ord"), "product_name")
    early = F.col("l_linestatus") == "F"
    cents, units = F.round(F.col("l_extendedprice") * 100).cast("long"), F.col("l_quantity").cast("long")  # whole numbers add up alike in any order
    cells = cells.agg(F.sum(cents).alias("v"), F.sum(units).alias("q"), F.sum(F.when(early, cents)).alias("ve"), F.sum(F.when(early, units)).alias("qe"))
    start = month_start(F.col("release_month"))
    corrected = F.when((F.col("ord") == 2) & (F.month(start) % 4 == 1), F.expr("(v * 102) div q") / 10000)
    snapshots = F.explode(F.array(F.struct(F.lit("full").alias("snapshot"), (F.expr("(v * 100) div q") / 10000).alias("price")), F.struct(F.lit("early").alias("snapshot"), (F.expr("(ve * 100) div qe") / 10000).alias("price")), F.struct(F.lit("corrected").alias("snapshot"), corrected.alias("price"))))
    cells = cells.select("release_month", "ord", "product_name", snapshots.alias("s")).select("release_month", "ord", "product_name", "s.snapshot", "s.price").where("price is not null")
    number = F.substring_index("product_name", "#", -1).cast("int")
    gone = (number % 8 == 0) & (F.col("release_month") >= "1998-07") | (number % 9 == 0) & (F.col("release_month") < "1997-02")
    cells = cells.where(~gone & ~((F.month(start) == 10) & (F.year(start) % 3 == 0) & (F.col("ord") == 1)))
    late = F.col("snapshot") == "corrected"
    published = F.date_add(window_end(F.col("release_month"), F.col("ord")), F.when(late & (F.month(start) == 5), 3).when(late, 44).otherwise(4)).cast("timestamp_ntz") + F.expr("INTERVAL '09:30' HOUR TO MINUTE")
    lag = F.when(F.col("snapshot") == "early", 1).when(late, 1200).otherwise(24 + (F.year(start) * 31 + F.month(start) * 7 + F.col("ord") * 13) % 72)
    cells = cells.withColumn("window", window_name(F.col("ord"))).withColumn("category", F.concat(F.lit("C"), (number % 5).cast("string"))).withColumn("sector", F.concat(F.lit("S"), (number % 3).cast("string")))
    cells = cells.withColumn("published_at", published).withColumn("retrieved_at", F.col("published_at") + F.make_dt_interval(F.lit(0), lag))
    cells = cells.withColumn("source_url", release_url(F.col("release_month"), F.col("ord"), F.when(late, F.lit("full")).otherwise(F.col("snapshot"))))
    cells = cells.withColumn("content_sha256", F.sha2(F.concat_ws("#", "source_url", F.when(late, F.col("snapshot"))), 256))
    return cells


def actuals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Released month-on-month rates, each with one later revision."""
    months = table(spark, sf_dir, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("target_month")).agg(F.avg("o_totalprice").alias("level"))
    months = months.withColumn("mom", F.round(100 * (F.col("level") / F.lag("level").over(Window.orderBy("target_month")) - 1), 6)).where("mom is not null")
    first = F.add_months(month_start(F.col("target_month")), 1)
    version = F.explode(F.array(F.struct(F.lit(1).alias("version"), F.lit(8).alias("days"), F.lit(1.0).alias("factor")), F.struct(F.lit(2).alias("version"), F.lit(38).alias("days"), F.lit(0.8).alias("factor"))))
    rows = months.select("target_month", "mom", version.alias("x")).select("target_month", F.round(F.col("mom") * F.col("x.factor"), 6).alias("actual_mom_pct"), (F.date_add(first, F.col("x.days")).cast("timestamp_ntz") + F.expr("INTERVAL '09:30' HOUR TO MINUTE")).alias("published_at"), "x.version")
    return rows.withColumn("retrieved_at", F.col("published_at") + F.expr("INTERVAL '1' DAY")).withColumn("content_sha256", F.sha2(F.concat_ws("|", "target_month", "version"), 256))


def forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved forecasts: five models at three vintages of each month, from the month before as it was known then."""
    first = actuals(spark, sf_dir).where("version = 1").select("target_month", "actual_mom_pct")
    last = first.withColumn("before", F.lag("actual_mom_pct").over(Window.orderBy("target_month"))).where("before is not null")
    models = F.explode(F.array(*(F.struct(F.lit(m).alias("model_key"), F.lit(w).alias("w"), F.lit(b).alias("b")) for m, w, b in MODELS)))
    vintages = F.explode(F.array(*(F.struct(F.lit(v).alias("vintage"), F.lit(d).alias("days")) for v, d in VINTAGES)))
    rows = last.select("target_month", "before", models.alias("m")).select("*", vintages.alias("v"))
    rows = rows.select("target_month", "m.model_key", "v.vintage", F.round(F.col("before") * F.col("m.w") + F.col("m.b") + F.col("v.days") / 100, 6).alias("estimate_mom_pct"), (F.date_add(month_start(F.col("target_month")), F.col("v.days")).cast("timestamp_ntz") + F.expr("INTERVAL '12' HOUR")).alias("as_of"))
    key = F.concat_ws("|", "target_month", "vintage", "model_key")
    return rows.withColumn("feature_hash", F.sha2(F.concat_ws("|", "target_month", "vintage"), 256)).withColumn("forecast_id", F.substring(F.sha2(key, 256), 1, 24))


#: The event types of a lifecycle.
EVENT_KINDS = ("initialized", "trial_requested", "refit_failed", "challenger_fitted", "trial_decided", "adopted", "trial_cancelled", "promoted")


def journal(spark: SparkSession, sf_dir: str, intact: bool = True) -> DataFrame:
    """An append-only journal of lifecycle events, in which each event's id covers that of its key's event before.

    Not intact: some events were removed, some had their payload changed afterwards, some name another predecessor and
    some were rewritten, both of these with an id that fits again.
    """
    number = F.get_json_object("props", "$.k").cast("long")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("sequence"), F.element_at(F.array(*map(F.lit, EVENT_KINDS)), (number % 8 + 1).cast("int")).alias("kind"), F.col("ts").alias("as_of"),
        F.col("user_id").cast("string").alias("key"), F.concat_ws("-", F.col("user_id"), F.date_format("ts", "yyyy-MM-dd")).alias("cycle_id"), number.cast("string").alias("payload"),
    )
    rows = chained(rows)
    if intact:
        return rows
    turn = lambda n, k: F.col("sequence") % n == k
    rows = rows.where(~turn(101, 50)).withColumn("previous_event", F.when(turn(89, 7), F.sha2("event_id", 256)).otherwise(F.col("previous_event")))
    rows = rows.withColumn("payload", F.when(turn(83, 29), F.concat("payload", F.lit("1"))).otherwise(F.col("payload")))
    rows = rows.withColumn("event_id", F.when(turn(89, 7) | turn(83, 29), event_digest()).otherwise(F.col("event_id")))
    return rows.withColumn("payload", F.when(turn(97, 13), F.concat("payload", F.lit("0"))).otherwise(F.col("payload")))


def saved_metrics(spark: SparkSession, sf_dir: str, before: str = "1997-01") -> DataFrame:
    """The error that each model had when it was put to use: over the months before, kept with the model."""
    first = actuals(spark, sf_dir).where("version = 1").select("target_month", "actual_mom_pct")
    held = forecasts(spark, sf_dir).where(F.col("target_month") < before).join(first, "target_month")
    return held.groupBy("model_key", "vintage").agg(F.round(F.avg(F.abs(F.col("estimate_mom_pct") - F.col("actual_mom_pct"))), 9).alias("reference_mae"))
