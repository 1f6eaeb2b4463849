"""Products and the baskets that held at a time (slowly changing dimensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.releases import surrogate_id, window_end, window_start


def product_dim(obs: DataFrame) -> DataFrame:
    """One row a product: id, latest category, first and last period."""
    start = window_start(F.col("release_month"), F.col("ord"))
    rows = obs.withColumn("start", start)
    return rows.groupBy("product_name").agg(F.max_by("category", F.struct("start", "category")).alias("category"), F.min("start").alias("first_seen"), F.max("start").alias("last_seen"), F.count("*").alias("n_obs")).withColumn("product_id", surrogate_id(F.col("product_name"), F.lit("unit")))


def basket_epochs(obs: DataFrame) -> DataFrame:
    """Runs of periods with the same set of products: version, dates, products, what came and what went.

    Sets are built per period with distinct rows only; periods are few, so one ordered window over them finds the runs.
    """
    periods = obs.groupBy("release_month", "ord").agg(F.array_sort(F.collect_set("product_name")).alias("products"))
    periods = periods.withColumn("start", window_start(F.col("release_month"), F.col("ord")))
    line = Window.orderBy("start")
    before = F.lag("products").over(line)
    runs = periods.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("products")))
    none = F.array().cast("array<string>")
    return runs.select(
        F.row_number().over(line).cast("long").alias("version"), F.col("start").alias("effective_from"), F.date_sub(F.lead("start").over(line), 1).alias("effective_to"), "products",
        F.array_sort(F.array_except("products", F.coalesce("before", none))).alias("added"), F.array_sort(F.array_except(F.coalesce("before", none), F.col("products"))).alias("removed"),
    )


def basket_at(dates: DataFrame, epochs: DataFrame) -> DataFrame:
    """The epoch that holds at each date, and how many do (1 unless the catalog is broken)."""
    held = (F.col("effective_from") <= F.col("at")) & (F.col("effective_to").isNull() | (F.col("at") <= F.col("effective_to")))
    return dates.join(epochs, held, "left").groupBy("at").agg(F.max("version").alias("version"), F.count("version").alias("matches"))


def membership_gaps(obs: DataFrame, epochs: DataFrame) -> DataFrame:
    """Products that a period lacks or has beyond the epoch that holds at its end."""
    periods = obs.groupBy("release_month", "ord").agg(F.array_sort(F.collect_set("product_name")).alias("found")).withColumn("at", window_end(F.col("release_month"), F.col("ord")))
    held = (F.col("effective_from") <= F.col("at")) & (F.col("effective_to").isNull() | (F.col("at") <= F.col("effective_to")))
    joined = periods.join(epochs.select("effective_from", "effective_to", "products"), held)
    return joined.select("release_month", "ord", F.size(F.array_except("products", "found")).cast("long").alias("n_missing"), F.size(F.array_except("found", "products")).cast("long").alias("n_extra"))


def span_versions(epochs: DataFrame) -> DataFrame:
    """First and last basket version of each product."""
    rows = epochs.select("version", "effective_from", F.explode("products").alias("product_name"))
    return rows.groupBy("product_name").agg(F.min_by("version", "effective_from").alias("start_basket"), F.max_by("version", "effective_from").alias("end_basket"), F.count("*").alias("n_epochs"))


def coverage_gaps(obs: DataFrame) -> DataFrame:
    """Months and windows between the first and the last month that have no release."""
    held = obs.select("release_month", "ord").distinct()
    bounds = held.agg(F.min("release_month").alias("first"), F.max("release_month").alias("last"))
    day = lambda c: F.to_date(F.concat(c, F.lit("-01")))
    months = bounds.select(F.explode(F.sequence(day("first"), day("last"), F.expr("INTERVAL 1 MONTH"))).alias("m"))
    grid = months.select(F.date_format("m", "yyyy-MM").alias("release_month"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("ord"))
    return grid.join(held, ["release_month", "ord"], "left_anti")


def panel_diagnostics(obs: DataFrame) -> DataFrame:
    """Per product: share of periods with a price, whether stable (90 % or more), and how often it came or went."""
    periods = obs.select("release_month", "ord").distinct()
    names = obs.agg(F.array_sort(F.collect_set("product_name")).alias("names"))  # one dimension
    grid = periods.crossJoin(names).select("release_month", "ord", F.explode("names").alias("product_name"))
    present = grid.join(obs.select("release_month", "ord", "product_name").distinct().withColumn("here", F.lit(1)), ["release_month", "ord", "product_name"], "left").withColumn("here", F.coalesce("here", F.lit(0)))
    line = Window.partitionBy("product_name").orderBy("release_month", "ord")
    moved = present.withColumn("moved", F.abs(F.col("here") - F.lag("here").over(line)))
    return moved.groupBy("product_name").agg(F.avg(F.col("here").cast("double")).alias("coverage"), F.coalesce(F.sum("moved"), F.lit(0)).alias("turnover")).withColumn("stable", F.col("coverage") >= 0.9)
