"""Discovery through a search interface that shows a bounded number of pages: date ranges are halved until they fit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RANGE = "start:date,end:date"
DEPTH = 24  # halvings that any span of days needs at most


def halvings(day: Column, first: Column, last: Column) -> Column:
    """The ranges that hold a day, from the whole span down to the day alone: each is one half of the one before."""

    def step(path: Column, _: Column) -> Column:
        now = F.element_at(path, -1)
        middle = F.date_add(now.start, F.floor(F.date_diff(now.end, now.start) / 2).cast("int"))
        half = F.when(day <= middle, F.struct(now.start.alias("start"), middle.alias("end"))).otherwise(F.struct(F.date_add(middle, 1).alias("start"), now.end.alias("end")))
        return F.when(now.start == now.end, path).otherwise(F.concat(path, F.array(half)))

    return F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.array(F.struct(first.alias("start"), last.alias("end"))).cast(f"array<struct<{RANGE}>>"), step)


def bisected_ranges(links: DataFrame, page_size: int = 20, most_pages: int = 25) -> DataFrame:
    """start, end, n_links, n_pages, alone: the ranges to be asked for. Each has at most most_pages pages, or is a single day
    (alone: even that day has more), and every link is in exactly one.

    links: day, url; equal ones count once. A range is asked for if it fits and none that holds it does. Days are counted first, map-side;
    all ranges of all levels are then counted in one aggregation over days, a calendar's number of rows, and not one
    level after the other.
    """
    days = links.where("day is not null").select("day", "url").distinct().groupBy("day").agg(F.count("*").alias("n"))
    span = days.agg(F.min("day").alias("first"), F.max("day").alias("last")).withColumn("one", F.lit(1))
    held = days.withColumn("one", F.lit(1)).join(F.broadcast(span), "one")  # one row
    each = held.select("day", "n", F.posexplode(halvings(F.col("day"), F.col("first"), F.col("last"))).alias("level", "range")).select("day", "n", "level", "range.start", "range.end")
    counted = each.groupBy("level", "start", "end").agg(F.sum("n").alias("n_links"))
    pages = F.ceil(F.col("n_links") / page_size)
    fits = counted.withColumn("n_pages", pages).where((F.col("n_pages") <= most_pages) | (F.col("start") == F.col("end")))
    chosen = each.join(fits.drop("n_pages", "n_links"), ["level", "start", "end"]).groupBy("day").agg(F.min_by(F.struct("level", "start", "end"), "level").alias("x"))
    return fits.join(chosen.select("x.*").distinct(), ["level", "start", "end"], "left_semi").select("start", "end", "n_links", "n_pages", (F.col("n_pages") > most_pages).alias("alone"))


def fetch_plan(ranges: DataFrame) -> DataFrame:
    """start, end, page: one row a page to be fetched, to be dealt over tasks."""
    return ranges.select("start", "end", F.explode(F.sequence(F.lit(1), F.col("n_pages").cast("int"))).alias("page"))
