"""Ten-day-window panel features: log levels, like-for-like changes, imputation and summaries, for all months at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.releases import shift_month
from tideline.operators.asof import vintage_state

PRODUCT = ["product_name", "category", "sector"]


def log_price_cells(available: DataFrame) -> DataFrame:
    """(product, month): log price of each window, and of the three windows of the month before.

    One conditional aggregation; a window that no release has is null. A month's cells serve two target months, so
    each row is sent to both instead of joining the table to itself.
    """
    priced = available.where("price > 0").withColumn("lp", F.ln("price"))
    sent = F.explode(F.array(F.struct(F.col("release_month").alias("month"), F.lit(0).alias("back")), F.struct(shift_month(F.col("release_month"), 1).alias("month"), F.lit(1).alias("back"))))
    rows = priced.select(*PRODUCT, "ord", "lp", sent.alias("t")).select(*PRODUCT, "ord", "lp", "t.month", "t.back")
    cell = lambda back, k: F.max(F.when((F.col("back") == back) & (F.col("ord") == k), F.col("lp"))).alias(f"{'p' if back else 'c'}{k}")
    cells = rows.groupBy(*PRODUCT, "month").agg(*(cell(b, k) for b in (0, 1) for k in (1, 2, 3)), F.max((F.col("back") == 0).cast("int")).alias("now"))
    return cells.where("now = 1").drop("now")


def month_level(carry: Column, first: Column, second: Column, weight: float = 0.5, first_only: bool = False) -> Column:
    """Log level of a month: mean of the carry-weighted first survey and the second; null where one is missing."""
    survey = weight * carry + (1 - weight) * first
    level = (survey + second) / 2
    return F.coalesce(level, survey) if first_only else level


def percent(log_change: Column) -> Column:
    return 100 * F.expm1(log_change)


def survey_cells(available: DataFrame) -> DataFrame:
    """(product, month): log prices that a survey change needs: of the month's own first and second window, of all three
    of the month before, and of the third of the month before that. Each row is sent to the months it serves."""
    priced = available.where("price > 0").withColumn("lp", F.ln("price"))
    sent = F.explode(F.array(*(F.struct(shift_month(F.col("release_month"), k).alias("month"), F.lit(k).alias("back")) for k in range(3))))
    return _survey_cells(priced.select(*PRODUCT, "ord", "lp", sent.alias("t")).select(*PRODUCT, "ord", "lp", "t.month", "t.back"))


def _survey_cells(rows: DataFrame) -> DataFrame:
    cell = lambda back, k: F.max(F.when((F.col("back") == back) & (F.col("ord") == k), F.col("lp"))).alias(f"{'cpq'[back]}{k}")
    has = lambda back: F.max((F.col("back") == back).cast("int")) == 1
    return rows.groupBy(*PRODUCT, "month").agg(*(cell(b, k) for b, k in ((0, 1), (0, 2), (1, 1), (1, 2), (1, 3), (2, 3))), has(0).alias("now"), has(1).alias("then")).where("now and then").drop("now", "then")


def survey_change(cells: DataFrame, weight: float = 0.5, first_only: bool = False) -> DataFrame:
    """Percent change of the month's level from the level of the month before, from survey_cells()."""
    level = month_level(F.col("p3"), F.col("c1"), F.col("c2"), weight, first_only)
    prior = month_level(F.col("q3"), F.col("p1"), F.col("p2"), weight, first_only)
    return cells.withColumn("change_pct", percent(level - prior))


def twentieth_change(cells: DataFrame) -> DataFrame:
    return cells.withColumn("change_pct", percent(F.col("c2") - F.col("p2")))


def survey_cells_at(obs: DataFrame, used: DataFrame) -> DataFrame:
    """survey_cells() of each month from the snapshots_at() of that month and the two before."""
    priced = obs.where("price > 0").select(*PRODUCT, "release_month", "ord", "content_sha256", F.ln("price").alias("lp"))
    rows = priced.join(used, ["release_month", "ord", "content_sha256"]).withColumn("back", F.when(F.col("release_month") == F.col("month"), 0).when(F.col("release_month") == shift_month(F.col("month"), -1), 1).otherwise(2))
    return _survey_cells(rows)


VARIANTS = ("twentieth", "final", "early", "early_carry")


def timing_changes(cells: DataFrame) -> DataFrame:
    """Log changes (times 100) of the four timings, as (variant, part, value).

    twentieth, final and early compare prices with the month before; early_carry has the price changes of early and,
    as another part, the change since the last window of the month before.
    """
    mean = lambda a, b: F.ln((F.exp(F.col(a)) + F.exp(F.col(b))) / 2)
    early = F.col("c1") - F.col("p1")
    changes = {("twentieth", "price"): F.col("c2") - F.col("p2"), ("final", "price"): mean("c1", "c2") - mean("p1", "p2"), ("early", "price"): early, ("early_carry", "price"): early, ("early_carry", "carry"): F.col("c1") - F.col("p3")}
    rows = F.explode(F.array(*(F.struct(F.lit(v).alias("variant"), F.lit(part).alias("part"), (100 * c).alias("value")) for (v, part), c in changes.items())))
    return cells.select(*PRODUCT, "month", rows.alias("x")).select(*PRODUCT, "month", "x.variant", "x.part", "x.value")


def snapshots_at(obs: DataFrame, cutoffs: DataFrame, back: int = 1) -> DataFrame:
    """(month, release_month, ord, content_sha256): the snapshot of each period of a month and the `back` months before
    that was published last by the month's own cutoff. cutoffs: month, cutoff. Only snapshot keys meet, never their rows."""
    keys = obs.select("release_month", "ord", "content_sha256", "published_at", "retrieved_at").distinct()
    sent = keys.withColumn("month", F.explode(F.array(*(shift_month(F.col("release_month"), k) for k in range(back + 1)))))
    known = sent.join(cutoffs.select("month", "cutoff"), "month").where(F.col("published_at") <= F.col("cutoff"))
    return known.groupBy("month", "release_month", "ord").agg(F.max(F.struct("published_at", "retrieved_at", "content_sha256")).alias("s")).select("month", "release_month", "ord", "s.content_sha256")


def cells_at(obs: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """log_price_cells() of each month as its own cutoff knew them: a later correction is in later months only."""
    priced = obs.where("price > 0").select(*PRODUCT, "release_month", "ord", "content_sha256", F.ln("price").alias("lp"))
    rows = priced.join(snapshots_at(obs, cutoffs), ["release_month", "ord", "content_sha256"])
    cell = lambda back, k: F.max(F.when(((F.col("release_month") == F.col("month")) == (back == 0)) & (F.col("ord") == k), F.col("lp"))).alias(f"{'p' if back else 'c'}{k}")
    cells = rows.groupBy(*PRODUCT, "month").agg(*(cell(b, k) for b in (0, 1) for k in (1, 2, 3)), F.max((F.col("release_month") == F.col("month")).cast("int")).alias("now"))
    return cells.where("now = 1").drop("now")


def midpoint_imputed(cells: DataFrame, months: list[str] | None = None) -> DataFrame:
    """First windows that are missing while both neighbours are there: the log of the neighbours' arithmetic mean.

    months: only these (the opt-in of a scenario); None means all. Only the target month's own window is filled in.
    """
    gap = F.col("c1").isNull() & F.col("p3").isNotNull() & F.col("c2").isNotNull() & (F.lit(True) if months is None else F.col("month").isin(*months))
    return cells.withColumn("imputed", gap).withColumn("c1", F.when(gap, F.ln((F.exp("p3") + F.exp("c2")) / 2)).otherwise(F.col("c1")))


def trimmed_mean(df: DataFrame, keys: list[str], value: str = "change_pct", share: float = 0.1) -> DataFrame:
    """Mean without floor(share * n) values at either end, nulls left out."""
    values = F.array_sort(F.collect_list(value))
    held = df.groupBy(*keys).agg(values.alias("v"))
    cut = F.floor(F.size("v") * share).cast("int")
    kept = F.slice("v", cut + 1, F.size("v") - 2 * cut)
    return held.select(*keys, F.size("v").cast("long").alias("n"), F.when(F.size("v") > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)).alias("trimmed"))


def global_summary(df: DataFrame, keys: list[str], value: str = "change_pct") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"), F.avg(F.col(value).isNull().cast("double")).alias("missing"))


def group_means(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean and missing share of each group; a null group stays a group."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.avg(F.col(value).isNull().cast("double")).alias("missing"), F.count("*").alias("n"))


def geometric_tracker(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(percent(F.avg(value) / 100).alias("tracker"))


def feature_hash(df: DataFrame, keys: list[str], parts: list[Column]) -> DataFrame:
    """sha256 over the sorted distinct parts of each key."""
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", *parts))), "|"), 256).alias("feature_hash"))


def masked(df: DataFrame, share: int = 10, value: str = "value") -> DataFrame:
    """The panel with one in `share` cells missing, chosen by a digest of product and month."""
    pick = F.conv(F.substring(F.sha2(F.concat_ws("|", "product_name", "month"), 256), 1, 6), 16, 10).cast("long") % share == 0
    return df.withColumn("masked", pick).withColumn(value, F.when(~pick, F.col(value)))


def feature_vintages(available: DataFrame, weight: float = 0.5, trim: float = 0.1) -> DataFrame:
    """One row a month: its state, what was comparable, summaries of both change types, sources and a hash over all that
    went in (settings and snapshots). A month without comparable products is `pending`, whatever its windows."""
    sources = available.groupBy(F.col("release_month").alias("month")).agg(F.array_sort(F.collect_set(F.concat_ws(":", "ord", "content_sha256"))).alias("sources"))
    states = vintage_state(available).select(F.col("release_month").alias("month"), "state")
    changes = {"survey": survey_change(survey_cells(available), weight), "twentieth": twentieth_change(log_price_cells(available))}
    out = sources.join(states, "month")
    for name, rows in changes.items():
        summary = global_summary(rows, ["month"]).join(trimmed_mean(rows, ["month"], share=trim).select("month", "trimmed"), "month")
        out = out.join(summary.select("month", *(F.col(c).alias(f"{name}_{c}") for c in ("mean", "median", "trimmed", "sd", "n", "missing"))), "month", "left")
    ready = F.when(F.coalesce("survey_n", F.lit(0)) == 0, "pending").otherwise(F.col("state"))
    out = out.withColumns({f"{name}_n": F.coalesce(f"{name}_n", F.lit(0)) for name in changes})
    return out.withColumn("state", ready).withColumn("feature_hash", F.sha2(F.concat_ws("|", F.lit(f"{weight:g}"), F.lit(f"{trim:g}"), F.concat_ws("|", "sources")), 256))


def long_features(available: DataFrame, weight: float = 0.5) -> DataFrame:
    """(month, feature, value): the wide feature row in long form. Prefixes say what a feature is: product__ and
    missing__ (survey change), twentieth_product__ and twentieth_missing__, category__ and twentieth_category__ means,
    and global__ summaries of the survey changes."""
    rows = survey_change(survey_cells(available), weight).select("month", "product_name", "category", F.col("change_pct").alias("s")).join(twentieth_change(log_price_cells(available)).select("month", "product_name", F.col("change_pct").alias("t")), ["month", "product_name"])
    each = F.explode(F.array(*(F.struct(F.concat(F.lit(p), F.col("product_name")).alias("feature"), v.alias("value")) for p, v in (("product__", F.col("s")), ("missing__", F.col("s").isNull().cast("double")), ("twentieth_product__", F.col("t")), ("twentieth_missing__", F.col("t").isNull().cast("double"))))))
    products = rows.select("month", each.alias("x")).select("month", "x.*")
    groups = rows.groupBy("month", "category").agg(F.avg("s").alias("s"), F.avg("t").alias("t"))
    each = F.explode(F.array(*(F.struct(F.concat(F.lit(p), F.col("category")).alias("feature"), F.col(v).alias("value")) for p, v in (("category__", "s"), ("twentieth_category__", "t")))))
    whole = global_summary(rows, ["month"], "s")
    names = ("mean", "median", "sd", "n", "missing")
    glob = F.explode(F.array(*(F.struct(F.lit(f"global__{c}").alias("feature"), F.col(c).cast("double").alias("value")) for c in names)))
    return products.unionByName(groups.select("month", each.alias("x")).select("month", "x.*")).unionByName(whole.select("month", glob.alias("x")).select("month", "x.*"))
