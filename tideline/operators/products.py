"""The product family: canonical panel, release checks, feature rows with their sources, and training matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.releases import category_name, surrogate_id, window_end, window_midpoint, window_start
from tideline.operators import evaluation, features
from tideline.operators.ingest import normalised_names

# The units that were reviewed.
UNITS = {"吨": "CNY/tonne", "千克": "CNY/kg", "张": "CNY/sheet"}
SETTINGS = "log-change-1"


def unit_code(unit: Column) -> Column:
    found = F.lit(None).cast("string")
    for name, code in UNITS.items():
        found = F.when(unit == name, code).otherwise(found)
    return found


def canonical(obs: DataFrame) -> DataFrame:
    """One row an observation, with product id, normalised name, specification, unit, period bounds and a status.

    obs: raw_name, raw_unit, raw_category, price, release_month, ord, and the snapshot's columns. Names are normalised
    once each. status: ok, unknown_unit or invalid_price; nothing is dropped and nothing raises.
    """
    names = normalised_names(obs.select(F.col("raw_name").alias("name")))
    x = obs.join(names.select(F.col("name").alias("raw_name"), F.col("normalised").alias("product_name")), "raw_name", "left")
    unit = F.regexp_replace("raw_unit", r"\s+", "")
    start, end = window_start(F.col("release_month"), F.col("ord")), window_end(F.col("release_month"), F.col("ord"))
    price = F.col("price").try_cast("double")
    good = price.isNotNull() & ~F.isnan(price) & (price > 0) & (price < float("inf"))
    return x.withColumns({
        "product_id": surrogate_id(F.col("product_name"), unit), "product_specification": F.regexp_extract("product_name", r"\((.*)\)", 1), "continuity_group": F.substring_index("product_name", "(", 1),
        "unit": unit_code(unit), "category": category_name(F.col("raw_category")), "absolute_price": price, "observation_period": F.concat_ws(":", "release_month", "ord"),
        "period_start": start, "period_end": end, "period_midpoint": window_midpoint(F.col("release_month"), F.col("ord")),
        "status": F.when(unit_code(unit).isNull(), "unknown_unit").when(~F.coalesce(good, F.lit(False)), "invalid_price").otherwise("ok"),
    })


def release_qa(canonical: DataFrame, expected: int = 50) -> DataFrame:
    """Per stored release: how many rows, distinct products and bad rows, and whether it has exactly the expected ones."""
    counted = canonical.groupBy("observation_period", "content_sha256").agg(F.count("*").alias("n_rows"), F.count_distinct("product_id").alias("n_products"), F.count_if(F.col("status") != "ok").alias("n_bad"))
    return counted.withColumn("passed", (F.col("n_rows") == expected) & (F.col("n_products") == expected) & (F.col("n_bad") == 0))


def variant_values(obs: DataFrame, variant: str, cutoffs: DataFrame, impute: list[str] | None = None) -> DataFrame:
    """(product, month, variant, part, value) of a timing at each month's own cutoff; in the months of `impute` a missing
    first window is the midpoint of its neighbours, where both are there."""
    cells = features.cells_at(obs, cutoffs)
    cells = features.midpoint_imputed(cells, impute) if impute else cells
    return features.timing_changes(cells).where(F.col("variant") == variant)


def feature_rows(obs: DataFrame, variant: str, cutoffs: DataFrame, impute: list[str] | None = None) -> DataFrame:
    """One row a month: its values and missing products by name, its source snapshots, and a hash over settings,
    sources, values' schema and imputation."""
    values = variant_values(obs, variant, cutoffs, impute)
    name = F.concat(F.col("part"), F.lit("__"), F.col("product_name"))
    rows = values.groupBy("month").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct(name.alias("name"), "value"))))).alias("feature_values"),
        F.array_sort(F.collect_list(F.when(F.col("value").isNull(), name))).alias("structural_missing"), F.array_sort(F.collect_list(name)).alias("names"), F.count("value").alias("n_values"),
    )
    used = features.snapshots_at(obs, cutoffs)
    windows = {"twentieth": (2,), "final": (1, 2), "early": (1,), "early_carry": (1, 3)}[variant]
    needed = F.col("ord").isin(*windows) & ((F.col("ord") != 3) | (F.col("release_month") != F.col("month")))
    sources = used.where(needed).groupBy("month").agg(F.array_sort(F.collect_set(F.concat_ws(":", "release_month", "ord", "content_sha256"))).alias("sources"))
    out = rows.join(sources, "month").withColumn("imputed", F.col("month").isin(*impute) if impute else F.lit(False))
    parts = [F.lit(SETTINGS), F.lit(variant), F.col("imputed").cast("string"), F.array_join("names", ","), F.array_join("sources", ",")]
    return out.withColumn("feature_hash", F.sha2(F.concat_ws("|", *parts), 256)).withColumn("variant", F.lit(variant))


def training_matrix(obs: DataFrame, actuals: DataFrame, variant: str = "twentieth", last: bool = False, impute: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(values, matrix) of a timing: long values at each month's own cutoff, and the month's target or reason of exclusion."""
    cutoffs = evaluation.feature_cutoffs(obs, variant, last)
    values = variant_values(obs, variant, cutoffs, impute)
    months = obs.select(F.col("release_month").alias("month")).distinct()
    return values, evaluation.training_matrix(values, cutoffs, actuals, months)


def benchmark_values(obs: DataFrame, vintage: str, weight: float = 0.5) -> DataFrame:
    """(product, month, change_pct, state) of the survey features at the last publication of the vintage's window: the
    first for early, the second for final. state is what the months' windows allowed, and may differ from the vintage."""
    cutoffs = evaluation.feature_cutoffs(obs, "early" if vintage == "early" else "final", last=True)
    used = features.snapshots_at(obs, cutoffs, 2)
    target = used.select("month", F.col("release_month"), "ord")
    has = lambda k, same: F.max(((F.col("ord") == k) & ((F.col("release_month") == F.col("month")) == same)).cast("int")) == 1
    state = target.groupBy("month").agg(has(3, False).alias("_any"), has(1, True).alias("first"), has(2, True).alias("second"), F.max((F.col("ord") == 3) & (F.col("release_month") == features.shift_month(F.col("month"), -1))).alias("carry"))
    state = state.select("month", F.when(F.col("carry") & F.col("first") & F.col("second"), "final").when(F.col("carry") & F.col("first"), "early").otherwise("not_ready").alias("state"))
    cells = features.survey_cells_at(obs, used)
    return features.survey_change(cells, weight, first_only=vintage == "early").join(state, "month").select(*features.PRODUCT, "month", "change_pct", "state")
