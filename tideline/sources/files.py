"""File sources and sinks: typed scans of text tables and JSON trees, write-once and versioned outputs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import registry


def run_path(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share, below spark.checkpoint.dir; a local session without that gets one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="tideline-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written once to a folder of its own and scanned from there."""
    path = run_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def read_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV folder with every column a string and the empty string missing; an empty frame if nothing is there."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    try:
        found = spark.read.schema(schema).option("header", True).csv(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    return found.select(*(F.nullif(F.col(f"`{c}`"), F.lit("")).alias(c) for c in columns))


def read_forecast_tree(spark: SparkSession, root: str, schema, name: str = "forecast.json") -> DataFrame:
    """Saved forecasts of a <root>/<month>/<model>/forecast.json tree, read in parallel with a fixed schema."""
    return spark.read.schema(schema).option("multiLine", True).json(f"{root}/*/*/{name}")


def typed(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns cast to their kinds; what does not parse becomes null, and so do NaN and infinities."""
    out = df.withColumns({c: F.col(c).try_cast(kind) for c, kind in kinds.items()})
    finite = {c: F.when(~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)) for c, kind in kinds.items() if kind == "double"}
    return out.withColumns(finite) if finite else out


def write_once(df: DataFrame, path: str, keys: list[str], value: str) -> int:
    """Append rows with new keys; equal rows are a no-op, and what registry.conflicts() finds is an error: a null, two
    values for a key, or another value than the stored one. Returns how many were new.

    One writer at a time. The new rows are found by joins against the stored keys, never by reading them to the driver.
    """
    spark = df.sparkSession
    try:
        held = spark.read.schema(df.schema).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        held = spark.createDataFrame([], df.schema)
    if not registry.conflicts(held, df, keys, value).isEmpty():
        raise ValueError(f"a row changes what {path} holds, or the batch contradicts itself")
    new = registry.new_rows(held, df, keys, value)
    n = new.count()
    if n:
        new.write.mode("append").parquet(path)
    return n


def write_version(df: DataFrame, root: str, version: str) -> str:
    """Write a table as a new version; readers follow the newest one that is complete."""
    path = f"{root}/version={version}"
    df.write.mode("errorifexists").parquet(path)
    return path


def newest_version(spark: SparkSession, root: str) -> DataFrame:
    """The rows of the newest complete version: Spark lists only those whose writing was committed."""
    every = spark.read.parquet(root)
    return every.where(F.col("version") == every.agg(F.max("version")).first()[0])


def write_vintage(root: str, key: str, tables: dict[str, DataFrame]) -> bool:
    """Write a vintage's tables under one key, all or none. Repeating it with the same rows is a no-op, with others an
    error. A version counts as complete by its last table, so a run that was cut off is written again."""
    names = sorted(tables)
    spark = tables[names[0]].sparkSession
    done = f"{root}/key={key}"
    try:
        spark.read.parquet(f"{done}/{names[-1]}").schema
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        for name in names:
            tables[name].write.mode("overwrite").parquet(f"{done}/{name}")
        return True
    for name in names:
        held = spark.read.parquet(f"{done}/{name}")
        if not held.exceptAll(tables[name]).isEmpty() or not tables[name].exceptAll(held).isEmpty():
            raise ValueError(f"{name} of vintage {key} is stored with other rows")
    return False


def save_model(model, root: str, version: str, validated: bool) -> None:
    """Save a fitted Spark ML model as a version, with a mark of whether it passed its checks."""
    model.write().save(f"{root}/{version}/model")
    SparkSession.getActiveSession().createDataFrame([(validated,)], "validated boolean").coalesce(1).write.parquet(f"{root}/{version}/checks")


def load_model(kind, root: str, version: str, require_validated: bool = True):
    """The saved model of a Spark ML model class; one that did not pass its checks is refused unless asked for."""
    spark = SparkSession.getActiveSession()
    if require_validated and not spark.read.parquet(f"{root}/{version}/checks").first()["validated"]:
        raise ValueError(f"model {version} has not passed its checks")
    return kind.load(f"{root}/{version}/model")
