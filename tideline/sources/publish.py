"""Publishing model bundles: a folder a bundle, a manifest once it is whole, a pointer swapped last, and recovery after a crash.

Nothing is renamed, so that object stores do as well as file systems: what counts is which of the small tables are there.
One writer at a time; readers need no lock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "name string, rows long, digest decimal(38,0)"
POINTER = "bundle string"
INTENT = "seq long"


def _file_system(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder of which Spark has committed the contents."""
    system, where = _file_system(spark, path)
    names = [s.getPath().getName() for s in system.listStatus(where)] if system.exists(where) else []
    return sorted(n for n in names if committed(spark, f"{path}/{n}"))


def committed(spark: SparkSession, path: str) -> bool:
    system, where = _file_system(spark, f"{path}/_SUCCESS")
    return system.exists(where)


def removed(spark: SparkSession, path: str) -> None:
    system, where = _file_system(spark, path)
    system.delete(where, True)


def contents(name: str, df: DataFrame) -> DataFrame:
    """One row: how many rows a table has and a digest of them that does not depend on their order."""
    return df.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*sorted(df.columns)).cast("decimal(38,0)")), F.lit(0)).cast("decimal(38,0)").alias("digest"))


def _row(spark: SparkSession, path: str, schema: str, *values) -> None:
    spark.createDataFrame([values], schema).coalesce(1).write.mode("overwrite").parquet(path)


def publish(spark: SparkSession, root: str, bundle: str, tables: dict[str, DataFrame], after: Callable[[str], None] = lambda step: None) -> int:
    """Write a bundle and make it the active one; returns its place in the order of pointers.

    Steps, after each of which the process may die: the intent, each table, the manifest (the bundle is whole), the
    pointer (readers see it), the intent's end. `after` is called with each step's name. A bundle's name is used once.
    """
    if bundle in bundles(spark, root):
        raise ValueError(f"{bundle} is published already")
    pointers = listed(spark, f"{root}/pointers")
    seq = int(pointers[-1]) + 1 if pointers else 1
    _row(spark, f"{root}/intents/{bundle}", INTENT, seq)
    after("intent")
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/bundles/{bundle}/{name}")
        after(f"table {name}")
    _manifest(spark, root, bundle, sorted(tables)).coalesce(1).write.mode("overwrite").parquet(f"{root}/manifests/{bundle}")
    after("manifest")
    _point(spark, root, bundle, seq)
    after("pointer")
    removed(spark, f"{root}/intents/{bundle}")
    return seq


def _manifest(spark: SparkSession, root: str, bundle: str, names: list[str]) -> DataFrame:
    """Row counts and digests of a bundle's tables, read back from where they were written."""
    found = spark.createDataFrame([], MANIFEST)
    for name in names:
        found = found.unionByName(contents(name, spark.read.parquet(f"{root}/bundles/{bundle}/{name}")))
    return found


def _point(spark: SparkSession, root: str, bundle: str, seq: int) -> None:
    _row(spark, f"{root}/pointers/{seq:012d}", POINTER, bundle)


def bundles(spark: SparkSession, root: str) -> list[str]:
    """Bundles that a pointer names, oldest first."""
    return [spark.read.schema(POINTER).parquet(f"{root}/pointers/{p}").first()["bundle"] for p in listed(spark, f"{root}/pointers")]


def active(spark: SparkSession, root: str) -> str | None:
    """The bundle that readers see: that of the last pointer."""
    pointers = listed(spark, f"{root}/pointers")
    return spark.read.schema(POINTER).parquet(f"{root}/pointers/{pointers[-1]}").first()["bundle"] if pointers else None


def read_active(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the active bundle, whole: it was complete before its pointer was written, and is never written again."""
    if (bundle := active(spark, root)) is None:
        raise ValueError(f"nothing is published in {root}")
    return spark.read.parquet(f"{root}/bundles/{bundle}/{name}")


def whole(spark: SparkSession, root: str, bundle: str) -> bool:
    """Whether a bundle has its manifest and the tables that it describes."""
    if not committed(spark, f"{root}/manifests/{bundle}"):
        return False
    said = spark.read.schema(MANIFEST).parquet(f"{root}/manifests/{bundle}")
    names = [r["name"] for r in said.select("name").collect()]
    if not all(committed(spark, f"{root}/bundles/{bundle}/{name}") for name in names):
        return False
    return said.exceptAll(_manifest(spark, root, bundle, names)).isEmpty()


def recover(spark: SparkSession, root: str) -> dict[str, str]:
    """Finish or drop every publication that was cut off: one whose bundle is whole gets its pointer, any other leaves no
    trace. Running it again, or after it was itself cut off, gives the same."""
    done = {}
    for bundle in listed(spark, f"{root}/intents"):
        if whole(spark, root, bundle):
            seq = spark.read.schema(INTENT).parquet(f"{root}/intents/{bundle}").first()["seq"]
            _point(spark, root, bundle, seq)
            done[bundle] = "finished"
        else:
            removed(spark, f"{root}/manifests/{bundle}")
            removed(spark, f"{root}/bundles/{bundle}")
            done[bundle] = "dropped"
        removed(spark, f"{root}/intents/{bundle}")
    return done
