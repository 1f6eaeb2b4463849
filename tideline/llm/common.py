"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

HEAVY = 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Unset, a local session (tests) gets its own; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="tideline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What a Python worker keeps between the tasks of one operator. Workers outlive it, so the next operator's tasks drop it."""
    for name in [n for n in _kept if n != owner]:
        del _kept[name]
    return _kept.setdefault(owner, {})


class Scratch:
    """Tables and files of one operator run, written to the shared folder so that no later read depends on an executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write df once and return a scan of it."""
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def bucketed(self, df: DataFrame, name: str, by: str, buckets: int) -> DataFrame:
        """Write df once, dealt by a column, and return a scan that later joins and groups by that column need not shuffle."""
        entry = f"tl_{uuid.uuid4().hex}"
        df.write.format("parquet").option("compression", "zstd").option("path", self.path(name)).bucketBy(buckets, by).saveAsTable(entry)
        found = self.spark.table(entry)
        self.spark.sql(f"DROP TABLE {entry}")  # the entry only: the files lie in the shared folder
        return found

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark._jvm
        for name in names:
            where = jvm.org.apache.hadoop.fs.Path(self.path(name))
            where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)


def heavy_join(left: DataFrame, right: DataFrame, on: list[str], scratch: Scratch, how: str = "inner") -> DataFrame:
    """left joined with right, which has one row a key, such that no key of left is one task's alone.

    A key with more than 1/HEAVY of left's rows is heavy: there are fewer than HEAVY of them whatever the input, so their
    rows of right are broadcast, and left's stay where they are. All other keys meet in a shuffle. left is read more
    than once, so it should be a stored table.
    """
    least = left.count() // HEAVY
    counts = left.groupBy(*on).agg(F.count("*").alias("_tl_n"))  # combined map-side
    heavy = scratch.table(counts.where(F.col("_tl_n") > least).select(*on), f"heavy-{uuid.uuid4().hex}")
    if heavy.isEmpty():
        return left.join(right, on, how)
    keys = F.broadcast(heavy)
    here = left.join(keys, on, "left_semi").join(F.broadcast(right.join(keys, on, "left_semi")), on, how)
    return here.unionByName(left.join(keys, on, "left_anti").join(right, on, how))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row however often body uses it."""
    return F.transform(F.array(value), body)[0]


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", id_type: str = "long") -> DataFrame:
    """Only (doc_id, text string) of the input; a null text becomes the empty one, other columns cannot clash."""
    return docs.select(F.col(id_col).cast(id_type).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
