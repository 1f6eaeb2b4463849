"""A landing zone of raw pages, one a file or many in an archive: read as they arrive, stored once by content, parsed, and
faults are kept apart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tideline.operators import ingest

BINARY = "path string, modificationTime timestamp, length long, content binary"
SNAPSHOT = "content_sha256 string, source_url string, title string, html string, retrieved_at timestamp, release_month string, window string, published_at timestamp"
ERROR = "source_url string, content_sha256 string, reason string"


def landed_files(spark: SparkSession, path: str, pattern: str = "*", files_a_batch: int = 1000) -> DataFrame:
    """A stream of whole files below a folder."""
    reader = spark.readStream.format("binaryFile").schema(BINARY).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return reader.option("maxFilesPerTrigger", files_a_batch).load(path)


def landed_archives(spark: SparkSession, path: str, pattern: str = "*.parquet", files_a_batch: int = 1000) -> DataFrame:
    """A stream of the pages in the archives below a folder: Parquet files with a row a page, its bytes as content. What
    arrives in bulk is landed so, as each file of its own costs the writer, the listing and the checkpoint alike."""
    reader = spark.readStream.schema("content binary").option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
    return reader.option("maxFilesPerTrigger", files_a_batch).parquet(path).select("content", F.col("_metadata.file_modification_time").alias("modificationTime"))


def as_pages(files: DataFrame) -> DataFrame:
    """source_url, title, html, retrieved_at of raw files or archived pages: the address is the canonical link, the title the first heading."""
    html = files.select(F.decode("content", "UTF-8").alias("html"), F.col("modificationTime").alias("retrieved_at"))
    take = lambda pattern: F.nullif(F.trim(F.regexp_extract("html", pattern, 1)), F.lit(""))
    return html.select(take(r'<link rel="canonical" href="([^"]+)"').alias("source_url"), take(r"(?s)<h1[^>]*>(.*?)</h1>").alias("title"), "html", "retrieved_at")


def batches(spark: SparkSession, root: str, name: str, schema: str, before: int | None = None) -> DataFrame:
    """What was stored by all micro-batches, or by those before one."""
    try:
        found = spark.read.schema(f"{schema}, batch long").parquet(f"{root}/{name}")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{schema}, batch long")
    return found if before is None else found.where(F.col("batch") < before)


def store_batch(root: str):
    """A foreachBatch function. A batch writes to folders of its own number and looks at earlier ones only, so that a batch
    that is run again after a failure writes the same rows over its own."""

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        pages = as_pages(batch)
        nameless = F.col("source_url").isNull()
        stored = batches(spark, root, "snapshots", SNAPSHOT, number).select("source_url", "content_sha256")
        new, errors = ingest.ingest(stored, pages.where(~nameless))
        new.select(*(c.split()[0] for c in SNAPSHOT.split(", "))).write.mode("overwrite").option("compression", "gzip").parquet(f"{root}/snapshots/batch={number}")
        held = spark.read.schema(SNAPSHOT).parquet(f"{root}/snapshots/batch={number}")  # parsed from what was stored
        ingest.extract_prices(held).write.mode("overwrite").parquet(f"{root}/prices/batch={number}")
        lost = pages.where(nameless).select("source_url", F.sha2("html", 256).alias("content_sha256"), F.lit("no_address").alias("reason"))
        errors.unionByName(lost).distinct().write.mode("overwrite").parquet(f"{root}/errors/batch={number}")

    return run


def ingest_landing(files: DataFrame, root: str) -> StreamingQuery:
    """Store what has arrived since the last run, then stop. The checkpoint counts each file once; contents and addresses
    that are stored already add nothing, whatever file they come in."""
    return files.writeStream.foreachBatch(store_batch(root)).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
