"""Quality classifier: each document's own evidence, combined with its site's by hierarchical empirical Bayes."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.common import Scratch, documents, heavy_join, kept

SAMPLE = 20_000  # labelled documents, about so many of them by their hash, on which the document classifier is fitted
RIDGE = 1.0
LEAST = 0.5  # posterior quality from which on a document stays
PRIOR_RANGE = (1.0, 1e6)
BROADCAST_SITES = 200_000

#: Byte classes: lower and upper case, digit, space, line end, sentence marks, other symbols, beyond ASCII.
CLASSES = 8
_of_byte = np.full(256, 6, np.uint8)
_of_byte[128:] = 7
_of_byte[97:123], _of_byte[65:91], _of_byte[48:58] = 0, 1, 2
_of_byte[[32, 9, 11, 12]], _of_byte[[10, 13]] = 3, 4
_of_byte[np.frombuffer(b".,;:?'\"-()", np.uint8)] = 5
FEATURES = CLASSES * CLASSES + 6


def text_features(text: str) -> np.ndarray:
    """Shares of class pairs, and how long and how repetitive words and lines are; zeros for an empty text."""
    out = np.zeros(FEATURES)
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return out
    kind = _of_byte[np.frombuffer(b"\n" + data + b"\n", np.uint8)].astype(np.int64)
    pairs = np.bincount(kind[:-1] * CLASSES + kind[1:], minlength=CLASSES * CLASSES)
    out[: CLASSES * CLASSES] = np.sqrt(pairs / pairs.sum())
    distinct = set(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    again = sum(a == b for a, b in zip(words, words[1:])) / len(words)
    out[CLASSES * CLASSES :] = math.log1p(len(words)), len(distinct) / len(words), len(set(lines)) / len(lines), math.log(sum(map(len, words)) / len(words)), math.log(max(map(len, words))), again
    return out


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weight + self.bias

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> Logistic:
        """Ridge logistic regression by Newton steps; without rows it says nothing (logit 0)."""
        if not len(y):
            return cls(np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0)
        mean, scale = x.mean(axis=0), x.std(axis=0)
        scale[scale < 1e-9] = 1.0
        z = np.column_stack([(x - mean) / scale, np.ones(len(y))])
        w, penalty = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
        penalty[-1] = 1e-2
        loss = lambda w: np.logaddexp(0, z @ w).sum() - y @ (z @ w) + 0.5 * penalty @ (w * w)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
            size, now = 1.0, loss(w)
            while loss(w + size * step) > now and size > 1e-4:
                size /= 2
            w = w + size * step
            if np.abs(size * step).max() < 1e-6:
                break
        return cls(mean, scale, w[:-1], float(w[-1]))


def featured(docs: DataFrame, host: Column, path: Column) -> DataFrame:
    """doc_id, key (of the text), host, path, x."""

    def take(batches):
        kept("quality")
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                x = np.array([text_features(t) for t in part.column(4).to_pylist()], np.float32).ravel()
                lists = pa.FixedSizeListArray.from_arrays(pa.array(x), FEATURES).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(4)), lists], ["doc_id", "key", "host", "path", "x"])

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("key"), F.coalesce(host.cast("string"), F.lit("")).alias("host"), F.coalesce(path.cast("string"), F.lit("")).alias("path"), text.alias("text"))
    return rows.mapInArrow(take, "doc_id long, key long, host string, path string, x array<float>")


def prior_strength(groups: DataFrame, mean: float) -> float:
    """How many documents' worth of evidence the mean over the groups (n, s) is, by the method of moments."""
    m = F.col("s") / F.col("n")
    row = groups.where("n > 0").agg(F.sum(F.col("n") * (m - mean) ** 2).alias("between"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
    if not row["n"] or mean <= 0 or mean >= 1:
        return PRIOR_RANGE[1]
    # E sum n (m - mean)^2 = (k - 1) mean (1 - mean) + n * variance between groups, near enough
    variance = max(0.0, (row["between"] - max(0, row["k"] - 1) * mean * (1 - mean)) / row["n"])
    return float(min(max(mean * (1 - mean) / max(variance, 1e-12) - 1, PRIOR_RANGE[0]), PRIOR_RANGE[1]))


def quality(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", least: float = LEAST, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, key (hash of its text), p_doc, host_rate, path_rate, quality, keep.

    p_doc is a logistic classifier's, from the document alone. A document counts in its site with its label, or with
    p_doc where it has none. The rate of a host is shrunk towards that of all documents, the rate of a path (here:
    language within source) towards its host's, each without the document itself and as strongly as the spread between
    groups suggests; so a sparse site stays near the global prior. quality = p_doc moved, in logits, by how far the
    path's rate is from the global one. keep: quality >= least.

    A null host or path is a group of its own, a null or empty text has the features zero, repeated rows are judged
    each, labels of unknown documents and null labels are left out, several labels of one document are averaged.
    Without labels p_doc is 0.5 and everything stays. The document classifier is fitted on the labelled documents whose
    hash is below a threshold that leaves about `sample` of them (all, if there are fewer); all else uses every row.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.table(featured(docs, F.col(host), F.col(path)), "features")
    labelled = scratch.table(labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("double").alias("label")), "labels")
    found = rows.join(labelled, "doc_id")
    share = int(min(1.0, sample / max(1, found.count())) * (1 << 30))
    chosen = found.where(F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << 30)) < share).select("doc_id", "key", "x", "label").toPandas().sort_values(["doc_id", "key"])
    x = np.stack(chosen["x"].to_numpy()).astype(float) if len(chosen) else np.empty((0, FEATURES))
    model = Logistic.fit(x, chosen["label"].to_numpy(float))

    def weigh(batches):
        for batch in batches:
            x = np.asarray(batch.column(4).flatten()).reshape(-1, FEATURES).astype(float)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(model.logits(x), pa.float64())], ["doc_id", "key", "host", "path", "logit"])

    weighed = rows.mapInArrow(weigh, "doc_id long, key long, host string, path string, logit double").join(labelled, "doc_id", "left")
    p = 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), F.col("logit")))))
    weighed = scratch.table(weighed.withColumn("p_doc", p).withColumn("y", F.coalesce("label", "p_doc")), "weighed")
    paths = scratch.table(weighed.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("s")), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    whole = paths.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = (whole["s"] or 0.0) / whole["n"] if whole["n"] else 0.5
    mean = min(max(mean, 1e-6), 1 - 1e-6)
    of_host, of_path = prior_strength(hosts.select(F.col("host_n").alias("n"), F.col("host_s").alias("s")), mean), prior_strength(paths, mean)
    sites = paths.join(hosts, "host")
    small = paths.count() <= BROADCAST_SITES
    placed = weighed.join(F.broadcast(sites), ["host", "path"]) if small else heavy_join(weighed, sites, ["host", "path"], scratch)
    host_rate = (F.col("host_s") - F.col("y") + of_host * mean) / (F.col("host_n") - 1 + of_host)
    path_rate = (F.col("s") - F.col("y") + of_path * F.col("host_rate")) / (F.col("n") - 1 + of_path)
    logit = lambda c: F.ln(F.greatest(F.lit(1e-9), c) / F.greatest(F.lit(1e-9), 1 - c))
    found = placed.withColumn("host_rate", host_rate).withColumn("path_rate", path_rate)
    moved = F.col("logit") + logit(F.col("path_rate")) - math.log(mean / (1 - mean))
    found = found.withColumn("quality", 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), moved)))))
    return found.select("doc_id", "key", "p_doc", "host_rate", "path_rate", "quality", (F.col("quality") >= least).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The input without the documents that the classifier rejects; columns stay as they are."""
    names = docs.columns
    keyed = docs.withColumn("_tl_key", F.xxhash64(F.coalesce("text", F.lit("")))).withColumn("_tl_id", F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    out = quality(docs, labels).where("not keep").select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_tl_id"), F.col("key").alias("_tl_key"))
    return keyed.join(out, ["_tl_id", "_tl_key"], "left_anti").select(*names)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("key")
