import numpy as np
from pyspark.sql import functions as F

from tideline.llm.quality import keep_good, quality


def test_held_out_accuracy(spark, small):
    where = small.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{where}/documents.parquet"), spark.read.parquet(f"{where}/labels.parquet")
    out = F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0
    got = quality(docs, labels.where(~out)).join(labels.where(out).select("doc_id", F.col("quality").alias("label")), "doc_id").toPandas()
    good = got["label"] == 1
    assert got.loc[good, "keep"].mean() > 0.97 and (~got.loc[~good, "keep"]).mean() > 0.8


def test_sparse_sites_shrink_to_the_global_rate(spark):
    rows = [(k, "good text of words here", "en", "big") for k in range(200)] + [(1000 + k, "good text of words here", "en", "bad") for k in range(200)] + [(5000, "good text of words here", "en", "rare")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(k, 1) for k in range(200)] + [(1000 + k, 0) for k in range(200)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality(docs, labels).collect()}
    assert got[0].path_rate > 0.9 and got[1000].path_rate < 0.1 and abs(got[5000].path_rate - 0.5) < 0.01
    assert got[0].keep and not got[1000].keep


def test_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, "x"), (1, None, "x"), (None, 0, "x"), (2, 1, "x"), (777, 0, "x")], "doc_id long, quality int, x string")
    for use in (labels, labels.limit(0)):
        got = quality(odd, use).toPandas()
        assert len(got) == odd.count() and np.isfinite(got["quality"]).all()
        assert quality(none, use).count() == 0
    left = keep_good(odd, labels.limit(0))
    assert left.columns == odd.columns and left.count() == odd.count()


def test_rates_are_those_of_the_groups(spark, small):
    """Host and path rates, from the documents' own values, computed again in pandas."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    got = quality(docs, labels).toPandas().set_index("doc_id").sort_index()
    rows = docs.select("doc_id", "source", "lang").toPandas().set_index("doc_id").sort_index().fillna("")
    label = labels.where("quality is not null").groupBy("doc_id").agg(F.avg("quality").alias("q")).toPandas().set_index("doc_id")["q"]
    y = (label >= 0.5).astype(float).reindex(got.index).fillna(got["p_doc"])
    mean = y.mean()

    def strength(groups):
        n, s = groups.count(), groups.sum()
        between, k = (n * (s / n - mean) ** 2).sum(), len(n)
        spread = max(0.0, (between - max(0, k - 1) * mean * (1 - mean)) / n.sum())
        return min(max(mean * (1 - mean) / max(spread, 1e-12) - 1, 1.0), 1e6)

    host, path = y.groupby(rows["source"]), y.groupby([rows["source"], rows["lang"]])
    of_host, of_path = strength(host), strength(path)
    host_rate = (host.transform("sum") - y + of_host * mean) / (host.transform("count") - 1 + of_host)
    path_rate = (path.transform("sum") - y + of_path * host_rate) / (path.transform("count") - 1 + of_path)
    assert np.allclose(got["host_rate"], host_rate) and np.allclose(got["path_rate"], path_rate)


def test_the_sample_follows_its_parameter(spark, small, monkeypatch):
    """Few labelled documents make another model, all else stays whole; joined sites give what broadcast ones do."""
    docs, labels = spark.read.parquet(f"{small}/documents.parquet"), spark.read.parquet(f"{small}/labels.parquet")
    key = lambda df: {r.doc_id: (round(r.host_rate, 9), r.keep) for r in df.collect()}
    whole, few = key(quality(docs, labels)), key(quality(docs, labels, sample=20))
    assert len(few) == len(whole) and few != whole
    monkeypatch.setattr("tideline.llm.quality.BROADCAST_SITES", 0)
    assert key(quality(docs, labels)) == whole
