from pyspark.sql import functions as F

import corpus_pipeline
from tideline.llm.decontaminate import decontaminate
from tideline.llm.exact_dedup import exact_dedup
from tideline.llm.jaccard_join import jaccard_join
from tideline.llm.quality import quality


def test_stages_take_effect(spark, small, docs):
    labels, benchmark = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("labels", "benchmark"))
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    left = docs.where(F.col("doc_id").isin(list(ids(quality(docs, labels).where("keep")))))
    left = left.where(F.col("doc_id").isin(list(ids(exact_dedup(left).where("kept")))))
    left = left.where(F.col("doc_id").isin(list(ids(jaccard_join(left).where("class_id = doc_id")))))
    left = left.where(F.col("doc_id").isin(list(ids(decontaminate(left, benchmark).where("not contaminated")))))
    got = corpus_pipeline.run(spark, small)
    assert got.where("not round_trip").count() == 0
    assert ids(got) == ids(left) and 0 < got.count() < docs.count()
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_return_the_columns(spark, small, odd):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == odd.columns, name
    assert docs.count() > 0


def test_empty_tables(spark, small, odd, none, tmp_path):
    """Without documents nothing comes out; without labels and benchmark only copies go."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    odd.write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.where("not round_trip and doc_id <> 9").isEmpty() and 0 < got.count() < odd.count()
    docs = none
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.isEmpty()
