"""Each stage of the pipeline on empty tables, odd rows and columns whose names clash."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

SF = "/root/testdata/sf0.001"
EXTRA = ["row", "k", "words", "found", "score", "predicted", "kept", "x", "grp", "item", "c.d"]


def table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, "en", "s", 0), (None, "a b c", "en", "s", 5), (1, "", None, None, None)], docs.schema)
    return docs.union(odd).select("*", *[F.lit(n).alias(n) for n in EXTRA])


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stage(spark, name, stage):
    docs = table(spark)
    found = stage(spark, docs, SF)
    last = name == corpus_pipeline.STAGES[-1][0]
    if last:
        assert found.select("doc_id", "piece").distinct().count() <= found.count() >= docs.count()
    else:
        assert found.columns == docs.columns
        rows = found.collect()
        assert 0 < len(rows) <= docs.count() and all(r[n] == n for r in rows for n in EXTRA)
    empty = stage(spark, docs.limit(0), SF)
    assert empty.count() == 0 and empty.columns == found.columns


def test_many_ids_are_joined_by_a_shuffle(spark, monkeypatch):
    docs = table(spark)
    gone = docs.select("doc_id").limit(20)
    few = corpus_pipeline._without(docs, gone).count()
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_IDS", 1)
    assert corpus_pipeline._without(docs, gone).count() == few < docs.count()
