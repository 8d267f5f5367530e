"""The pipeline's stages, each on its own input, and as a whole."""

import re

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

KEY = "wJalrXUtnFEMIK7MDENGbPxRfiCY9kq9"


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").cache()


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_order_and_columns(spark, docs, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "near dedup", "secret scan", "packing"]
    for name, f in corpus_pipeline.STAGES[:-1]:
        assert f(spark, docs, sf).dtypes == docs.dtypes


def test_quality_keeps_good_documents(spark, docs, sf):
    kept = {r.doc_id for r in stage("quality classifier")(spark, docs, sf).select("doc_id").collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    right = sum((r.doc_id in kept) == bool(r.quality) for r in labels)
    assert right / len(labels) >= 0.9


def test_exact_stage(spark, docs, sf):
    twice = docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10_000).withColumn("text", F.concat("text", F.lit(""))))
    out = stage("exact dedup")(spark, twice, sf).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in twice.collect():
        groups.setdefault(norm(r.text), []).append(r.doc_id)
    assert sorted(r.doc_id for r in out) == sorted(min(g) for g in groups.values())


def test_secret_stage(spark, sf):
    rows = [(0, f"a {KEY} b", "en", "s", 99), (1, "clean", "en", "s", 5), (2, None, None, None, None)]
    out = {r.doc_id: r for r in stage("secret scan")(spark, spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint"), sf).collect()}
    assert KEY not in out[0].text and out[0].n_chars == len(out[0].text) and out[1].n_chars == 5 and out[2].text is None


def test_whole_run(spark, sf):
    rows = corpus_pipeline.run(spark, sf).collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())
