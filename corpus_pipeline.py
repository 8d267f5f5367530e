"""A corpus pipeline of five operators; each stage takes (spark, docs, sf_dir) and returns a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.llm import exact_dedup, near_dedup, packing, quality, secrets
from tabweave.llm.queries import tokenizer_path
from tabweave.llm.shared import discard, fresh, in_subset, stored, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. It learns from the labelled documents that aren't held out."""
    labels = table(spark, sf_dir, "labels").filter(in_subset("doc_id", 5) != 0)
    return quality.keep_good(docs, quality.train(docs, labels))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays."""
    return exact_dedup.drop_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies one document stays."""
    return near_dedup.drop_near(docs)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars follows the text."""
    before = fresh(docs, "before")
    clean = secrets.redact(docs.withColumn(before, F.col("text")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        clean = clean.withColumn("n_chars", F.when(F.col("text") != F.col(before), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1024 ids."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("exact dedup", exact_stage),
    ("near dedup", near_stage),
    ("secret scan", secret_stage),
    ("packing", packing_stage),
]

#: Scores, alignments and tokens can't be expressed in SQL; tests hold the operators against brute force, and the stages to their results.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        last, docs = docs, stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if hasattr(last, "stored_at"):
            discard(last)
    return STAGES[-1][1](spark, docs, sf_dir)
