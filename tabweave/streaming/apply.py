"""Fitted pipelines on streams: every micro-batch passes through a transform whose state was learned beforehand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tabweave.operators.transforms import TransformPipeline


def read_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def apply_pipeline(stream: DataFrame, states: list[dict], sink: str, checkpoint: str) -> StreamingQuery:
    """Appends the transformed rows to a parquet sink; batches are idempotent by the checkpoint."""
    pipeline = TransformPipeline.of_state(states)
    return pipeline.transform(stream).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
