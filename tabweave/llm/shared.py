"""Shared storage, batching and counts for the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where that is unset and all runs
    on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tabweave-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and a lost executor costs a reread."""
    path = f"{shared_dir(df.sparkSession)}/tabweave/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Removes tables of stored() that nothing will read again."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(conf).delete(path, True)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark remove the shuffle files of jobs that are over; it does so when the driver collects its garbage."""
    spark._jvm.System.gc()


def bounded_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Arrow batches of at most so many rows and about so many bytes, so that a worker's memory doesn't grow with the
    length of texts; smaller settings stay."""
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        now = spark.conf.get(key, None)
        if key.endswith("maxBytesPerBatch") or now is None or not 0 < int(now) <= rows:
            spark.conf.set(key, str(most))


def fresh(df: DataFrame, stem: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem += "_"
    return stem


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts of a batch, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def in_subset(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(modulus).cast("bigint"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
