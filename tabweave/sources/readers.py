"""Sources and sinks: table bundles, CSV, JSON, metadata, generators, resumable results."""

from __future__ import annotations

import json
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.rand import normal, uniform


def table(spark: SparkSession, bundle: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{bundle}/{name}.parquet")


def read_bundle(spark: SparkSession, bundle: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: table(spark, bundle, n) for n in names}


def write_bundle(tables: dict[str, DataFrame], bundle: str, mode: str = "errorifexists") -> None:
    for n, df in tables.items():
        df.write.mode(mode).parquet(f"{bundle}/{n}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder that spark.checkpoint.dir names; a folder of this machine only where that
    is unset and all runs here."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = tempfile.mkdtemp(prefix="tabweave-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base}/tabweave/{name}-{uuid.uuid4().hex}"


def sniff_separator(header: str) -> str:
    """A semicolon if the header has one and no comma, else a comma."""
    return ";" if ";" in header and "," not in header else ","


def read_csv(spark: SparkSession, path: str, rename: dict[str, str] | None = None, numeric: list[str] | None = None) -> DataFrame:
    """A CSV file with a header; the separator is read off its first line; named columns become numbers or null."""
    from tabweave.functions.scalars import to_number

    head = spark.read.text(path).limit(1).collect()
    df = spark.read.option("header", True).option("sep", sniff_separator(head[0][0] if head else "")).csv(path)
    df = df.withColumnsRenamed(rename or {})
    return df.withColumns({c: to_number(F.col(c)) for c in numeric or []}) if numeric else df


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", sep: str = ",") -> None:
    df.write.mode(mode).option("header", True).option("sep", sep).csv(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_features_target(features: DataFrame, target: DataFrame, row_id: str) -> DataFrame:
    """Features and target side by side by row id; a target column whose name is taken becomes target__<name>."""
    names = {c: (f"target__{c}" if c in features.columns else c) for c in target.columns if c != row_id}
    return features.join(target.withColumnsRenamed(names), row_id)


def with_table_metadata(df: DataFrame, target: str, task: str) -> DataFrame:
    """Target and task as metadata of the target column; they travel with the schema."""
    return df.withMetadata(target, {"role": "target", "task": task})


def table_metadata(df: DataFrame) -> dict[str, str]:
    for f in df.schema.fields:
        if f.metadata.get("role") == "target":
            return {"target": f.name, "task": f.metadata["task"]}
    return {}


def best_params(text: str) -> dict:
    """Tuned parameters of a JSON record: best_params, else params, else its scalars."""
    record = json.loads(text)
    for key in ("best_params", "params"):
        if isinstance(record.get(key), dict):
            return record[key]
    return {k: v for k, v in record.items() if not isinstance(v, (dict, list))}


def existing(spark: SparkSession, path: str) -> DataFrame | None:
    """Earlier results at a path, or None: lets a run skip what it has done."""
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if re.search("PATH_NOT_FOUND|UNABLE_TO_INFER_SCHEMA", str(e)):
            return None
        raise


def append_trials(trials: DataFrame, path: str) -> None:
    """Trials of a study are kept in an append-only table, so a study can go on later."""
    trials.write.mode("append").parquet(path)


def two_moons(spark: SparkSession, n: int = 2000, noise: float = 0.2, seed: int = 42) -> DataFrame:
    """row_id, x1, x2, target (string): two interleaved half circles with keyed noise."""
    rows = spark.range(n).withColumnRenamed("id", "row_id")
    angle = uniform(f"moon{seed}", F.col("row_id")) * F.lit(3.141592653589793)
    up = F.col("row_id") % 2 == 0
    x1 = F.when(up, F.cos(angle)).otherwise(F.lit(1.0) - F.cos(angle))
    x2 = F.when(up, F.sin(angle)).otherwise(F.lit(0.5) - F.sin(angle))
    return rows.select("row_id", (x1 + noise * normal(f"m1{seed}", F.col("row_id"))).alias("x1"), (x2 + noise * normal(f"m2{seed}", F.col("row_id"))).alias("x2"), F.when(up, "0").otherwise("1").alias("target"))


#: Ranges of the columns of the housing toy table.
HOUSING_RANGES = {"med_inc": (0.5, 15.0), "house_age": (1.0, 52.0), "ave_rooms": (1.0, 10.0), "latitude": (32.5, 42.0), "longitude": (-124.3, -114.3)}
HOUSING = [*HOUSING_RANGES, "med_house_val"]


def housing(spark: SparkSession, n: int = 2000, seed: int = 42) -> DataFrame:
    """A toy table of houses made here (the public one would have to be fetched): uniform columns, and a target that
    rises with income and age and falls with latitude, with keyed noise."""
    rows = spark.range(n).withColumnRenamed("id", "row_id")
    rows = rows.withColumns({c: F.lit(lo) + F.lit(hi - lo) * uniform(f"house{seed}:{c}", F.col("row_id")) for c, (lo, hi) in HOUSING_RANGES.items()})
    value = F.lit(0.45) * F.col("med_inc") + F.lit(0.01) * F.col("house_age") - F.lit(0.4) * (F.col("latitude") - F.lit(35.6)) * F.lit(0.1)
    return rows.withColumn("med_house_val", value + F.lit(0.3) * normal(f"house{seed}:noise", F.col("row_id")))
