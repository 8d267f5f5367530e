"""Row helpers of the generators: NaN filters, repetition, ids for generated rows, column order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.rand import uniform
from tabweave.operators.ranks import permutation_rank
from tabweave.operators.schema import clean_nan


def without_nan(df: DataFrame) -> DataFrame:
    return clean_nan(df).na.drop()


def require_no_nan(df: DataFrame) -> DataFrame:
    """df itself; raises where a row holds a null or NaN."""
    cols = clean_nan(df)
    bad = cols.filter(" or ".join(f"`{c}` is null" for c in df.columns)).limit(1).count()
    if bad:
        raise ValueError("rows with missing values")
    return df


def repeat_rows(df: DataFrame, times: int) -> DataFrame:
    """Each row `times` times, numbered by rep."""
    return df.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))


def reattach_ids(generated: DataFrame, row_col: str, ids: DataFrame, id_col: str, seed: int | str) -> DataFrame:
    """An id drawn with replacement for every generated row."""
    ranked = permutation_rank(ids.select(id_col), id_col, seed, "r__").select(id_col, "r__")
    total = ids.count()
    drawn = generated.withColumn("r__", F.floor(uniform(f"{seed}:id", F.col(row_col)) * F.lit(total)) + 1)
    return drawn.join(ranked, "r__").drop("r__")


def restore_order(df: DataFrame, order: list[str]) -> DataFrame:
    """The given columns first, then the rest."""
    first = [c for c in order if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])
