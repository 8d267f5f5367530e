"""Global ranks, permutations, folds and holdouts without a single-partition window.

A permutation orders rows by the md5 of (seed, id). Rows are dealt to buckets by the digest's first hex digits, which
are uniform; buckets are counted (a bounded table), their running totals are the offsets, and rows are numbered inside
their bucket. So an exact rank of all rows takes one shuffle by bucket and nothing lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabweave.functions.rand import digest

DIGITS = 3  # 4,096 buckets


def permutation_rank(df: DataFrame, id_col: str, seed: str | int, out: str = "rank", within: list[str] | None = None) -> DataFrame:
    """df with `out`: 1, 2, ... in the order of md5(seed|id), then id; and `n__`: the number of rows. within: restart for each group."""
    within = within or []
    keyed = df.withColumn("h__", digest(str(seed), F.col(id_col))).withColumn("b__", F.substring("h__", 1, DIGITS))
    sizes = keyed.groupBy(*within, "b__").agg(F.count(F.lit(1)).alias("c__"))
    # at most 16**DIGITS rows for each group
    over = Window.partitionBy(*(within or [F.lit(1)]))
    ahead = sizes.withColumn("o__", F.coalesce(F.sum("c__").over(over.orderBy("b__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n__", F.sum("c__").over(over)).drop("c__")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in within] + [F.col("l.b__") == F.col("r.b__")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = keyed.alias("l").join(ahead.alias("r"), cond).select("l.*", "r.o__", "r.n__")
    inner = F.row_number().over(Window.partitionBy(*within, "b__").orderBy("h__", id_col))
    return joined.withColumn(out, (F.col("o__") + inner).cast("bigint")).drop("h__", "b__", "o__")


def block_of(rank: Column, n: Column, k: int) -> Column:
    """The block (0-based) of a 1-based rank among k contiguous blocks whose first n % k are one larger."""
    small, more = F.floor(n / k), n % k
    edge = more * (small + 1)
    return F.when(rank <= edge, F.floor((rank - 1) / (small + 1))).otherwise(more + F.floor((rank - 1 - edge) / F.greatest(small, F.lit(1)))).cast("int")


def kfold(df: DataFrame, id_col: str, k: int, seed: str | int, label: str | None = None) -> DataFrame:
    """df with `fold` in 0 .. k-1: contiguous blocks of a permutation, or for a label dealt in turn inside each class."""
    if k < 2:
        raise ValueError("at least two folds are needed")
    if label is None:
        return permutation_rank(df, id_col, seed, "r__").withColumn("fold", block_of(F.col("r__"), F.col("n__"), k)).drop("r__", "n__")
    return permutation_rank(df, id_col, seed, "r__", [label]).withColumn("fold", ((F.col("r__") - 1) % k).cast("int")).drop("r__", "n__")


def require_rows(df: DataFrame, k: int) -> None:
    """A split into k folds needs k rows."""
    if df.limit(k).count() < k:
        raise ValueError(f"fewer than {k} rows")


def holdout(df: DataFrame, id_col: str, share: float, seed: str | int) -> DataFrame:
    """df with `is_val`: the first round(n*share) rows of a permutation, at least one and at most n-1."""
    if not 0 < share < 1:
        raise ValueError("the validation share must lie between 0 and 1")
    n = F.col("n__")
    most = F.least(F.greatest(F.rint(n * F.lit(share)), F.lit(1.0)), n - 1.0)
    return permutation_rank(df, id_col, seed, "r__").withColumn("is_val", F.col("r__") <= most).drop("r__", "n__")


def sample_without_replacement(df: DataFrame, id_col: str, n: int, seed: str | int) -> DataFrame:
    """The n rows of the smallest digests; a top-k, so no full sort."""
    return df.withColumn("h__", digest(str(seed), F.col(id_col))).orderBy("h__", id_col).limit(n).drop("h__")


def sample_with_replacement(df: DataFrame, id_col: str, n: int, seed: str | int, spark=None) -> DataFrame:
    """n draws (draw, then df's columns): each takes the row whose permutation rank its own hash names."""
    from tabweave.functions.rand import uniform

    ranked = permutation_rank(df, id_col, seed, "r__")
    total = df.count()
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (F.floor(uniform(f"{seed}:draw", F.col("id")) * F.lit(total)) + 1).alias("r__"))
    return draws.join(ranked, "r__").drop("r__", "n__")


def average_rank(df: DataFrame, group: str, entity: str, score: str) -> DataFrame:
    """Per entity the mean over groups of its average-method rank by score (ties share the mean of their places; groups without a score come last)."""
    w = Window.partitionBy(group)
    ranked = df.withColumn("r__", F.rank().over(w.orderBy(F.col(score).asc_nulls_last())) + (F.count(F.lit(1)).over(Window.partitionBy(group, score)) - 1) / 2)
    return ranked.groupBy(entity).agg(F.avg("r__").alias("avg_rank"), F.count(F.lit(1)).alias("n_groups"))
