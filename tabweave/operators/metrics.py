"""Fidelity metrics between two tables, as aggregates.

Long form: both tables become (side, column, value), pre-aggregated to counts of distinct values before anything is
ordered. One-dimensional distances are then cumulative sums over values; these are taken in two levels (buckets of
values, then inside a bucket), so a column of very many distinct values is no single task's work.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-12
BUCKETS = 64


def long_form(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, v) for every non-null numeric value."""
    x = df.select(*[F.col(c).cast("double").alias(c) for c in cols])
    return x.unpivot([], cols, "col", "v").filter(F.col("v").isNotNull() & ~F.isnan("v"))


def value_counts(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """(col, v, na, nb): how often each value occurs on either side."""
    both = long_form(a, cols).withColumn("s", F.lit(0)).unionByName(long_form(b, cols).withColumn("s", F.lit(1)))
    return both.groupBy("col", "v").agg(F.sum(1 - F.col("s")).alias("na"), F.sum("s").alias("nb"))


def wasserstein_by_column(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """(col, wd): the exact 1-Wasserstein distance, the integral of |F - G|."""
    counts = value_counts(a, b, cols)
    # percentile_approx depends on the order in which parts arrive, and both uses below must see the same buckets: so the edges, a row
    # per column, are fixed here
    found = counts.groupBy("col").agg(F.percentile_approx("v", [i / BUCKETS for i in range(1, BUCKETS)], 1000).alias("edges"), F.sum("na").alias("ta"), F.sum("nb").alias("tb")).collect()
    edges = a.sparkSession.createDataFrame([tuple(r) for r in found], "col string, edges array<double>, ta bigint, tb bigint")
    placed = counts.join(F.broadcast(edges), "col").withColumn("bucket", F.size(F.filter("edges", lambda e: e < F.col("v"))))
    parts = placed.groupBy("col", "bucket").agg(F.sum("na").alias("ca"), F.sum("nb").alias("cb"), F.min("v").alias("low"))
    over = Window.partitionBy("col").orderBy("bucket")
    before = over.rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("col", "bucket", F.coalesce(F.sum("ca").over(before), F.lit(0)).alias("oa"), F.coalesce(F.sum("cb").over(before), F.lit(0)).alias("ob"), F.lead("low").over(over).alias("next_low"))
    inner = Window.partitionBy("col", "bucket").orderBy("v")
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    at = placed.join(F.broadcast(parts), ["col", "bucket"])
    gap = F.coalesce(F.lead("v").over(inner), F.col("next_low")) - F.col("v")
    fa = (F.col("oa") + F.sum("na").over(upto)) / F.col("ta")
    fb = (F.col("ob") + F.sum("nb").over(upto)) / F.col("tb")
    return at.select("col", (F.abs(fa - fb) * gap).alias("d")).groupBy("col").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("wd"))


def average_wasserstein(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    return wasserstein_by_column(a, b, cols).agg(F.avg("wd").alias("avg_wd"))


def ranges(a: DataFrame, b: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    x = lambda f, c: f(F.col(c).cast("double"))
    one = lambda df: df.agg(*[e for i, c in enumerate(cols) for e in (x(F.min, c).alias(f"l{i}"), x(F.max, c).alias(f"h{i}"))]).collect()[0]
    p, q = one(a), one(b)
    out = {}
    for i, c in enumerate(cols):
        lows, highs = [r[f"l{i}"] for r in (p, q) if r[f"l{i}"] is not None], [r[f"h{i}"] for r in (p, q) if r[f"h{i}"] is not None]
        if lows:
            out[c] = min(lows), max(highs)
    return out


def bin_of(v: Column, edges: list[float]) -> Column:
    """The bin of a value among n bins whose last is closed, by comparison with the edges themselves."""
    inner = F.array(*[F.lit(float(e)) for e in edges[1:-1]]) if len(edges) > 2 else F.array().cast("array<double>")
    return F.size(F.filter(inner, lambda e: e <= v))


def shared_edges(lo: float, hi: float, bins: int) -> list[float]:
    return [float(x) for x in np.linspace(lo, hi, bins + 1)]


def histogram_kl_by_column(a: DataFrame, b: DataFrame, cols: list[str], bins: int = 20, eps: float = EPS) -> DataFrame:
    """(col, kl): KL(a || b) of histograms over shared bins; 0 where both sides are one value."""
    span = ranges(a, b, cols)
    live = {c: shared_edges(lo, hi, bins) for c, (lo, hi) in span.items() if np.isfinite(lo) and np.isfinite(hi) and lo != hi}
    spark = a.sparkSession
    none = spark.createDataFrame([(c, 0.0) for c in cols if c not in live], "col string, kl double")
    if not live:
        return none

    def counted(df: DataFrame, name: str) -> DataFrame:
        binned = df.select(*[F.when(F.col(c).isNotNull(), bin_of(F.col(c).cast("double"), e)).alias(c) for c, e in live.items()])
        return binned.unpivot([], list(live), "col", "bin").filter("bin is not null").groupBy("col", "bin").agg(F.count(F.lit(1)).alias(name))

    grid = spark.createDataFrame([(c, i) for c in live for i in range(bins)], "col string, bin int")
    both = grid.join(counted(a, "na"), ["col", "bin"], "left").join(counted(b, "nb"), ["col", "bin"], "left").fillna(0, ["na", "nb"])
    total = Window.partitionBy("col")  # `bins` rows each
    p = (F.col("na") + F.lit(eps)) / F.sum(F.col("na") + F.lit(eps)).over(total)
    q = (F.col("nb") + F.lit(eps)) / F.sum(F.col("nb") + F.lit(eps)).over(total)
    return both.select("col", (p * (F.ln(p) - F.ln(q))).alias("t")).groupBy("col").agg(F.sum("t").alias("kl")).unionByName(none)


def correlation_pairs(df: DataFrame, cols: list[str]) -> Column:
    """An array of the correlations of all column pairs, undefined ones as 0, from one aggregation."""
    x = [F.col(c).cast("double") for c in cols]
    out = []
    for i in range(len(cols)):
        for j in range(i):
            both = lambda e: F.when(x[i].isNotNull() & x[j].isNotNull(), e)  # noqa: B023, E731
            sd = F.stddev_pop(both(x[i])) * F.stddev_pop(both(x[j]))
            out.append(F.coalesce(F.covar_pop(x[i], x[j]) / F.nullif(sd, F.lit(0.0)), F.lit(0.0)))
    return F.array(*out)


def correlation_frobenius(a: DataFrame, b: DataFrame, cols: list[str]) -> DataFrame:
    """One row corr_frob: the Frobenius norm of the difference of both correlation matrices."""
    p, q = a.agg(correlation_pairs(a, cols).alias("p")), b.agg(correlation_pairs(b, cols).alias("q"))
    squares = F.aggregate(F.zip_with("p", "q", lambda s, t: F.pow(s - t, 2)), F.lit(0.0), lambda s, t: s + t)
    return p.crossJoin(q).select(F.sqrt(F.lit(2.0) * squares).alias("corr_frob"))  # one row by one row


def js_by_column(a: DataFrame, b: DataFrame, cols: list[str], rounded: bool = False, eps: float = EPS) -> DataFrame:
    """(col, js): Jensen-Shannon divergence (natural log) of value frequencies; null is a value of its own."""
    def texts(df: DataFrame, s: int) -> DataFrame:
        pick = [(F.rint(F.col(c).cast("double")).cast("bigint") if rounded else F.col(c)).cast("string").alias(c) for c in cols]
        return df.select(*pick).unpivot([], cols, "col", "v").withColumn("s", F.lit(s))

    counts = texts(a, 0).unionByName(texts(b, 1)).groupBy("col", "v").agg(F.sum(1 - F.col("s")).alias("na"), F.sum("s").alias("nb"))
    totals = counts.groupBy("col").agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"), F.count(F.lit(1)).alias("k"))
    norm = lambda n, t: (F.col(n) / F.col(t) + F.lit(eps)) / (F.lit(1.0) + F.col("k") * F.lit(eps))
    p, q = norm("na", "ta"), norm("nb", "tb")
    m = (p + q) / 2
    term = (p * (F.ln(p) - F.ln(m)) + q * (F.ln(q) - F.ln(m))) / 2
    return counts.join(F.broadcast(totals), "col").select("col", term.alias("t")).groupBy("col").agg(F.sum("t").alias("js"))


def composite_score(a: DataFrame, b: DataFrame, continuous: list[str], discrete: list[str], categorical: list[str]) -> DataFrame:
    """One row: mean W1 of the continuous columns, mean JS of the others, and their sum."""
    spark = a.sparkSession
    empty = spark.createDataFrame([], "col string, js double")
    js = (js_by_column(a, b, discrete, True) if discrete else empty).unionByName(js_by_column(a, b, categorical) if categorical else empty).agg(F.coalesce(F.avg("js"), F.lit(0.0)).alias("mean_js"))
    wd = wasserstein_by_column(a, b, continuous).agg(F.avg("wd").alias("mean_wd")) if continuous else spark.range(1).select(F.lit(0.0).alias("mean_wd"))
    return wd.crossJoin(js).withColumn("composite", F.col("mean_wd") + F.col("mean_js"))  # one row by one row


def projections(dim: int, n: int, seed: str = "swd") -> np.ndarray:
    """n unit vectors from md5-keyed normals, the same in any engine."""
    import hashlib
    import math

    u = lambda *k: (int(hashlib.md5("|".join(map(str, k)).encode()).hexdigest()[:13], 16) + 0.5) / 4503599627370496.0
    m = np.array([[math.sqrt(-2 * math.log(u(f"{seed}:a", i, j))) * math.cos(2 * math.pi * u(f"{seed}:b", i, j)) for j in range(dim)] for i in range(n)])
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def sliced_wasserstein(a: DataFrame, b: DataFrame, vector: str, units: np.ndarray) -> DataFrame:
    """One row swd: the mean W1 of both tables' vectors projected on the given unit vectors."""
    names = [f"p{i}" for i in range(len(units))]

    def onto(df: DataFrame) -> DataFrame:
        dot = lambda w: F.aggregate(F.zip_with(F.col(vector), F.array(*[F.lit(float(x)) for x in w]), lambda s, t: s.cast("double") * t), F.lit(0.0), lambda s, t: s + t)
        return df.select(*[dot(w).alias(n) for w, n in zip(units, names)])

    return wasserstein_by_column(onto(a), onto(b), names).agg(F.avg("wd").alias("swd"))


def r2(df: DataFrame, truth: str, *predictions: str) -> DataFrame:
    """One row: r2_<prediction> = 1 - SSE/SST; two sums over centred values by one pass for the mean."""
    t = F.col(truth)
    return df.agg(*[(F.lit(1.0) - F.sum(F.pow(t - F.col(p), 2)) / F.nullif(F.var_pop(t) * F.count(t), F.lit(0.0))).alias(f"r2_{p}") for p in predictions])


def relative_percent(new: Column, old: Column) -> Column:
    return (new - old) / (F.abs(old) + F.lit(1e-12)) * 100


def fold_summary(folds: DataFrame, dataset: str, metrics: list[str]) -> DataFrame:
    """Mean and population deviation over folds, per dataset, ascending by the first metric's mean."""
    return folds.groupBy(dataset).agg(*[e for m in metrics for e in (F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]).orderBy(f"{metrics[0]}_mean")


def moments(df: DataFrame, cols: list[str]) -> DataFrame:
    """(col, mean, std): per column."""
    return long_form(df, cols).groupBy("col").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))


def quantile_bins(df: DataFrame, cols: list[str], bins: int = 5) -> tuple[DataFrame, dict[str, list[float]]]:
    """df with bin_<col>: ordinal bins between the exact quantiles; equal edges merge."""
    from tabweave.operators.transforms import exact_quantiles

    cuts: dict[str, list[float]] = {c: [] for c in cols}
    for i in range(1, bins):
        for c, v in exact_quantiles(df, cols, i / bins).items():
            if v is not None and (not cuts[c] or v > cuts[c][-1]):
                cuts[c].append(v)
    def ordinal(c: str) -> Column:
        edges = F.array(*[F.lit(v) for v in cuts[c]]) if cuts[c] else F.array().cast("array<double>")
        return F.size(F.filter(edges, lambda e: e <= F.col(c).cast("double")))

    return df.withColumns({f"bin_{c}": ordinal(c) for c in cols}), cuts
