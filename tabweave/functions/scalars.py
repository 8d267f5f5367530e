"""Scalar expressions: names, parsing, log-space helpers, Gaussian terms, embeddings and schedules."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def slugify(c: Column, default: str = "dataset") -> Column:
    """Lower case, every run of other characters than letters and digits as one underscore, none at the ends."""
    s = F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(F.length(s) == 0, F.lit(default)).otherwise(s)


def first_number(c: Column) -> Column:
    """The mean of 'mean ± std' texts: their first number, else null."""
    return _try_double(F.regexp_extract(c, r"[-+]?[0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?", 0))


def _try_double(c: Column) -> Column:
    return c.try_cast("double")


def to_number(c: Column) -> Column:
    """A number, or null where the text is none."""
    return _try_double(F.trim(c.cast("string")))


def strict_number(c: Column) -> Column:
    """A number; null stays null, and a text that is no number is an error."""
    n = to_number(c)
    return F.when(c.isNotNull() & n.isNull(), F.raise_error(F.concat(F.lit("no number: "), c.cast("string")))).otherwise(n)


def clip_to_code(c: Column, categories: int) -> Column:
    """Rounded half to even and clipped to 0 .. categories-1."""
    return F.least(F.greatest(F.rint(c), F.lit(0.0)), F.lit(float(categories - 1))).cast("int")


def snap(c: Column, support: list[float]) -> Column:
    """The nearest value of a small support; of two as near the smaller one."""
    values = F.array(*[F.lit(float(v)) for v in sorted(support)])
    return F.array_min(F.transform(values, lambda v: F.struct(F.abs(c - v).alias("d"), v.alias("v"))))["v"]


def log_add_exp(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return top + F.ln(F.exp(a - top) + F.exp(b - top))


def log_one_minus_exp(a: Column) -> Column:
    """log(1 - exp(a)), with a floor."""
    return F.ln(F.lit(1.0) - F.exp(a) + F.lit(1e-40))


def log_sub_exp(a: Column, b: Column) -> Column:
    top = F.greatest(a, b)
    return F.ln(F.exp(a - top) - F.exp(b - top)) + top


def log_sum_exp(values: Column) -> Column:
    """Of an array column."""
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def normal_kl(mean1: Column, logvar1: Column, mean2: Column, logvar2: Column) -> Column:
    """KL divergence of two Gaussians given by mean and log variance."""
    return F.lit(0.5) * (F.lit(-1.0) + logvar2 - logvar1 + F.exp(logvar1 - logvar2) + F.pow(mean1 - mean2, 2) * F.exp(-logvar2))


def normal_cdf(x: Column) -> Column:
    """The tanh approximation of the standard normal distribution function."""
    return F.lit(0.5) * (F.lit(1.0) + F.tanh(F.lit(math.sqrt(2 / math.pi)) * (x + F.lit(0.044715) * F.pow(x, 3))))


def discretized_log_likelihood(x: Column, mean: Column, log_scale: Column, half_bin: float = 1 / 255) -> Column:
    """log of the Gaussian mass in the bin around x, for x scaled to [-1, 1]; the outer bins are open."""
    inv = F.exp(-log_scale)
    up, down = normal_cdf(inv * (x - mean + F.lit(half_bin))), normal_cdf(inv * (x - mean - F.lit(half_bin)))
    floor = lambda p: F.ln(F.greatest(p, F.lit(1e-12)))
    return F.when(x < -0.999, floor(up)).when(x > 0.999, floor(F.lit(1.0) - down)).otherwise(floor(up - down))


def time_embedding(t: Column, dim: int, max_period: float = 10_000.0) -> Column:
    """cos then sin of t at dim/2 falling frequencies, as an array."""
    if dim % 2:
        raise ValueError("the embedding dimension must be even")
    half = dim // 2
    freqs = [math.exp(-math.log(max_period) * i / half) for i in range(half)]
    return F.array(*[F.cos(t * f) for f in freqs], *[F.sin(t * f) for f in freqs])
