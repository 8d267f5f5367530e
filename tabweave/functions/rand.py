"""Randomness as a pure function of (tag, row id): the same for any partitioning, retry or engine."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = 4503599627370496.0  # 2**52: thirteen hex digits of an md5


def _text(value: Column | str | int) -> Column:
    return value.cast("string") if isinstance(value, Column) else F.lit(str(value))


def digest(tag: Column | str, *ids: Column | str | int) -> Column:
    """md5 of tag|id|id..."""
    return F.md5(F.concat_ws("|", _text(tag), *map(_text, ids)))


def uniform(tag: Column | str, *ids: Column | str | int) -> Column:
    """In (0, 1)."""
    return (F.conv(F.substring(digest(tag, *ids), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(SPAN)


def normal(tag: str, *ids: Column | str | int) -> Column:
    """Standard normal by Box and Muller from two uniforms."""
    return F.sqrt(F.lit(-2.0) * F.ln(uniform(f"{tag}:a", *ids))) * F.cos(F.lit(2 * math.pi) * uniform(f"{tag}:b", *ids))


def generator(seed: int, *keys: int) -> np.random.Generator:
    """A counter-based generator for pandas stages, keyed by seed and row or group."""
    return np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, *[int(k) & 0xFFFFFFFFFFFF for k in keys]])))


def _scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_uniforms(keys: np.ndarray, seed: int, tag: int, n: int) -> np.ndarray:
    """n numbers in (0, 1) for each 64-bit key, a function of (seed, tag, key) alone; whole arrays at once."""
    with np.errstate(over="ignore"):
        start = _scrambled(np.array([seed * 1_000_003 + tag], np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
        own = _scrambled(keys.astype(np.int64).view(np.uint64) ^ start)[:, None]
        steps = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return ((_scrambled(own + steps) >> np.uint64(12)).astype(float) + 0.5) / SPAN


def hashed_normals(keys: np.ndarray, seed: int, tag: int, shape: tuple[int, ...]) -> np.ndarray:
    """Standard normals of a shape for each key, likewise."""
    n = int(np.prod(shape))
    u = hashed_uniforms(keys, seed, tag, 2 * n)
    return (np.sqrt(-2 * np.log(u[:, :n])) * np.cos(2 * math.pi * u[:, n:])).reshape(len(keys), *shape)
