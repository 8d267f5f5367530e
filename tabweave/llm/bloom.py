"""A Bloom filter of bounded size over 64-bit keys, built on the executors and used to prune rows before a shuffle.

It only prunes: whatever it lets through by mistake is settled exactly afterwards, so a filter that is too small for
its keys costs work and no result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.arrays import mix

MOST_BITS = 1 << 28
SEGMENT = 1 << 16  # bytes
PROBES = 4


def _places(keys: np.ndarray, bits: int) -> np.ndarray:
    h = mix(keys.astype(np.int64).view(np.uint64))
    step = (h >> np.uint64(32)) | np.uint64(1)
    return np.concatenate([(h + np.uint64(k) * step) & np.uint64(bits - 1) for k in range(PROBES)])


class BloomFilter:
    """bits: a power of two, at most MOST_BITS (32 MB), so the broadcast is bounded whatever the number of keys."""

    def __init__(self, keys: DataFrame, column: str, expected: int):
        spark = keys.sparkSession
        self.bits = bits = min(MOST_BITS, 1 << max(16, int(expected * 12).bit_length()))

        def build(batches):
            flags = np.zeros(bits, bool) if bits <= 1 << 22 else None
            found: list[np.ndarray] = []
            for batch in batches:
                at = _places(batch.column(0).to_numpy(zero_copy_only=False), bits)
                if flags is not None:
                    flags[at.astype(np.int64)] = True
                else:
                    found.append(np.unique(at))
            if flags is None:
                flags = np.zeros(bits, bool)
                for at in found:
                    flags[at.astype(np.int64)] = True
            packed = np.packbits(flags)
            for s in range(0, len(packed), SEGMENT):
                part = packed[s : s + SEGMENT]
                if part.any():
                    yield pa.RecordBatch.from_pydict({"segment": pa.array([s // SEGMENT], pa.int32()), "part": pa.array([part.tobytes()], pa.binary())})

        def united(t: pa.Table) -> pa.Table:
            parts = np.bitwise_or.reduce([np.frombuffer(b, np.uint8) for b in t.column("part").to_pylist()])
            return pa.table({"segment": t.column("segment").slice(0, 1), "part": pa.array([parts.tobytes()], pa.binary())})

        rows = keys.select(column).mapInArrow(build, "segment int, part binary").groupBy("segment").applyInArrow(united, "segment int, part binary").collect()
        packed = np.zeros(bits // 8, np.uint8)
        for segment, part in rows:
            packed[segment * SEGMENT : segment * SEGMENT + len(part)] = np.frombuffer(bytes(part), np.uint8)
        self.shared = spark.sparkContext.broadcast(packed)

    def may_hold(self, column: str | Column) -> Column:
        """A boolean column: False only where the key is certainly not in the filter."""
        probe_keys = self.tester()

        @F.pandas_udf("boolean")
        def probe(keys: pd.Series) -> pd.Series:
            return pd.Series(probe_keys(keys.to_numpy(np.int64)))

        return probe(column)

    def tester(self):
        """A function of an int64 array for use inside other Python stages."""
        shared, bits = self.shared, self.bits

        def test(keys: np.ndarray) -> np.ndarray:
            packed = shared.value
            at = _places(keys, bits).reshape(PROBES, -1)
            hit = np.ones(at.shape[1], bool)
            for row in at.astype(np.int64):
                hit &= (packed[row >> 3] >> (7 - (row & 7)).astype(np.uint8) & 1).astype(bool)
            return hit

        return test


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows whose key is not in gone; rows that the filter clears are not shuffled."""
    route = BloomFilter(gone.select(F.xxhash64(F.col(key)).alias("__key")), "__key", gone.count())
    mark = F.xxhash64(F.col(key))
    return rows.filter(~route.may_hold(mark)).unionByName(rows.filter(route.may_hold(mark)).join(gone, key, "left_anti").select(*rows.columns))
