"""Exact deduplication by counting quotient filters.

Every partition builds counting quotient filters over the 64-bit fingerprints of its normalised texts: a fingerprint
is a quotient (its place) and a remainder (kept in its quotient's run, sorted, with a count). The fingerprint space is
dealt to blocks by its leading bits; filters of one block merge without loss by their sorted remainders. Fingerprints
whose merged count is above one route their rows to byte verification, where rows are grouped by the text itself.

Only rows that may be duplicates move their text, already collapsed to one row per text and task. A group that holds
a third of all rows is therefore one entry per partition in the filters and one row per task in the verification.

Defined results: null counts as the empty text; of equal texts the smallest id stays, and of rows that repeat that id
one stays; a row without an id
stays only where its group has no id at all; an empty table gives no rows; texts of any length are compared whole;
columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.llm.bloom import BloomFilter
from tabweave.llm.shared import bounded_batches, fresh, stored

#: Merged filters of one block are held in one task; so many fingerprints each at most on average.
BLOCK_ROWS = 1_000_000


class CountingQuotientFilter:
    """Sorted runs of remainders by quotient, with counts.

    occupied: a bit per quotient that has a run; run_ends: a bit per slot that ends a run; remainders and counts: a
    slot each. This is all of a quotient filter's content without its empty slots, so it is also the form in which
    filters travel.
    """

    def __init__(self, quotient_bits: int, remainder_bits: int, occupied: np.ndarray, run_ends: np.ndarray, remainders: np.ndarray, counts: np.ndarray):
        self.q, self.r = quotient_bits, remainder_bits
        self.occupied, self.run_ends, self.remainders, self.counts = occupied, run_ends, remainders, counts

    @classmethod
    def build(cls, fingerprints: np.ndarray, counts: np.ndarray, quotient_bits: int, remainder_bits: int) -> CountingQuotientFilter:
        """fingerprints: distinct, sorted, of quotient_bits + remainder_bits bits."""
        quotients = (fingerprints >> np.uint64(remainder_bits)).astype(np.int64)
        occupied = np.zeros(1 << quotient_bits, bool)
        occupied[quotients] = True
        ends = np.append(quotients[1:] != quotients[:-1], True) if len(quotients) else np.zeros(0, bool)
        return cls(quotient_bits, remainder_bits, np.packbits(occupied), np.packbits(ends), fingerprints & np.uint64((1 << remainder_bits) - 1), counts.astype(np.int64))

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """All fingerprints, sorted, and their counts: nothing is lost."""
        n = len(self.remainders)
        run = np.cumsum(np.append(0, np.unpackbits(self.run_ends, count=n)[:-1])) if n else np.zeros(0, np.int64)
        quotients = np.flatnonzero(np.unpackbits(self.occupied, count=1 << self.q))[run] if n else np.zeros(0, np.int64)
        return (quotients.astype(np.uint64) << np.uint64(self.r)) | self.remainders, self.counts

    def __len__(self) -> int:
        return len(self.remainders)

    def count(self, fingerprint: int) -> int:
        found, counts = self.items()
        at = int(np.searchsorted(found, np.uint64(fingerprint)))
        return int(counts[at]) if at < len(found) and int(found[at]) == fingerprint else 0

    @staticmethod
    def merge(filters: list[CountingQuotientFilter]) -> CountingQuotientFilter:
        """One filter with the summed counts, by merging the sorted runs."""
        parts = [f.items() for f in filters]
        keys, counts = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        summed = np.add.reduceat(counts, first) if len(first) else counts
        return CountingQuotientFilter.build(keys[first], summed, filters[0].q, filters[0].r)

    def row(self, block: int) -> dict:
        return {"block": block, "q": self.q, "occupied": self.occupied.tobytes(), "run_ends": self.run_ends.tobytes(), "remainders": self.remainders.tobytes(), "counts": self.counts.tobytes()}

    @classmethod
    def of_row(cls, row: dict, bits: int) -> CountingQuotientFilter:
        u8 = lambda k: np.frombuffer(row[k], np.uint8)
        return cls(row["q"], bits - row["q"], u8("occupied"), u8("run_ends"), np.frombuffer(row["remainders"], np.uint64), np.frombuffer(row["counts"], np.int64))

    def requotiented(self, quotient_bits: int) -> CountingQuotientFilter:
        """The same content with another split of the bits, so that filters of different sizes merge."""
        if quotient_bits == self.q:
            return self
        keys, counts = self.items()
        return self.build(keys, counts, quotient_bits, self.q + self.r - quotient_bits)


FILTER_ROW = "block int, q int, occupied binary, run_ends binary, remainders binary, counts binary"


def repeated_fingerprints(light: DataFrame, column: str, rows: int) -> DataFrame:
    """Fingerprints (as bigint) with a merged count above one, and that count."""
    block_bits = max(4, (rows // BLOCK_ROWS).bit_length())
    inner = 64 - block_bits
    arrow = pa.schema([("block", pa.int32()), ("q", pa.int32()), *((n, pa.binary()) for n in ("occupied", "run_ends", "remainders", "counts"))])

    def build(batches):
        held, total = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
            total += len(held[-1])
            if total > 2_000_000:
                yield from filters(held)
                held, total = [], 0
        if total:
            yield from filters(held)

    def filters(held):
        keys, counts = np.unique(np.concatenate(held), return_counts=True)
        bounds = np.searchsorted(keys >> np.uint64(inner), np.arange((1 << block_bits) + 1, dtype=np.uint64))
        rows = []
        for b, (lo, hi) in enumerate(zip(bounds, bounds[1:])):
            if hi > lo:
                q = min(inner - 1, max(3, int(hi - lo).bit_length()))
                own = keys[lo:hi] & np.uint64((1 << inner) - 1)
                rows.append(CountingQuotientFilter.build(own, counts[lo:hi], q, inner - q).row(b))
        yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    def merged(t: pa.Table) -> pa.Table:
        rows = t.to_pylist()
        parts = [CountingQuotientFilter.of_row(r, inner) for r in rows]
        widest = max(p.q for p in parts)
        keys, counts = CountingQuotientFilter.merge([p.requotiented(widest) for p in parts]).items()
        many = counts > 1
        whole = (keys[many] | np.uint64(rows[0]["block"] << inner)).view(np.int64)
        return pa.table({column: pa.array(whole, pa.int64()), "n": pa.array(counts[many], pa.int64())})

    return light.select(column).mapInArrow(build, FILTER_ROW).groupBy("block").applyInArrow(merged, f"{column} bigint, n bigint")


def normalised(text: str | Column = "text") -> Column:
    """Null as empty, every run of white space [\\x20\\x09-\\x0D]+ as one space (runs that are one space already are left)."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]{2,}|[\\x09-\\x0D]", " ")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame, BloomFilter]:
    """(rows, groups, route). rows: every row's id, _row, _fp, text_sha256. groups, only those of two rows or more:
    _fp, text_sha256, keep_id, keep_row, group_size. Both are stored. route: holds the _fp of every row of groups."""
    bounded_batches(docs.sparkSession)
    norm = docs.select(F.col(id_col).alias("doc_id"), normalised(text_col).alias("_norm"))
    rows = stored(norm.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.xxhash64("_norm").alias("_fp"), F.sha2("_norm", 256).alias("text_sha256")), "exact-rows")
    total = rows.count()
    repeated = stored(repeated_fingerprints(rows, "_fp", total), "exact-fingerprints")
    route = BloomFilter(repeated, "_fp", repeated.count())
    # byte verification: rows are one group only if the texts themselves are equal
    suspects = norm.withColumn("_fp", F.xxhash64("_norm")).filter(route.may_hold("_fp"))
    verified = suspects.groupBy("_fp", "_norm").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_fp", F.sha2("_norm", 256).alias("text_sha256"))
    members = rows.filter(route.may_hold("_fp")).groupBy("_fp", "text_sha256").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_row")).alias("_keep"), F.count(F.lit(1)).alias("group_size"))
    groups = members.join(verified, ["_fp", "text_sha256"]).select("_fp", "text_sha256", F.col("_keep.doc_id").alias("keep_id"), F.col("_keep._row").alias("keep_row"), "group_size")
    return rows, stored(groups, "exact-groups"), route


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    rows, groups, _ = duplicate_groups(docs, id_col, text_col)
    return rows.join(groups, ["_fp", "text_sha256"], "left").select(
        "doc_id",
        F.coalesce("keep_id", "doc_id").alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"),
        F.coalesce(F.col("keep_row") == F.col("_row"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies; all columns of docs. Only rows that the filter routes to verification are shuffled."""
    rows, groups, route = duplicate_groups(docs, id_col, text_col)
    fp, sha, keep, size = (fresh(docs, n) for n in ("fp", "sha", "keep", "size"))
    keyed = docs.withColumn(fp, F.xxhash64(normalised(F.col(text_col))))
    plain = keyed.filter(~route.may_hold(fp)).select(*(F.col(f"`{c}`") for c in docs.columns))
    mine = groups.select(F.col("_fp").alias(fp), F.col("text_sha256").alias(sha), F.col("keep_id").alias(keep), F.col("group_size").alias(size))
    routed = keyed.filter(route.may_hold(fp)).withColumn(sha, F.sha2(normalised(F.col(text_col)), 256)).join(mine, [fp, sha], "left")
    kept = routed.filter(F.col(size).isNull() | F.col(keep).eqNullSafe(F.col(id_col)))
    again = rows.join(groups, ["_fp", "text_sha256"]).filter("doc_id <=> keep_id and _row <> keep_row").limit(1).count()
    if again:  # rows that repeat the id that stays: one of them
        kept = kept.filter(F.col(size).isNull()).unionByName(kept.filter(F.col(size).isNotNull()).dropDuplicates([fp, sha]))
    return plain.unionByName(kept.select(*(F.col(f"`{c}`") for c in docs.columns)))
