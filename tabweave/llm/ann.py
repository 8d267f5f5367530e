"""Approximate nearest neighbours by multi-index hashing over learned rotated binary codes.

Codes: vectors of length one are centred, turned to their principal axes and then by a rotation that brings them close
to the corners of a cube (iterative quantisation); signs are bits. Several rotations give longer codes. Mean, axes and
rotations are learned on a bounded sample; every row is indexed.

Index: rows are dealt to shards of bounded size, independent of their content, so a vector or code that holds a third
of all rows lies spread over all shards. In its shard a code is split into substrings of 16 bits, each with a table of
its buckets. A query probes by the pigeonhole rule: if two codes of m substrings differ in at most r = m*a + b
bits, then one of the first b + 1 substrings differs in at most a, or one of the others in at most a - 1. So all rows
within the radius are retrieved, by the masks of so few bits or, where these outnumber the occupied buckets, by
comparing those; then they are checked on their whole codes, and only the floats of rows within the radius are reranked
in double precision.

The radius is learned too: the neighbours that `probes` rows of the sample have among all rows, at `target` quantile of
their code distance. A query that has
fewer than k rows within it, over all shards, is asked again of every row: nothing is capped, and neither shards nor the
layout of the input change what is found. A shard's index is built once; queries stream past it in batches.

Defined results: vectors that are null, zero, of another length than the most common one, or hold a null or
non-finite component take no part; ties go to the smaller id; a query with fewer other rows gets all of them; rows
that repeat an id are candidates each, and a query whose id repeats is answered once per row; an empty table gives no
rows; other columns are not read. Components too large or small to be squared are scaled first.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.llm.arrays import ragged
from tabweave.llm.shared import bounded_batches, discard, stored

PART = 16


@dataclass(frozen=True)
class AnnParams:
    k: int = 5
    bits: int = 128
    sample: int = 8_000
    target: float = 0.97
    probes: int = 200
    shard_rows: int = 16_384


@dataclass
class Hasher:
    mean: np.ndarray
    turn: np.ndarray
    radius: int

    def codes(self, unit: np.ndarray) -> np.ndarray:
        """Rows of 16-bit substrings."""
        out = [np.zeros((0, self.turn.shape[1] // PART), np.uint16)]
        for lo in range(0, len(unit), 8192):
            bits = (unit[lo : lo + 8192] - self.mean) @ self.turn > 0
            out.append(np.packbits(bits, axis=1).view(">u2").astype(np.uint16))
        return np.concatenate(out)


def distances(codes: np.ndarray, code: np.ndarray) -> np.ndarray:
    return np.bitwise_count(codes ^ code).sum(1, dtype=np.int32)


def cosines(a: np.ndarray, an: np.ndarray, b: np.ndarray, bn: float) -> np.ndarray:
    """Cosines in double precision, each row by the same sum whatever stands beside it."""
    return (a * b).sum(1) / (an * bn)


def lengths_of(vectors: np.ndarray) -> np.ndarray:
    """Euclidean lengths."""
    return np.sqrt((vectors * vectors).sum(1))


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows times a power of two where their squares would leave the range of doubles; the cosine stays as it is."""
    top = np.abs(vectors).max(axis=1, initial=0)
    far = (top > 1e140) | (top < 1e-140)
    if far.any():
        vectors = vectors.copy()
        vectors[far] = np.ldexp(vectors[far], -np.frexp(top[far])[1][:, None])
    return vectors


def learn(vectors: np.ndarray, p: AnnParams, seed: int = 11) -> Hasher:
    unit = vectors / lengths_of(vectors)[:, None]
    d = unit.shape[1]
    rng = np.random.default_rng(seed)
    mean = unit.mean(0)
    _, axes = np.linalg.eigh(np.cov((unit - mean).T) if len(unit) > 1 else np.eye(d))
    axes = axes[:, ::-1]
    turns, width = [], 0
    while width < p.bits:
        n = min(d, p.bits - width)
        v = (unit - mean) @ axes[:, :n]
        r = np.linalg.qr(rng.normal(size=(n, n)))[0]
        for _ in range(25):
            u, _, w = np.linalg.svd(np.where(v @ r > 0, 1.0, -1.0).T @ v)
            r = (u @ w).T
        turns.append(axes[:, :n] @ r)
        width += n
    out = Hasher(mean, np.concatenate(turns, axis=1), p.bits)
    codes = out.codes(unit)
    probes = unit[: min(400, len(unit))]
    found = []
    for i, q in enumerate(probes):
        s = unit @ q
        s[i] = -2
        near = np.argpartition(-s, min(p.k, len(s) - 1))[: p.k] if len(s) > p.k else np.flatnonzero(s > -2)
        found += distances(codes[near], codes[i]).tolist()
    if found:
        out.radius = int(np.quantile(found, p.target))
    return out


#: Masks of 16 bits by their number of set bits.
MASKS = np.arange(1 << PART, dtype=np.uint16)[np.argsort(np.bitwise_count(np.arange(1 << PART, dtype=np.uint16)), kind="stable")]
UPTO = np.cumsum(np.bincount(np.bitwise_count(MASKS), minlength=PART + 1))


class Shard:
    """The multi-index of one shard."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, hasher: Hasher):
        self.ids, self.vectors, self.hasher = ids, vectors, hasher
        self.norms = lengths_of(vectors)
        self.codes = hasher.codes(vectors / self.norms[:, None])
        self.reranked = 0
        # for each substring: rows by value, where each value's rows begin, and the values that occur
        self.tables = []
        for s in range(self.codes.shape[1]):
            counts = np.bincount(self.codes[:, s], minlength=1 << PART)
            begins = np.zeros((1 << PART) + 1, np.int32)
            np.cumsum(counts, out=begins[1:])
            self.tables.append((np.argsort(self.codes[:, s], kind="stable").astype(np.int32), begins, np.flatnonzero(counts).astype(np.uint16)))

    def within(self, code: np.ndarray) -> np.ndarray:
        """Places of all rows within the radius, by pigeonhole probing."""
        m = len(code)
        a, b = divmod(self.hasher.radius, m)
        hit = np.zeros(len(self.ids), bool)
        for s, (rows, begins, occupied) in enumerate(self.tables):
            reach = min(a if s <= b else a - 1, PART)
            if reach < 0:
                continue
            probes = UPTO[reach]
            values = MASKS[:probes] ^ code[s] if probes < len(occupied) else occupied[np.bitwise_count(occupied ^ code[s]) <= reach]
            at = begins[values]
            hit[rows[ragged(at, begins[values.astype(np.int64) + 1] - at)]] = True
        at = np.flatnonzero(hit)
        return at[distances(self.codes[at], code) <= self.hasher.radius]

    def search(self, qid, q: np.ndarray, k: int, everything: bool = False) -> list[tuple[int, float]]:
        """The k nearest of the rows within the radius, or of all rows; fewer if there are fewer."""
        qn = float(lengths_of(q[None, :])[0])
        at = np.arange(len(self.ids)) if everything else self.within(self.hasher.codes((q / qn)[None, :])[0])
        at = at[self.ids[at] != qid]
        self.reranked += len(at)
        if len(at) > 4 * k:  # the slack keeps every row that may be among the k
            rough = self.vectors[at] @ q / self.norms[at]
            at = at[rough >= np.partition(rough, len(rough) - k)[len(rough) - k] - 1e-9 * qn]
        score = cosines(self.vectors[at], self.norms[at], q, qn)
        best = np.lexsort((self.ids[at], -score))[:k]
        return list(zip(self.ids[at][best].tolist(), score[best].tolist()))


def matrix(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return scaled(flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1))


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id and v of the rows that take part."""
    v = F.col(vector_col)
    if vectors.schema[vector_col].dataType.elementType.simpleString() not in ("float", "double"):
        v = F.transform(v, lambda x: x.cast("double"))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v"))
    fine = rows.filter(F.col("id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0))
    return fine.withColumn("dim", F.size("v"))


def radius_over(rows: DataFrame, probes: pa.Table, hasher: Hasher, p: AnnParams) -> int:
    """The target quantile of the code distances between the probes (id, v) and their k nearest of all rows."""
    if not probes.num_rows:
        return hasher.radius
    ids, v = probes.column("id").to_pylist(), matrix(probes.column("v"))
    shared = rows.sparkSession.sparkContext.broadcast((ids, v / lengths_of(v)[:, None], hasher))  # at most `probes` rows

    def near(batches):
        ids, unit, own = shared.value
        codes = own.codes(unit)
        best: list[list[tuple[float, int]]] = [[] for _ in ids]
        for batch in batches:
            x, names = matrix(batch.column("v")), batch.column("id").to_pylist()
            x /= lengths_of(x)[:, None]
            at, score = own.codes(x), x @ unit.T
            for k, name in enumerate(ids):
                top = np.argpartition(-score[:, k], p.k)[: p.k + 1] if len(x) > p.k + 1 else np.arange(len(x))
                mine = [(-float(score[i, k]), int(d)) for i, d in zip(top.tolist(), distances(at[top], codes[k])) if names[i] != name]
                best[k] = sorted(best[k] + mine)[: p.k]
        yield pa.RecordBatch.from_pylist([{"probe": k, "far": f, "apart": d} for k, b in enumerate(best) for f, d in b], schema=pa.schema([("probe", pa.int32()), ("far", pa.float64()), ("apart", pa.int32())]))

    found = rows.select("id", "v").mapInArrow(near, "probe int, far double, apart int").groupBy("probe")
    found = found.agg(F.slice(F.array_sort(F.collect_list(F.struct("far", "apart"))), 1, p.k).alias("best")).select(F.explode("best.apart").alias("apart")).toArrow()
    return int(np.quantile(found.column("apart").to_numpy(), p.target)) if found.num_rows else hasher.radius


def nearest(vectors: DataFrame, queries, p: AnnParams = AnnParams(), id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """queries: a boolean Column over id. One row per query and rank: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = stored(usable(vectors, id_col, vector_col).withColumn("is_query", queries).withColumn("place", F.monotonically_increasing_id()), "ann-rows")
    sizes = rows.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    kind = vectors.schema[id_col].dataType.simpleString()
    if not sizes:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    dim, total = sizes[0]
    all_rows, rows = rows, rows.filter(F.col("dim") == dim)
    # by content, so that neither the layout nor the order of the input changes what is learned
    mark = F.xxhash64(F.lit(23), "id", "v")
    chosen = rows.filter(F.pmod(mark, F.lit(1_000_000)) < int(min(1.0, p.sample / total) * 1_000_000) + 1)
    sample = chosen.select(mark.alias("mark"), "id", "v").distinct().toArrow().sort_by([("mark", "ascending"), ("id", "ascending")])
    hasher = learn(matrix(sample.column("v")) if sample.num_rows else np.eye(dim), p)
    hasher.radius = radius_over(rows, sample.slice(0, p.probes), hasher, p)
    shared = spark.sparkContext.broadcast(hasher)  # dim x bits numbers
    shards = -(-total // p.shard_rows)

    def answers(asked: DataFrame, everything: bool, name: str) -> DataFrame:
        """The k nearest of each shard, for each query."""

        def search(batches):
            index, at, shard = [], None, None
            for batch in batches:
                number, is_query = batch.column("shard").to_numpy(), batch.column("is_query").to_numpy(zero_copy_only=False)
                cuts = np.flatnonzero(np.append(True, (number[1:] != number[:-1]) | (is_query[1:] != is_query[:-1])))
                for lo, hi in zip(cuts.tolist(), [*cuts[1:].tolist(), len(number)]):
                    some = batch.slice(lo, hi - lo)
                    if number[lo] != at:
                        index, at, shard = [], number[lo], None
                    if not is_query[lo]:
                        index.append((some.column("id").to_numpy(zero_copy_only=False), matrix(some.column("v"))))
                        continue
                    if not index:
                        continue
                    shard = shard or Shard(np.concatenate([x for x, _ in index]), np.concatenate([x for _, x in index]), shared.value)
                    out = [(qid, place, i, score) for qid, place, q in zip(some.column("id").to_pylist(), some.column("place").to_pylist(), matrix(some.column("v"))) for i, score in shard.search(qid, q, p.k, everything)]
                    t = some.schema.field("id").type
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array([x[0] for x in out], t), "asked": pa.array([x[1] for x in out], pa.int64()), "vec_id": pa.array([x[2] for x in out], t), "score": pa.array([x[3] for x in out], pa.float64())})

        deal = F.pmod(F.xxhash64("place"), F.lit(shards)).cast("int")
        index = rows.select("id", "v", "place", deal.alias("shard"), F.lit(False).alias("is_query"))
        sent = asked.select("id", "v", "place", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_query"))
        both = index.unionByName(sent).repartition(shards, "shard").sortWithinPartitions("shard", "is_query")
        return stored(both.mapInArrow(search, f"query_id {kind}, asked bigint, vec_id {kind}, score double"), name)

    asked = rows.filter("is_query")
    near = found = answers(asked, False, "ann-near")
    full = found.groupBy(F.col("asked").alias("place")).count().filter(F.col("count") >= p.k).select("place")
    short = asked.join(full, "place", "left_anti")
    again = answers(short, True, "ann-rest")
    found = found.join(full, F.col("asked") == F.col("place"), "left_semi").unionByName(again)
    # a query's rows: k per shard, so a group is small; its first k are its nearest
    best = found.groupBy("query_id", "asked").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id", "score"))), 1, p.k).alias("best"))
    best = stored(best, "ann-best")
    discard(all_rows, near, again)
    return best.select("query_id", F.posexplode("best").alias("pos", "b")).select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
