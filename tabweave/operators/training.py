"""Gradient training over all rows of a table: tasks sum the gradients of their blocks, the driver takes the step.

A training table is stored once: rows are dealt to blocks by a hash of their id and values, and a block (about a
thousand rows, more of a large table for local descent, in a fixed order) is one stored row. Blocks are dealt to minibatches, so that one epoch reads every row once, a
minibatch at a time; files are sorted by minibatch, and a step reads the row groups that hold its own. Every step ships the weights to
the tasks; each task sums what its blocks give, and the sums, whose size is the model's, are added in a tree.

A block's rows, their order and the noise keyed by (seed, block, step) don't depend on how the table was partitioned, and
sums are kept in whole numbers (two of 64 bits for each value), whose addition has no order. So a fit gives the same
weights for any partitioning, retry or number of executors.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.rand import generator
from tabweave.operators.fields import Adam, MLP
from tabweave.sources.readers import scratch_path

HIGH, LOW = 2.0**20, 2.0**40
#: So many partial sums at most are collected; more are added in groups first.
MOST_PARTIALS = 64


def to_whole(v: np.ndarray) -> np.ndarray:
    """v as two rows of integers: v * 2**20 rounded down, and the rest in steps of 2**-60."""
    if not np.isfinite(v).all():
        raise FloatingPointError("a sum is not finite")
    if v.size and np.abs(v).max() > 2.0**42:
        raise OverflowError("a block's sum is beyond 2**42; scale the columns")
    high = np.floor(v * HIGH)
    return np.stack([high.astype(np.int64), np.rint((v * HIGH - high) * LOW).astype(np.int64)])


def from_whole(w: np.ndarray) -> np.ndarray:
    return (w[0].astype(float) + w[1].astype(float) / LOW) / HIGH


@dataclass
class TrainingTable:
    """blocks: batch, block, part, n, x (binary rows of doubles). cols are in the order of x."""

    blocks: DataFrame
    cols: list[str]
    rows: int
    batches: int
    path: str = ""
    files: int = 0
    block_rows: int = 1024

    def __post_init__(self) -> None:
        self.files = self.files or len(self.blocks.inputFiles())

    @classmethod
    def build(cls, df: DataFrame, id_col: str, cols: list[str], batches: int = 30, least: int = 2048, block_rows: int = 1024, most_block_rows: int = 0) -> TrainingTable:
        """All rows of df in which no value is missing. An epoch has `batches` steps, fewer where a step would see less than
        `least` rows; so a minibatch grows with the table, and an epoch is one read of it in a fixed number of jobs. With
        `most_block_rows`, blocks double up to it while a minibatch keeps 64 of them."""
        names = [f"c{i}" for i in range(len(cols))]
        ready = df.select(F.col(id_col).cast("string").alias("id"), *[F.col(c).cast("double").alias(n) for c, n in zip(cols, names)]).filter(" and ".join(f"{n} is not null and not isnan({n})" for n in names))
        rows = ready.count()
        while 2 * block_rows <= most_block_rows and rows >= batches * 64 * 2 * block_rows:
            block_rows *= 2
        total = max(1, -(-rows // block_rows))
        batches = max(1, min(batches, rows // least, total))
        # the id has done its part in h: rows of one h and equal values are the same to a block, which h gives again after the shuffle
        dealt = ready.select(F.xxhash64("id", *names).alias("h"), *names).repartition(F.pmod("h", F.lit(total))).withColumn("block", F.pmod("h", F.lit(total))).withColumn("batch", F.pmod("block", F.lit(batches)))
        # the order of (batch, block, h) in one number, as a sort compares its first key in place: a block's share of 62 bits, and in it h to
        # as many bits as there are; what is equal there h and the values order
        share = 2**61 // total + 2
        place = F.col("batch") * F.lit(-(-total // batches)) + F.expr(f"block div {batches}")
        dealt = dealt.withColumn("place", place * F.lit(share) + F.expr(f"h div {8 * total}L")).sortWithinPartitions("place", "h", *names)

        def pack(batches):
            held, key, part, n = [], None, 0, 0

            def row():
                return pa.RecordBatch.from_pydict({"batch": pa.array([key[0]], pa.int64()), "block": pa.array([key[1]], pa.int64()), "part": pa.array([part], pa.int32()), "n": pa.array([n], pa.int64()), "x": pa.array([np.concatenate(held).tobytes()], pa.binary())})

            for batch in batches:
                x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], 1)
                block, of = batch.column("block").to_numpy(), batch.column("batch").to_numpy()
                edges = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
                for lo, hi in zip(edges, np.append(edges[1:], len(block))):
                    mine = (int(of[lo]), int(block[lo]))
                    if mine != key:
                        if held:
                            yield row()
                        held, key, part, n = [], mine, 0, 0
                    while lo < hi:  # equal rows share a block, which is cut at a fixed size
                        take = min(hi - lo, 4 * block_rows - n)
                        held.append(x[lo : lo + take])
                        n, lo = n + take, lo + take
                        if n == 4 * block_rows:
                            yield row()
                            held, part, n = [], part + 1, 0
            if held:
                yield row()

        path = scratch_path(df.sparkSession, "training")
        kind = "batch bigint, block bigint, part int, n bigint, x binary"
        dealt.select("batch", "block", *names).mapInArrow(pack, kind).write.option("parquet.block.size", 8 << 20).parquet(path)
        return cls(df.sparkSession.read.schema(kind).parquet(path), list(cols), rows, batches, path, block_rows=block_rows)

    def sums(self, work: Callable, seed: tuple[int, ...] = (0,), batch: int | None = None) -> list[np.ndarray]:
        """Sums over blocks of what work(x, rng) gives, a list of arrays of fixed shapes; all blocks, or one minibatch's."""
        return self.sums_of(("block", "part", "x"), _OnRows(work, seed, len(self.cols)), batch)

    def sums_of(self, columns: tuple[str, ...], work: Callable, batch: int | None = None) -> list[np.ndarray]:
        """The same of work(*columns of a stored block). A value of a block's arrays is below 2**42."""
        def run(batches):
            total, shapes = None, None
            for b in batches:
                for out in _worked(work, zip(*(b.column(c).to_pylist() for c in columns))):
                    out = [np.asarray(a, float) for a in out]
                    shapes = [tuple(int(k) for k in a.shape) for a in out]
                    whole = to_whole(np.concatenate([a.ravel() for a in out]))
                    total = whole if total is None else total + whole
            if total is not None:
                yield pa.RecordBatch.from_pydict({"sums": pa.array([total.tobytes()], pa.binary()), "shapes": [json.dumps(shapes)]})

        def added(t: pa.Table) -> pa.Table:
            whole = sum(np.frombuffer(b, np.int64) for b in t.column("sums").to_pylist())
            return pa.table({"sums": pa.array([whole.tobytes()], pa.binary()), "shapes": t.column("shapes").slice(0, 1)})

        kind = "sums binary, shapes string"
        mine = self.blocks if batch is None else self.blocks.filter(F.col("batch") == batch)
        parts = mine.select(*columns).mapInArrow(run, kind)
        if self.files > MOST_PARTIALS:
            parts = parts.withColumn("g", F.pmod(F.spark_partition_id(), F.lit(MOST_PARTIALS))).groupBy("g").applyInArrow(lambda t: added(t.drop(["g"])), kind)
        rows = parts.collect()
        if not rows:
            return []
        total = from_whole(sum(np.frombuffer(bytes(r["sums"]), np.int64) for r in rows).reshape(2, -1))
        out, at = [], 0
        for shape in json.loads(rows[0]["shapes"]):
            size = int(np.prod(shape))
            out.append(total[at : at + size].reshape(shape))
            at += size
        return out

    def scale(self) -> tuple[np.ndarray, np.ndarray]:
        """Mean and standard deviation of each column (of one if it is constant)."""
        if not self.rows:
            return np.zeros(len(self.cols)), np.ones(len(self.cols))
        top = self.blocks.select("x").mapInArrow(_largest(len(self.cols)), "top array<double>").agg(*[F.max(F.col("top")[j]) for j in range(len(self.cols))]).collect()[0]
        unit = np.array([2.0 ** np.ceil(np.log2(t)) if t > 0 else 1.0 for t in top])
        s, q = self.sums(_Powers(unit))
        mean = s / self.rows
        q = self.sums(_Powers(unit, mean))[1]
        std = np.sqrt(np.maximum(q / self.rows, 0))
        return mean * unit, np.where(std > 0, std, 1 / unit) * unit

    def drop(self) -> None:
        """Removes the stored blocks."""
        spark = self.blocks.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def _worked(work: Callable, rows: Iterable):
    """What work gives for each row: one at a time, or, where it has many(rows), several side by side."""
    if getattr(work, "together", 1) == 1:
        yield from (work(*r) for r in rows)
        return
    rows = iter(rows)
    while some := list(islice(rows, work.together)):
        yield from work.many(some)


@dataclass
class _OnRows:
    work: Callable
    seed: tuple[int, ...]
    width: int

    def made(self, block: int, part: int, x: bytes) -> tuple[np.ndarray, np.random.Generator]:
        return np.frombuffer(x).reshape(-1, self.width), generator(*self.seed, block, part)

    def __call__(self, *stored) -> list[np.ndarray]:
        return self.work(*self.made(*stored))

    @property
    def together(self) -> int:
        return getattr(self.work, "together", 1)

    def many(self, stored: list) -> list[list[np.ndarray]]:
        return self.work.many([self.made(*s) for s in stored])


def _largest(d: int):
    def run(batches):
        for b in batches:
            for raw in b.column("x").to_pylist():
                yield pa.RecordBatch.from_pydict({"top": pa.array([np.abs(np.frombuffer(raw).reshape(-1, d)).max(0).tolist()], pa.list_(pa.float64()))})

    return run


@dataclass
class _Powers:
    unit: np.ndarray
    mean: np.ndarray | float = 0.0

    def __call__(self, x: np.ndarray, rng) -> list[np.ndarray]:
        z = x / self.unit - self.mean
        return [z.sum(0), (z * z).sum(0)]


@dataclass
class Step:
    """What a task does in a step: the gradient sums of a block under the weights shipped with it."""

    gradients: Callable
    params: list[np.ndarray]

    def __call__(self, x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        loss, grads = self.gradients(self.params, x, rng)
        return [np.array([len(x), loss]), *grads]

    @property
    def together(self) -> int:
        return getattr(self.gradients, "together", 1)

    def many(self, blocks: list) -> list[list[np.ndarray]]:
        return [[np.array([len(x), loss]), *grads] for (x, _), (loss, grads) in zip(blocks, self.gradients.many(self.params, blocks))]


def train(table: TrainingTable, params: list[np.ndarray], gradients: Callable, epochs: int, rate: float = 2e-3, decay: float = 0.0, clip: float | None = 1.0, seed: int = 0, anneal: bool = False, average: float | None = None, betas: tuple[float, float] = (0.9, 0.999)) -> list[float]:
    """Changes params in place; the mean loss of each epoch is returned. gradients(params, x, rng) gives the sums of the loss and
    of its gradients over the rows of x."""
    adam = Adam(params, rate, decay, np.inf if clip is None else clip, betas)
    mean = [p.copy() for p in params] if average else []
    losses, steps = [], epochs * table.batches
    for epoch in range(epochs):
        seen, loss = 0.0, 0.0
        for k, batch in enumerate(generator(seed, epoch).permutation(table.batches)):
            out = table.sums(Step(gradients, params), (seed, epoch), int(batch) if table.batches > 1 else None)
            if not out:
                continue
            (n, total), grads = out[0], out[1:]
            seen, loss = seen + n, loss + total
            adam.step([g / n for g in grads], 1 - (epoch * table.batches + k) / steps if anneal else 1.0)
            for m, p in zip(mean, params):
                m += (1 - min(average, adam.steps / (9 + adam.steps))) * (p - m)
        losses.append(loss / max(seen, 1))
    for m, p in zip(mean, params):
        p[:] = m
    return losses


@dataclass
class LocalDescent:
    """A block's work in a round: AdamW steps of `small` rows from the shared weights; what the weights moved by is the block's part of the
    round. make(rows, rng, progress) gives (inputs, extra), gradient(out, extra) d loss / d out. Steps are taken in single precision, on
    one array that holds all weights."""

    kind: type
    params: list[np.ndarray]
    make: Callable
    gradient: Callable
    rate: float
    small: int
    progress: float

    def __call__(self, x: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
        flat = np.concatenate([p.ravel() for p in self.params]).astype(np.float32)
        ends = np.cumsum([p.size for p in self.params])
        own = [flat[end - p.size : end].reshape(p.shape) for p, end in zip(self.params, ends)]
        start, x = flat.copy(), x[rng.permutation(len(x))]
        adam, net = Adam([flat], self.rate), self.kind.of(own)
        inputs, extra = self.make(x, rng, self.progress)
        inputs = inputs.astype(np.float32)
        for at in (slice(lo, lo + self.small) for lo in range(0, len(x), self.small)):
            out, kept = net.forward(inputs[at])
            some = tuple(e[at] for e in extra) if isinstance(extra, tuple) else extra[at]
            grads = net.backward(kept, self.gradient(out, some).astype(np.float32))
            adam.step([np.concatenate([g.ravel() for g in grads])])
        moved = (flat - start).astype(float) * len(x)
        return [np.array([len(x)], float), *(moved[end - p.size : end].reshape(p.shape) for p, end in zip(self.params, ends))]


def descend(df: DataFrame, id_col: str, cols: list[str], net: MLP, make: Callable, gradient: Callable, steps: int, rate: float = 2e-3, small: int = 64, batches: int = 30, seed: int = 0, average: float | None = None, anneal: bool = False) -> int:
    """Trains a network over all rows of df by rounds of local descent, for at least `steps` steps in a row and whole epochs; a round
    is one job over a minibatch, and moves the weights by the mean over its rows. Of large tables blocks and the rows of a step grow
    alike, up to four times, so that a row costs less and a block takes as many steps. Returns the rows read in an epoch."""
    table = TrainingTable.build(df, id_col, cols, batches, most_block_rows=4096)
    params = net.params()
    mean = [p.copy() for p in params] if average else []
    small *= table.block_rows // 1024
    local = max(1, min(table.block_rows, max(table.rows, 1)) // small)
    epochs = -(-steps // (local * table.batches)) if table.rows else 0
    rounds = epochs * table.batches
    for epoch in range(epochs):
        for k, batch in enumerate(generator(seed, epoch).permutation(table.batches)):
            done = (epoch * table.batches + k) / rounds
            work = LocalDescent(type(net), params, make, gradient, rate * (1 - done if anneal else 1.0), small, done)
            out = table.sums(work, (seed, epoch), int(batch) if table.batches > 1 else None)
            for p, moved in zip(params, out[1:]):
                p += moved / out[0][0]
            for m, p in zip(mean, params):  # the decay is by step
                m += (1 - min(average**local, (epoch * table.batches + k + 1) / (10 / local + epoch * table.batches + k + 1))) * (p - m)
    for m, p in zip(mean, params):
        p[:] = m
    table.drop()
    return table.rows


@dataclass
class Regression:
    """Squared error of an MLP whose last columns of x are the targets; inputs and targets are standardised here."""

    inputs: int
    scale: tuple[np.ndarray, np.ndarray]

    def __call__(self, params: list[np.ndarray], x: np.ndarray, rng) -> tuple[float, list[np.ndarray]]:
        z = (x - self.scale[0]) / self.scale[1]
        net = MLP.of(params)
        out, kept = net.forward(z[:, : self.inputs])
        off = out - z[:, self.inputs :]
        return float((off * off).mean(1).sum()), net.backward(kept, 2 * off / off.shape[1])


@dataclass
class WholeMLP:
    """An MLP regressor of y_cols on x_cols fitted over all rows of a table."""

    hidden: tuple[int, ...] = (64, 64)
    epochs: int = 4
    batches: int = 30
    rate: float = 5e-3
    decay: float = 1e-4
    seed: int = 0
    net: MLP | None = None
    scale: tuple | None = None
    losses: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, id_col: str, x_cols: list[str], y_cols: list[str]) -> WholeMLP:
        table = TrainingTable.build(df, id_col, [*x_cols, *y_cols], self.batches)
        mean, std = table.scale()
        self.net = MLP([len(x_cols), *self.hidden, len(y_cols)], self.seed)
        self.losses = train(table, self.net.params(), Regression(len(x_cols), (mean, std)), self.epochs, self.rate, self.decay, seed=self.seed, anneal=True)
        k = len(x_cols)
        self.scale = (mean[:k], std[:k], mean[k:], std[k:])
        table.drop()
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.net.forward((x - self.scale[0]) / self.scale[1])[0] * self.scale[3] + self.scale[2]
