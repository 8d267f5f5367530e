"""Fits of bridge solvers whose training rows are made in the tasks and never stored.

A solver's training rows (a row of the table at every step of a path) are a function of a stored row: all noise is keyed by the row's
52-bit key. So what is stored is the table itself, with the walked side of its coupling beside it, and each job makes the training
rows it needs, a batch at a time.

Trees see a row by its bins alone, and so do their residuals: rows of equal bins can be added up. A fit is two reads of the table, one for
the cuts and one for the sums of each cell of bins, and the trees are grown from the cells, whose number the bins bound. They are
the trees that the rows themselves would give. Cuts are quantiles of all rows on a grid of 256 steps an octave. Networks learn by
rounds of local descent over blocks of rows. Sums are of whole numbers, so no fit depends on how rows are partitioned.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabweave.functions.rand import generator
from tabweave.operators.boosting import STEPS, WholeTrees
from tabweave.operators.fields import MLP
from tabweave.operators.stages import GroupNet, LocalSteps, matrix
from tabweave.operators.training import Step, TrainingTable
from tabweave.sources.readers import scratch_path

#: So many sums of cells at most are held by a task; where bins make more, training rows are stored instead.
MOST_SUMS = 1 << 23
#: Targets are added up in such parts of the table's unit, as whole numbers.
PARTS = 2.0**24
OCTAVES, FINE = 32, 256
GRID = 2 * OCTAVES * FINE + 1

#: (key, a, w) of rows and a model's place -> (group, inputs, targets) of the training rows they make.
Rows = Callable[[np.ndarray, np.ndarray, np.ndarray | None, int], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def key_of(id_col: str) -> Column:
    """52 bits of a hash of the id: whole as a double."""
    return F.shiftrightunsigned(F.xxhash64(id_col), 12).cast("double")


def on_grid(x: np.ndarray) -> np.ndarray:
    """Places on a grid of FINE steps an octave from 2**-20 to 2**12, either sign; the middle one is for all that is smaller."""
    size = np.abs(x)
    m, e = np.frexp(size)
    step = (e + 19) * FINE + ((m - 0.5) * 2 * FINE).astype(np.int64) + 1
    return np.where(x < 0, -1, 1) * np.where(size < 2.0**-20, 0, np.minimum(step, OCTAVES * FINE)) + OCTAVES * FINE


def grid_value(place: np.ndarray) -> np.ndarray:
    """The least number of a place above the middle; below it, the least of the next place's mirror image."""
    step = np.abs(place - OCTAVES * FINE)
    low = np.where(place < OCTAVES * FINE, step, step - 1)  # the far edge of a negative place is its least number
    edge = np.ldexp(1 + (low % FINE) / FINE, low // FINE - 20)
    return np.where(place == OCTAVES * FINE, -np.ldexp(1.0, -20), np.where(place < OCTAVES * FINE, -edge, edge))


def _batches(batches, d: int):
    for b in batches:
        if b.num_rows:
            walked = matrix(b, [f"w{j}" for j in range(d)]) if "w0" in b.schema.names else None
            yield b.column("key").to_numpy(zero_copy_only=False), matrix(b, [f"a{j}" for j in range(d)]), walked


@dataclass
class _Found:
    """What one read finds of a field's rows: their number, sums and largest size of targets, and places of inputs on the grid."""

    features: int
    outputs: int

    def __post_init__(self):
        self.counts = np.zeros((self.features, GRID), np.int64)
        self.sums, self.top = np.zeros(self.outputs, np.int64), np.zeros(self.outputs)

    def add(self, x: np.ndarray, y: np.ndarray, unit: float) -> None:
        for j in range(self.features):
            self.counts[j] += np.bincount(on_grid(x[:, j] / unit), minlength=GRID)
        self.sums += np.rint(y / unit * PARTS).astype(np.int64).sum(0)
        self.top = np.maximum(self.top, np.abs(y / unit).max(0, initial=0))

    def packed(self) -> bytes:
        return np.concatenate([self.counts.ravel(), self.sums, self.top.view(np.int64)]).tobytes()


class _Cells:
    """Rows of each cell, and sums of their whole-number targets. Rows are kept back until there are many, as adding them reads every cell."""

    def __init__(self, cells: int, outputs: int):
        self.sums, self.most = np.zeros((1 + outputs, cells), np.int64), min(cells, 1 << 18)
        self.waiting, self.rows = [], 0

    def add(self, place: np.ndarray, res: np.ndarray) -> None:
        self.waiting.append((place, res))
        self.rows += len(place)
        if self.rows >= self.most:
            self.all()

    def all(self) -> np.ndarray:
        if self.rows:
            place, res = np.concatenate([p for p, _ in self.waiting]), np.concatenate([r for _, r in self.waiting])
            self.sums[0] += np.bincount(place, minlength=self.sums.shape[1])
            for o in range(res.shape[1]):  # whole numbers, whose sums are below 2**53
                self.sums[1 + o] += np.bincount(place, weights=res[:, o], minlength=self.sums.shape[1]).astype(np.int64)
            self.waiting, self.rows = [], 0
        return self.sums


def _added(parts: list[bytes], outputs: int) -> bytes:
    rows = np.stack([np.frombuffer(p, np.int64) for p in parts])
    return np.concatenate([rows[:, :-outputs].sum(0), rows[:, -outputs:].view(float).max(0).view(np.int64)]).tobytes()


def cells_fit(shapes: list[tuple[int, int]], groups: list[int], params: dict) -> bool:
    return len(groups) * sum(WholeTrees(**params).bins ** f * (1 + o) for f, o in shapes) <= MOST_SUMS


def tabulated(fields: dict, seen: int) -> None:
    """Trees answer from a table of all their cells once so many rows have been asked for that it pays: a cell costs an addition a tree,
    a row a walk down each."""
    for own in fields.values():
        if isinstance(own, WholeTrees) and own.answers is None and own.cells() <= min(64 * seen, MOST_SUMS):
            own.tabulate()


def fit_trees(table: DataFrame, d: int, shapes: list[tuple[int, int]], groups: list[int], rows: Rows, params: dict, unit: float) -> dict:
    """{(model, group): WholeTrees} from a stored table of key, a0.., w0... shapes: inputs and outputs of each model."""
    spark, n = table.sparkSession, len(groups)
    at = {g: k for k, g in enumerate(groups)}
    outputs = {m * n + k: s[1] for m, s in enumerate(shapes) for k in range(n)}
    shared = spark.sparkContext.broadcast(rows)

    def look(batches):
        found: dict[int, _Found] = {}
        for key, a, w in _batches(batches, d):
            for m, shape in enumerate(shapes):
                for g, x, y in shared.value(key, a, w, m):
                    found.setdefault(m * n + at[g], _Found(*shape)).add(x, y, unit)
        # few partial sums meet in one task
        part = TaskContext.get().partitionId() % 16
        for q, own in found.items():
            yield pa.RecordBatch.from_pydict({"q": pa.array([q], pa.int32()), "part": pa.array([part], pa.int32()), "sums": pa.array([own.packed()], pa.binary())})

    def total(t: pa.Table) -> pa.Table:
        q = t.column("q")[0].as_py()
        return pa.table({"q": pa.array([q], pa.int32()), "part": pa.array([0], pa.int32()), "sums": pa.array([_added(t.column("sums").to_pylist(), outputs[q])], pa.binary())})

    kind, fields = "q int, part int, sums binary", {}
    for r in table.mapInArrow(look, kind).groupBy("q", "part").applyInArrow(total, kind).groupBy("q").applyInArrow(total, kind).toLocalIterator():
        v, (features, outs) = np.frombuffer(bytes(r["sums"]), np.int64), shapes[r["q"] // n]
        counts = v[: features * GRID].reshape(features, GRID)
        own = WholeTrees(**params)
        ranks = np.floor(np.linspace(0, 1, own.bins)[1:-1] * (counts[0].sum() - 1))
        own.cuts = [np.unique(grid_value(np.searchsorted(np.cumsum(c), ranks, side="right"))) * unit for c in counts]
        own.base = v[features * GRID : -outs] / (PARTS * counts[0].sum()) * unit
        far = v[-outs:].view(float) * unit + np.abs(own.base)
        own.unit = np.array([2.0 ** np.ceil(np.log2(t)) if t > 0 else 1.0 for t in far])
        fields[r["q"]] = own
    missing = [q for q in outputs if q not in fields]
    if missing:
        raise ValueError(f"no rows to learn from: {missing}")
    most = max(outputs.values())
    known = spark.sparkContext.broadcast(fields)

    def add_up(batches):
        held: dict[int, _Cells] = {}
        for key, a, w in _batches(batches, d):
            for m, (features, outs) in enumerate(shapes):
                for g, x, y in shared.value(key, a, w, m):
                    q = m * n + at[g]
                    own = known.value[q]
                    place = np.ravel_multi_index(tuple(own._codes(x).T), (own.bins,) * features)
                    res = np.rint((y - own.base) / own.unit * STEPS)
                    if q not in held:
                        held[q] = _Cells(own.bins**features, outs)
                    held[q].add(place, res)
        for q, cells in ((q, c.all()) for q, c in held.items()):
            used = np.flatnonzero(cells[0])
            for lo in range(0, len(used), 10_000):
                part = used[lo : lo + 10_000]
                yield pa.RecordBatch.from_pydict({"q": pa.array(np.full(len(part), q, np.int32)), "cell": pa.array(part, pa.int64()), "n": pa.array(cells[0, part]), **{f"s{o}": pa.array(cells[1 + o, part] if 1 + o < len(cells) else np.zeros(len(part), np.int64)) for o in range(most)}})

    sums = [f"s{o}" for o in range(most)]
    cells = table.mapInArrow(add_up, "q int, cell bigint, n bigint, " + ", ".join(f"{s} bigint" for s in sums)).groupBy("q", "cell").agg(*[F.sum(c).alias(c) for c in ("n", *sums)])

    def grow(t: pa.Table) -> pa.Table:
        q = t.column("q")[0].as_py()
        own, (features, outs) = known.value[q], shapes[q // n]
        t = t.sort_by("cell")
        codes = np.stack(np.unravel_index(t.column("cell").to_numpy(), (own.bins,) * features), 1).astype(np.uint8)
        own.fit_cells(codes, t.column("n").to_numpy(), np.stack([t.column(s).to_numpy() for s in sums[:outs]], 1))
        return pa.table({"q": pa.array([q], pa.int32()), "model": pa.array([pickle.dumps(own.model)], pa.binary())})

    for r in cells.groupBy("q").applyInArrow(grow, "q int, model binary").collect():
        fields[r["q"]].model = pickle.loads(bytes(r["model"]))
    return {(m, g): fields[m * n + k] for m in range(len(shapes)) for k, g in enumerate(groups)}


@dataclass
class _OnBlocks:
    """work(training rows of a block, rng); the first column is a group's place."""

    rows: Rows
    model: int
    groups: list[int]
    d: int
    seed: tuple[int, ...]
    work: Callable

    def made(self, block: int, part: int, x: bytes, w: bytes | None = None) -> tuple[np.ndarray, np.random.Generator]:
        z = np.frombuffer(x).reshape(-1, 1 + self.d)
        walked = None if w is None else np.frombuffer(w, np.float32).reshape(-1, self.d).astype(float)
        made = [np.column_stack([np.full(len(a), self.groups.index(g), float), a, b]) for g, a, b in self.rows(z[:, 0], z[:, 1:], walked, self.model)]
        return np.concatenate(made), generator(*self.seed, block, part)

    def __call__(self, *stored) -> list[np.ndarray]:
        return self.work(*self.made(*stored))

    @property
    def together(self) -> int:
        return getattr(self.work, "together", 1)

    def many(self, stored: list) -> list[list[np.ndarray]]:
        return self.work.many([self.made(*s) for s in stored])


@dataclass
class _Moments:
    groups: int
    unit: float

    def __call__(self, x: np.ndarray, rng) -> list[np.ndarray]:
        out = np.zeros((3, self.groups, x.shape[1] - 1))
        for g in np.unique(x[:, 0]).astype(int):
            z = x[slice(None) if self.groups == 1 else x[:, 0] == g, 1:] / self.unit
            out[0, g], out[1, g], out[2, g] = len(z), z.sum(0), np.einsum("ij,ij->j", z, z)
        return [out]


def small_steps(rows: int) -> int:
    """Rows a step of local descent: more where a field has so many rows that it takes enough steps anyway."""
    return 16 * min(4, max(1, rows // 4_000_000))


def blocks_of(data: DataFrame, cols: list[str], per: int, groups: int, batches: int) -> TrainingTable:
    """The table that networks learn from: key, a0..., in blocks that make about 4,096 training rows, `per` of each row."""
    small = small_steps(data.count() * per // groups)
    return TrainingTable.build(data, "key", ["key", *cols], batches, least=max(1, 4096 // per), block_rows=max(1, 256 * small // per))


def walked_blocks(table: TrainingTable, walk: Callable[[np.ndarray, np.ndarray], np.ndarray], d: int) -> TrainingTable:
    """The table with w, what walk(key, a) gives, in single precision."""
    names = ("batch", "block", "part", "n", "x")

    def run(batches):
        for b in batches:
            for i, raw in enumerate(b.column("x").to_pylist()):
                z = np.frombuffer(raw).reshape(-1, 1 + d)
                w = walk(z[:, 0], z[:, 1:]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([*[b.column(c).slice(i, 1) for c in names], pa.array([w.tobytes()], pa.binary())], [*names, "w"])

    spark = table.blocks.sparkSession
    path, kind = scratch_path(spark, "walked"), "batch bigint, block bigint, part int, n bigint, x binary, w binary"
    table.blocks.select(*names).mapInArrow(run, kind).write.option("parquet.block.size", 8 << 20).parquet(path)
    return TrainingTable(spark.read.schema(kind).parquet(path), table.cols, table.rows, table.batches, path)


def fit_networks(table: TrainingTable, d: int, shapes: list[tuple[int, int]], groups: list[int], rows: Rows, params: dict, unit: float, per: int) -> dict:
    """{(model, group): GroupNet} by rounds of local descent; each round moves every group's weights."""
    p = {"hidden": (64, 64), "epochs": 2, "batches": 10, "rate": 0.1, "seed": 0} | params
    n, found, columns = len(groups), {}, ("block", "part", "x", "w") if "w" in table.blocks.columns else ("block", "part", "x")
    small = small_steps(table.rows * per // n)
    for m, (inputs, outputs) in enumerate(shapes):
        over = lambda work, seed=(0,), batch=None, m=m: table.sums_of(columns, _OnBlocks(rows, m, groups, d, seed, work), batch)
        got = over(_Moments(n, unit))
        if not got:
            raise ValueError("no rows to learn from")
        count, s, q = got[0]
        mean = s / np.maximum(count, 1)
        std = np.sqrt(np.maximum(q / np.maximum(count, 1) - mean**2, 0)) * unit + 1e-6
        mean = mean * unit
        nets = [MLP([inputs, *p["hidden"], outputs], p["seed"]) for _ in groups]
        weights = [w for net in nets for w in net.params()]
        share = np.maximum(count[:, 0], 1) / max(count[:, 0].sum(), 1)
        for epoch in range(p["epochs"]):
            for k, batch in enumerate(generator(p["seed"], epoch).permutation(table.batches)):
                left = 1 - (epoch * table.batches + k) / (p["epochs"] * table.batches)
                step = Step(LocalSteps(n, inputs, mean, std, share, p["rate"] * left, small, True), weights)
                out = over(step, (p["seed"], epoch), int(batch) if table.batches > 1 else None)
                if not out:
                    continue
                for w, moved in zip(weights, out[1:]):
                    w -= moved / out[0][0]
        found |= {(m, g): GroupNet(net, mean[k], std[k], inputs) for k, (g, net) in enumerate(zip(groups, nets))}
    return found

