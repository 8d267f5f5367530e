"""Bridge solvers: fit(df) learns fields, sample(n, seed) makes rows by integrating them in Spark tasks.

The bridge solvers and the light one learn from all rows. Trees and networks store the coupling alone and make training rows in the
tasks that learn from them (bridge_fits); linear fields, and trees of more bins than a task can hold, store each stage. Fits that
don't depend on each other (steps, features) share a job. The categorical solver still learns from a bounded sample
of rows (chosen by a hash of the id). Sampling is map-only: noise is keyed by (seed, row), so it doesn't depend on how
rows are partitioned, and a table of any size can be generated.
"""

from __future__ import annotations

import math
from abc import ABC, abstractmethod
from dataclasses import dataclass, field, replace
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions.rand import generator, hashed_normals, hashed_uniforms, normal, uniform
from tabweave.operators import metrics
from tabweave.operators.bridge_fits import blocks_of, cells_fit, fit_networks, fit_trees, key_of, tabulated, walked_blocks
from tabweave.operators.fields import MLP, bounded_matrix, minibatches, time_features
from tabweave.operators.process import CategoricalReference, TimeGrid, bridge_point, bridge_target
from tabweave.operators.stages import dropped, fit_groups, matrix, spread, stored
from tabweave.operators.training import TrainingTable, train

NOISE_BLOCK = 256
SAMPLE_BLOCK = 4 * NOISE_BLOCK


class Solver(ABC):
    """fit() and sample(); cols are the modelled numeric columns, in order."""

    cols: list[str]

    @abstractmethod
    def fit(self, df: DataFrame, id_col: str) -> Solver: ...

    @abstractmethod
    def generate(self, ids: np.ndarray, seed: int) -> np.ndarray:
        """Rows for the given row ids; a row depends on (seed, its id) alone."""

    def sample(self, spark: SparkSession, n: int, seed: int) -> DataFrame:
        """n rows, numbered from 0. Tasks make whole blocks of rows: the last bits of a matrix product depend on how many
        rows it has, so a row would otherwise differ with the partition it is made in."""
        shared = spark.sparkContext.broadcast(self)
        names = self.cols

        def run(batches):
            own = shared.value
            for batch in batches:
                for b in batch.column("id").to_pylist():
                    ids = np.arange(b * SAMPLE_BLOCK, (b + 1) * SAMPLE_BLOCK)
                    x = own.generate(ids, seed)[: n - b * SAMPLE_BLOCK]
                    yield pa.RecordBatch.from_pydict({"row_id": pa.array(ids[: len(x)], pa.int64())} | {c: pa.array(x[:, j].astype(float)) for j, c in enumerate(names)})

        schema = "row_id bigint, " + ", ".join(f"`{c}` double" for c in names)
        return spark.range(-(-n // SAMPLE_BLOCK)).mapInArrow(run, schema)


def keyed_normals(ids: np.ndarray, seed: int, shape: tuple[int, ...]) -> np.ndarray:
    """Standard normals of the given shape per row, the same for a row in any batch (made in blocks of ids)."""
    out = np.empty((len(ids), *shape))
    block = ids // NOISE_BLOCK
    for b in np.unique(block):
        own = block == b
        out[own] = generator(seed, int(b)).normal(size=(NOISE_BLOCK, *shape))[ids[own] % NOISE_BLOCK]
    return out


#: Tags of noise; what salts and places of columns are added to.
PRIOR, TIMES, BRIDGES, PARENTS = 900_001, 1_000_000, 2_000_000, 3_000_000


def _unstored(kind: str, plan: list, time: str, steps: int, params: dict) -> bool:
    """Whether training rows can be made where they are learned from: networks, and trees whose cells of bins a task can hold."""
    extra = 0 if time == "discrete" else 1
    return kind == "mlp" or kind == "trees" and cells_fit([(len(o) + len(c) + extra, len(o)) for o, c in plan], list(range(1 if extra else steps)), params)


def _keyed(df: DataFrame, id_col: str, cols: list[str]) -> tuple[DataFrame, float]:
    """The rows stored as key, a0..., and a power of two near their largest value."""
    data = df.select(F.col(id_col).cast("string").alias("id"), *[F.col(c).cast("double").alias(f"a{j}") for j, c in enumerate(cols)]).dropna()
    data = data.select(key_of("id").alias("key"), *[f"a{j}" for j in range(len(cols))])
    if data.rdd.getNumPartitions() < data.sparkSession.sparkContext.defaultParallelism:
        data = spread(data, "key")
    table = stored(data, "bridge-data")
    top = table.agg(*[F.max(F.abs(f"a{j}")) for j in range(len(cols))]).collect()[0]
    return table, 2.0 ** np.ceil(np.log2(max(1.0, *[t or 0.0 for t in top])))


def _walked_rows(table: DataFrame, walk: ImfWalk, d: int) -> DataFrame:
    """The table with w0..., what the walk gives, in single precision."""
    names = ["key", *[f"a{j}" for j in range(d)]]

    def run(batches):
        for b in batches:
            w = walk(b.column("key").to_numpy(), matrix(b, names[1:])).astype(np.float32)
            yield pa.RecordBatch.from_pydict({**{c: b.column(c) for c in names}, **{f"w{j}": pa.array(w[:, j]) for j in range(d)}})

    return table.select(*names).mapInArrow(run, ", ".join([*(f"{c} double" for c in names), *(f"w{j} float" for j in range(d))]))


@dataclass
class ImfWalk:
    """The other side of rows, by integrating the fields of a direction from the side that is given."""

    solver: ImfSolver
    fields: dict
    direction: str
    salt: int
    seen: int = 0

    def __call__(self, key: np.ndarray, a: np.ndarray) -> np.ndarray:
        own, d = self.solver, a.shape[1]
        self.seen += len(a) * own.steps
        tabulated(self.fields, self.seen)
        start = a if self.direction == "f" else hashed_normals(key, own.seed, PRIOR, (d,))
        return own._simulate(self.fields, self.direction, start, hashed_normals(key, own.seed, self.salt, (own.steps - 1, d)))


@dataclass
class ImfRows:
    """Bridge points and targets of every coupled pair, `tuples_per_row` at each step, or at as many drawn times."""

    solver: ImfSolver
    direction: str
    salt: int
    last: str | None

    def __call__(self, key: np.ndarray, a: np.ndarray, w: np.ndarray | None, m: int):
        own, ahead = self.solver, self.direction == "f"
        start, end = own._pairs(self.last, key, a, w)
        (out, ctx), discrete = own._plan()[m], own.time == "discrete"
        reps, steps, n = own.tuples_per_row, own.steps if discrete else 1, len(key)
        noise = np.stack([hashed_normals(key, own.seed, BRIDGES + 1000 * self.salt + j, (reps, steps)) for j in out], 3)
        drawn = None if discrete else 1e-3 + (1 - 2e-3) * hashed_uniforms(key, own.seed, TIMES + 1000 * self.salt + m, reps)
        known = (end if ahead else start)[:, ctx]
        for r in range(reps):
            for k in range(steps):
                t = np.full(n, own.times()[k]) if discrete else drawn[:, r]
                # near the ends the noise term is unbounded; its weight there is that of one step
                some = (1 - t if ahead else t) > 1 / (4 * own.steps)
                t, e, p, q = t[some, None], noise[some, r, k], start[some][:, out], end[some][:, out]
                x = (1 - t) * p + t * q + own.sigma * np.sqrt(t * (1 - t)) * e
                y = q - p - own.sigma * np.sqrt(t / (1 - t)) * e if ahead else p - q - own.sigma * np.sqrt((1 - t) / t) * e
                yield k, np.concatenate([x, known[some], *own._inputs(t)], 1), y


@dataclass
class ImfSolver(Solver):
    """Iterative Markovian fitting. time: 'continuous' (one field on [x, t]) or 'discrete' (a field per step);
    structure: 'joint' or 'featurewise' (a field per feature, with the features before it as context)."""

    cols: list[str]
    kind: str = "trees"
    time: str = "continuous"
    structure: str = "joint"
    steps: int = 12
    sigma: float = 1.0
    sequence: tuple[str, ...] = ("b", "f", "b")
    first: str = "ind"
    order: tuple[str, ...] | None = None
    context: dict[str, list[str]] | None = None
    tuples_per_row: int = 1
    seed: int = 0
    noise: bool = True
    params: dict = field(default_factory=dict)
    fields: dict = field(default_factory=dict)

    def __post_init__(self) -> None:
        if self.kind == "linear" and self.time != "discrete":
            raise ValueError("linear fields are of discrete time")
        if self.structure == "featurewise":
            order = list(self.order or self.cols)
            if sorted(order) != sorted(self.cols):
                raise ValueError("the order is no permutation of the columns")
            for c, parents in (self.context or {}).items():
                late = [p for p in parents if order.index(p) >= order.index(c)]
                if late:
                    raise ValueError(f"context of {c} comes after it: {late}")

    def _plan(self) -> list[tuple[list[int], list[int]]]:
        """(outputs, context) column places of each model, in the order of generation."""
        d = len(self.cols)
        if self.structure == "joint":
            return [(list(range(d)), [])]
        order = [self.cols.index(c) for c in (self.order or self.cols)]
        if self.context is None:
            return [([j], order[:i]) for i, j in enumerate(order)]
        return [([j], [self.cols.index(p) for p in self.context.get(self.cols[j], [])]) for j in order]

    def times(self) -> np.ndarray:
        return np.clip((np.arange(self.steps) + 0.5) / self.steps, 1e-3, 1 - 1e-3)

    def _tag(self, what: str) -> str:
        return f"imf{self.seed}:{what}"

    def _inputs(self, t: np.ndarray) -> list[np.ndarray]:
        """What a field over continuous time sees of it."""
        return [] if self.time == "discrete" else [t, time_features(t, 8)] if self.kind == "mlp" else [t]

    def training_rows(self, coupling: DataFrame, direction: str, salt: int, m: int) -> DataFrame:
        """The rows that model m learns from: bridge points and targets of every coupled pair, `tuples_per_row` at each step (or at
        as many drawn times)."""
        out, ctx = self._plan()[m]
        key, last = F.col("id"), len(self.times()) if self.time == "discrete" else 1
        draws = coupling.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(self.tuples_per_row - 1)))).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(last - 1))))
        ids = (key, F.col("g"), F.col("rep"))
        if self.time == "discrete":
            t = F.element_at(F.array(*[F.lit(float(x)) for x in self.times()]), F.col("g") + 1)
        else:
            t = F.lit(1e-3) + F.lit(1 - 2e-3) * uniform(self._tag(f"t{salt}:{m}"), *ids)
        rows = draws.withColumn("t", t)
        # near the ends the noise term is unbounded; its weight there is that of one step
        rows = rows.filter((1 - F.col("t") if direction == "f" else F.col("t")) > 1 / (4 * self.steps))
        sides, at = {}, F.col("t")
        for i, j in enumerate(out):
            e = normal(self._tag(f"e{salt}:{j}"), *ids)
            sides |= {f"x{i}": bridge_point(F.col(f"a{j}"), F.col(f"b{j}"), at, self.sigma, e), f"y{i}": bridge_target(F.col(f"a{j}"), F.col(f"b{j}"), at, self.sigma, e, direction)}
        known = {f"x{len(out) + i}": F.col(f"{'b' if direction == 'f' else 'a'}{j}") for i, j in enumerate(ctx)}
        times = {}
        if self.time == "continuous":
            n = len(out) + len(ctx)
            half = [float(np.exp(-np.log(10_000.0) * i / 4)) * 1000 for i in range(4)] if self.kind == "mlp" else []
            times = {f"x{n}": at} | {f"x{n + 1 + i}": F.cos(at * f) for i, f in enumerate(half)} | {f"x{n + 5 + i}": F.sin(at * f) for i, f in enumerate(half)}
        return rows.select("g", F.concat_ws("|", *ids).alias("id"), *[c.alias(n) for n, c in {**sides, **known, **times}.items()])

    def _train(self, coupling: DataFrame, direction: str, salt: int) -> dict:
        groups, found = list(range(self.steps)) if self.time == "discrete" else [0], {}
        for m in range(len(self._plan())):
            rows = stored(self.training_rows(coupling, direction, salt, m), "imf-rows")
            for g, own in fit_groups(rows, groups, self.kind, self.params).items():
                found[m, g if self.time == "discrete" else None] = own
            dropped(rows)
        return found

    def _simulate(self, fields: dict, direction: str, start: np.ndarray, noise: np.ndarray | None) -> np.ndarray:
        """The other end from `start`; noise: (rows, steps, columns)."""
        out_x, dt, times = start.copy(), 1 / self.steps, self.times()
        for m, (out, ctx) in enumerate(self._plan()):
            x = start[:, out]
            for i in range(self.steps):
                k = i if direction == "f" else self.steps - 1 - i
                model = fields[m, None if self.time == "continuous" else k]
                parts = [x, out_x[:, ctx], *(np.broadcast_to(t, (len(x), t.shape[1])) for t in self._inputs(np.full((1, 1), times[k])))]
                x = x + dt * model.predict(np.concatenate(parts, 1))
                if noise is not None and i < self.steps - 1:
                    x = x + self.sigma * np.sqrt(dt) * noise[:, i][:, out]
            out_x[:, out] = x
        return out_x

    def walked(self, coupling: DataFrame, direction: str, salt: int) -> DataFrame:
        """The coupling with its other side made by integrating the field of `direction` from the side that is given."""
        d, own = len(self.cols), self
        start, end = ("a", "b") if direction == "f" else ("b", "a")
        if self.kind == "linear":
            return self._walked_columns(coupling, direction, salt)
        shared = coupling.sparkSession.sparkContext.broadcast(self.fields[direction])

        def run(batches):
            for b in batches:
                e = hashed_normals(b.column("key").to_numpy(), own.seed, salt, (own.steps - 1, d))
                x = own._simulate(shared.value, direction, matrix(b, [f"{start}{j}" for j in range(d)]), e)
                yield pa.RecordBatch.from_pydict({"id": b.column("id"), **{f"{start}{j}": b.column(f"{start}{j}") for j in range(d)}, **{f"{end}{j}": pa.array(x[:, j]) for j in range(d)}})

        kind = "id string, " + ", ".join(f"{side}{j} double" for side in (start, end) for j in range(d))
        fields, self.fields = self.fields, {}  # shipped once, by the broadcast
        out = coupling.select("id", F.xxhash64("id").alias("key"), *[f"{start}{j}" for j in range(d)]).mapInArrow(run, kind)
        self.fields = fields
        return out.select("id", *[f"{side}{j}" for side in "ab" for j in range(d)])

    def _walked_columns(self, coupling: DataFrame, direction: str, salt: int) -> DataFrame:
        """The same as column expressions, for linear fields of discrete time: no Python in the tasks."""
        d, dt = len(self.cols), 1 / self.steps
        start, end = ("a", "b") if direction == "f" else ("b", "a")
        out = coupling.select("id", *[f"{start}{j}" for j in range(d)], *[F.col(f"{start}{j}").alias(f"{end}{j}") for j in range(d)])
        known = out.columns
        for m, (outs, ctx) in enumerate(self._plan()):
            for i in range(self.steps):
                w = self.fields[direction][m, i if direction == "f" else self.steps - 1 - i].weights
                terms = [F.col(f"{end}{j}") for j in (*outs, *ctx)]
                moved = {}
                for k, j in enumerate(outs):
                    drift = sum((F.lit(float(c)) * t for c, t in zip(w[1:, k], terms)), F.lit(float(w[0, k])))
                    noise = F.lit(self.sigma * dt**0.5) * normal(self._tag(f"path{salt}:{i}:{j}"), F.col("id")) if i < self.steps - 1 else F.lit(0.0)
                    moved[f"{end}{j}"] = F.col(f"{end}{j}") + F.lit(dt) * drift + noise
                out = out.withColumns(moved)
        return out.select("id", *[f"{side}{j}" for side in "ab" for j in range(d)]).select(*[c for c in ("id", *[f"{s}{j}" for s in "ab" for j in range(d)]) if c in known])

    def _pairs(self, last: str | None, key: np.ndarray, a: np.ndarray, w: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Both sides of the coupling that walking the fields of `last` has made; w: the side that it made."""
        if last == "f":
            return a, w
        prior = hashed_normals(key, self.seed, PRIOR, (len(self.cols),))
        if last == "b":
            return w, prior
        return a, a + self.sigma * prior if self.first == "ref" else prior

    def _fit_unstored(self, df: DataFrame, id_col: str) -> ImfSolver:
        """The same stages, of which only the coupling is stored; training rows are made where they are learned from."""
        d, groups = len(self.cols), list(range(self.steps)) if self.time == "discrete" else [0]
        table, unit = _keyed(df, id_col, self.cols)
        shapes = [(len(out) + len(ctx) + (0 if self.time == "discrete" else 9 if self.kind == "mlp" else 1), len(out)) for out, ctx in self._plan()]
        per, last = len(groups) * self.tuples_per_row, None
        if self.kind == "mlp":
            plain = blocks_of(table, [f"a{j}" for j in range(d)], per, len(groups), self.params.get("batches", 10))
            dropped(table)
        for i, direction in enumerate(self.sequence):
            before = table if self.kind == "trees" else plain
            if last is not None:
                walk = ImfWalk(self._bare(), self.fields[last], last, i)
                if self.kind == "trees":
                    before = stored(_walked_rows(table, walk, d), "imf-pairs")
                else:
                    before = walked_blocks(plain, walk, d)
            rows = ImfRows(self._bare(), direction, i, last)
            if self.kind == "trees":
                found = fit_trees(before, d, shapes, groups, rows, self.params, unit)
            else:
                found = fit_networks(before, d, shapes, groups, rows, self.params, unit, per)
            self.fields[direction] = {(m, g if self.time == "discrete" else None): own for (m, g), own in found.items()}
            if last is not None:
                dropped(before) if self.kind == "trees" else before.drop()
            last = direction
        dropped(table) if self.kind == "trees" else plain.drop()
        return self

    def _bare(self) -> ImfSolver:
        return replace(self, fields={})

    def fit(self, df: DataFrame, id_col: str) -> ImfSolver:
        if _unstored(self.kind, self._plan(), self.time, self.steps, self.params):
            return self._fit_unstored(df, id_col)
        return self._fit_stored(df, id_col)

    def _fit_stored(self, df: DataFrame, id_col: str) -> ImfSolver:
        """Alternates three stages over all rows: couple them, fit the fields of one direction, walk along them. Each stage is stored;
        the driver holds fields only."""
        d = range(len(self.cols))
        data = df.select(F.col(id_col).cast("string").alias("id"), *[F.col(c).cast("double").alias(f"a{j}") for j, c in enumerate(self.cols)]).dropna()
        prior = [normal(self._tag(f"prior{j}"), F.col("id")) for j in d]
        ends = [F.col(f"a{j}") + F.lit(self.sigma) * p if self.first == "ref" else p for j, p in zip(d, prior)]
        data = stored(spread(data, "id"), "imf-data")
        coupling = stored(data.select("*", *[e.alias(f"b{j}") for j, e in zip(d, ends)]), "imf-pairs")
        last = None
        for i, direction in enumerate(self.sequence):
            if last is not None:
                before = data.select("*", *[p.alias(f"b{j}") for j, p in zip(d, prior)])
                dropped(coupling)
                coupling = stored(self.walked(before, last, i), "imf-pairs")
            self.fields[direction] = self._train(coupling, direction, i)
            last = direction
        dropped(coupling)
        dropped(data)
        return self

    def generate(self, ids: np.ndarray, seed: int) -> np.ndarray:
        z = keyed_normals(ids, seed, (self.steps + 1, len(self.cols)))
        return self._simulate(self.fields["b"], "b", z[:, 0], z[:, 1:] if self.noise else None)


@dataclass
class IpfRows:
    """The other direction's path of every row, each step back with the residual of the mean map. Backward paths start from the prior."""

    solver: IpfSolver
    fields: dict
    direction: str
    salt: int
    seen: int = 0

    def __call__(self, key: np.ndarray, a: np.ndarray, w: np.ndarray | None, m: int):
        own, walk = self.solver, "f" if self.direction == "b" else "b"
        own.fields = self.fields
        (out, ctx), steps, one = own._plan()[m], own.grid.steps, own.time == "continuous"
        self.seen += len(key) * steps
        tabulated(self.fields.get(walk, {}), self.seen)
        tag = 2 * (1000 * m + self.salt) + (walk == "f")
        x = a[:, out] if walk == "f" else np.stack([hashed_normals(key, own.seed, PRIOR + 1000 * (1 + self.salt) + j, ()) for j in out], 1)
        c = np.stack([a[:, j] + own.parent_noise * hashed_normals(key, own.seed, PARENTS + 1000 * m + j, ()) for j in ctx], 1) if ctx else np.zeros((len(a), 0))
        e = hashed_normals(key, own.seed, tag, (steps, len(out)))
        for k in range(steps) if walk == "f" else range(steps - 1, -1, -1):
            here = own._mean(walk, m, x, c, k)
            after = here + np.sqrt(2 * own.grid.gamma[k]) * e[:, k]
            # the field learns to step back from `after`
            t = [np.full((len(x), 1), own.grid.t[k])] if one else []
            yield 0 if one else k, np.concatenate([after, c, *t], 1), here - own._mean(walk, m, after, c, k)
            x = after


@dataclass
class IpfSolver(Solver):
    """Iterative proportional fitting with mean-map fields on a time grid; forward starts as an Ornstein-Uhlenbeck
    process. time and structure as for ImfSolver; 'featurewise' uses `parents` (a DAG), with noise on parents."""

    cols: list[str]
    kind: str = "trees"
    time: str = "discrete"
    structure: str = "joint"
    grid: TimeGrid = field(default_factory=lambda: TimeGrid(10, 0.02, 0.3, "geom"))
    rounds: int = 2
    alpha: float = 1.0
    parents: dict[str, list[str]] | None = None
    parent_noise: float = 0.01
    seed: int = 0
    params: dict = field(default_factory=dict)
    fields: dict = field(default_factory=dict)

    def _plan(self) -> list[tuple[list[int], list[int]]]:
        if self.structure == "joint":
            return [(list(range(len(self.cols))), [])]
        order = topological(self.cols, self.parents or {})
        return [([self.cols.index(c)], [self.cols.index(p) for p in (self.parents or {}).get(c, [])]) for c in order]

    def _mean(self, direction: str, m: int, x: np.ndarray, ctx: np.ndarray, k: int) -> np.ndarray:
        if direction == "f" and "f" not in self.fields:
            return x - self.grid.gamma[k] * self.alpha * x
        model = self.fields[direction][m, None if self.time == "continuous" else k]
        t = [np.full((len(x), 1), self.grid.t[k])] if self.time == "continuous" else []
        return x + model.predict(np.concatenate([x, ctx, *t], 1) if t or ctx.size else x)

    def training_rows(self, data: DataFrame, direction: str, salt: int, m: int) -> DataFrame:
        """The rows that model m of `direction` learns from: the other direction's path of every row, each step back with the residual
        of the mean map. Backward paths start from the prior."""
        out, ctx = self._plan()[m]
        steps, own, walk = self.grid.steps, self, "f" if direction == "b" else "b"
        tag = lambda what: f"ipf{self.seed}:{salt}:{direction}:{what}"
        key, names = F.col("id"), [f"s{i}" for i in range(len(out))]
        starts = [F.col(f"a{j}") if walk == "f" else normal(tag(f"start{j}"), key) for j in out]
        known = [F.col(f"a{j}") + F.lit(self.parent_noise) * normal(f"ipf{self.seed}:parent{m}:{j}", key) for j in ctx]
        n, extra = len(out), 1 if self.time == "continuous" else 0
        xs, ys = [f"x{i}" for i in range(n + len(ctx) + extra)], [f"y{i}" for i in range(n)]
        shared = data.sparkSession.sparkContext.broadcast(self.fields)

        def run(batches):
            own.fields = shared.value
            for b in batches:
                x, c = matrix(b, names), matrix(b, [f"c{i}" for i in range(len(ctx))])
                e = hashed_normals(b.column("key").to_numpy(), own.seed, 2 * (1000 * m + salt) + (walk == "f"), (steps, n))
                for k in range(steps) if walk == "f" else range(steps - 1, -1, -1):
                    here = own._mean(walk, m, x, c, k)
                    after = here + np.sqrt(2 * own.grid.gamma[k]) * e[:, k]
                    # the field learns to step back from `after`
                    shift = here - own._mean(walk, m, after, c, k)
                    full = np.concatenate([after, c, *([np.full((len(x), 1), own.grid.t[k])] if extra else [])], 1)
                    yield pa.RecordBatch.from_pydict({"g": pa.array(np.full(len(x), k if not extra else 0), pa.int32()), "id": b.column("id"), **{q: pa.array(full[:, i]) for i, q in enumerate(xs)}, **{q: pa.array(shift[:, i]) for i, q in enumerate(ys)}})
                    x = after

        kind = "g int, id string, " + ", ".join(f"{q} double" for q in [*xs, *ys])
        fields, self.fields = self.fields, {}
        rows = data.select("id", F.xxhash64("id").alias("key"), *[s.alias(q) for s, q in zip(starts, names)], *[c.alias(f"c{i}") for i, c in enumerate(known)]).mapInArrow(run, kind)
        self.fields = fields
        return rows

    def _train(self, data: DataFrame, direction: str, salt: int) -> dict:
        groups, found = list(range(self.grid.steps)) if self.time == "discrete" else [0], {}
        for m in range(len(self._plan())):
            rows = stored(self.training_rows(data, direction, salt, m), "ipf-rows")
            for g, own in fit_groups(rows, groups, self.kind, self.params).items():
                found[m, g if self.time == "discrete" else None] = own
            dropped(rows)
        return found

    def _fit_unstored(self, df: DataFrame, id_col: str) -> IpfSolver:
        """The same stages with nothing stored but the rows: paths and training rows are made where they are learned from."""
        d, groups, extra = len(self.cols), list(range(self.grid.steps)) if self.time == "discrete" else [0], 0 if self.time == "discrete" else 1
        table, unit = _keyed(df, id_col, self.cols)
        shapes = [(len(out) + len(ctx) + extra, len(out)) for out, ctx in self._plan()]
        if self.kind == "mlp":
            blocks = blocks_of(table, [f"a{j}" for j in range(d)], self.grid.steps, len(groups), self.params.get("batches", 10))
            dropped(table)
        for i in range(self.rounds):
            for direction in "bf" if i + 1 < self.rounds else "b":
                rows = IpfRows(replace(self, fields={}), self.fields, direction, i)
                if self.kind == "trees":
                    found = fit_trees(table, d, shapes, groups, rows, self.params, unit)
                else:
                    found = fit_networks(blocks, d, shapes, groups, rows, self.params, unit, self.grid.steps)
                self.fields = self.fields | {direction: {(m, None if extra else g): own for (m, g), own in found.items()}}
        dropped(table) if self.kind == "trees" else blocks.drop()
        return self

    def fit(self, df: DataFrame, id_col: str) -> IpfSolver:
        if _unstored(self.kind, self._plan(), self.time, self.grid.steps, self.params):
            return self._fit_unstored(df, id_col)
        return self._fit_stored(df, id_col)

    def _fit_stored(self, df: DataFrame, id_col: str) -> IpfSolver:
        """Alternates path stages and fits over all rows; each stage is stored, the driver holds fields only."""
        data = stored(spread(df.select(F.col(id_col).cast("string").alias("id"), *[F.col(c).cast("double").alias(f"a{j}") for j, c in enumerate(self.cols)]).dropna(), "id"), "ipf-data")
        for i in range(self.rounds):
            self.fields["b"] = self._train(data, "b", i)
            if i + 1 < self.rounds:
                self.fields["f"] = self._train(data, "f", i)
        dropped(data)
        return self

    def generate(self, ids: np.ndarray, seed: int) -> np.ndarray:
        z = keyed_normals(ids, seed, (self.grid.steps + 1, len(self.cols)))
        out_x = np.zeros((len(ids), len(self.cols)))
        for m, (out, ctx) in enumerate(self._plan()):
            x = z[:, 0][:, out]
            for i, k in enumerate(range(self.grid.steps - 1, -1, -1)):
                x = self._mean("b", m, x, out_x[:, ctx], k)
                if k:
                    x = x + np.sqrt(2 * self.grid.gamma[k]) * z[:, i + 1][:, out]
            out_x[:, out] = x
        return out_x


def topological(cols: list[str], parents: dict[str, list[str]]) -> list[str]:
    """Columns with parents first; an edge that would close a cycle is left out of the order."""
    done: list[str] = []
    left = list(cols)
    while left:
        free = [c for c in left if all(p in done or p not in left for p in parents.get(c, []))]
        done.append(free[0] if free else left[0])
        left.remove(done[-1])
    return done


def _cells(binned: DataFrame, families: list[tuple[str, ...]], bins: int) -> dict[tuple[str, ...], np.ndarray]:
    """Counts of each family's cells, an axis a column, in one job: a row carries a number per family, and no more than
    families * bins**columns counts come back."""
    if not families:
        return {}
    number = lambda f: sum((F.col(f"bin_{c}") * F.lit(bins**k) for k, c in enumerate(reversed(f))), F.lit(0)).cast("int")
    out = {f: np.zeros((bins,) * len(f), np.int64) for f in families}
    rows = binned.select(F.posexplode(F.array(*[number(f) for f in families])).alias("i", "v")).groupBy("i", "v").count().collect()
    for i, v, n in rows:
        out[families[i]].ravel()[v] = n
    return out


def learn_structure(df: DataFrame, cols: list[str], bins: int = 5, most_parents: int = 2, candidates: int = 8) -> dict[str, list[str]]:
    """Parents of each column by hill climbing on BIC over quantile bins.

    Pairs are counted first; only the `candidates` columns that share most information with a column are tried as its parents, so the
    families counted grow with the columns times candidates**most_parents. With no more columns than candidates the search is exhaustive.
    """
    binned, _ = metrics.quantile_bins(df, cols, bins)
    pairs = _cells(binned, list(combinations(cols, 2)), bins)
    pairs |= {(b, a): n.T for (a, b), n in pairs.items()}
    alone = {c: next(iter(n.sum(1) for (a, _), n in pairs.items() if a == c), None) for c in cols}
    if len(cols) == 1:
        alone = {c: n for (c,), n in _cells(binned, [(cols[0],)], bins).items()}

    def shared(a: str, b: str) -> float:
        n = pairs[a, b]
        at = n > 0
        return float((n[at] * np.log(n[at] * max(n.sum(), 1) / np.outer(n.sum(1), n.sum(0))[at])).sum())

    near = {c: sorted((x for x in cols if x != c), key=lambda x: (-shared(c, x), cols.index(x)))[:candidates] for c in cols}
    near = {c: [x for x in cols if x in own] for c, own in near.items()}
    sets = {c: [ps for n in range(2, most_parents + 1) for ps in combinations(near[c], n)] for c in cols}
    larger = _cells(binned, [(*ps, c) for c in cols for ps in sets[c]], bins)
    score = {}
    for c in cols:
        for ps in [(), *((p,) for p in near[c]), *sets[c]]:
            cells = (alone[c] if not ps else pairs[ps[0], c] if len(ps) == 1 else larger[*ps, c]).reshape(-1, bins)
            by_parent = np.repeat(cells.sum(1)[:, None], bins, 1)
            at = cells > 0
            fit = (cells[at] * np.log(cells[at] / by_parent[at])).sum()
            score[c, ps] = fit - 0.5 * np.log(max(cells.sum(), 2)) * (cells.sum(1) > 0).sum() * (bins - 1)
    parents: dict[str, tuple[str, ...]] = {c: () for c in cols}
    place = {c: i for i, c in enumerate(cols)}
    canon = lambda ps: tuple(sorted(ps, key=place.get))

    def reaches(a: str, b: str) -> bool:
        return a == b or any(reaches(p, b) for p in parents[a])

    while True:
        moves = []
        for c in cols:
            for p in cols:
                if p in parents[c]:
                    moves.append((score[c, canon(set(parents[c]) - {p})] - score[c, parents[c]], c, canon(set(parents[c]) - {p})))
                elif p in near[c] and len(parents[c]) < most_parents and not reaches(p, c):
                    moves.append((score[c, canon({*parents[c], p})] - score[c, parents[c]], c, canon({*parents[c], p})))
        gain, c, new = max(moves, default=(0, "", ()))
        if gain <= 1e-9:
            return {c: list(ps) for c, ps in parents.items()}
        parents[c] = new


def lower_factors(raw: np.ndarray) -> np.ndarray:
    """Cholesky factors from free parameters (K, d, d): the lower triangle, with the logarithm of its diagonal."""
    low = np.tril(raw, -1)
    i = np.arange(raw.shape[1])
    low[:, i, i] = np.exp(raw[:, i, i])
    return low


@dataclass
class LightObjective:
    """Sums over rows x of log C(x0) - log v(x), x0 standard normal, and their gradients by log weights, centres and scales:
    logarithms of variances (K, d), or the free parameters (K, d, d) of Cholesky factors."""

    eps: float

    def __call__(self, params: list[np.ndarray], x: np.ndarray, rng: np.random.Generator) -> tuple[float, list[np.ndarray]]:
        x0 = rng.normal(size=x.shape)
        return (self.full if params[2].ndim == 3 else self.diagonal)(params, x0, x)

    def diagonal(self, params: list[np.ndarray], x0: np.ndarray, x: np.ndarray) -> tuple[float, list[np.ndarray]]:
        la, r, ls = params
        s = np.exp(ls)
        c = la + ((x0**2) @ s.T + 2 * x0 @ r.T) / (2 * self.eps)
        d = x[:, None, :] - r
        v = la - 0.5 * (d**2 / (self.eps * s) + ls + np.log(2 * np.pi * self.eps)).sum(2)
        pc, pv = _soft(c), _soft(v)
        gr = pc.T @ x0 / self.eps - np.einsum("nk,nkd->kd", pv, d / (self.eps * s))
        gs = pc.T @ (x0**2) / (2 * self.eps) * s - np.einsum("nk,nkd->kd", pv, 0.5 * d**2 / (self.eps * s) - 0.5)
        return float((_log_sum(c) - _log_sum(v)).sum()), [pc.sum(0) - pv.sum(0), gr, gs]

    def full(self, params: list[np.ndarray], x0: np.ndarray, x: np.ndarray) -> tuple[float, list[np.ndarray]]:
        la, r, raw = params
        low = lower_factors(raw)
        i = np.arange(raw.shape[1])
        y = np.einsum("nd,kde->nke", x0, low)  # L^T x0
        c = la + ((y**2).sum(2) + 2 * x0 @ r.T) / (2 * self.eps)
        inv = np.linalg.inv(low)
        d = x[:, None, :] - r
        z = np.einsum("kde,nke->nkd", inv, d)  # L^-1 d
        v = la - 0.5 * ((z**2).sum(2) / self.eps + x.shape[1] * np.log(2 * np.pi * self.eps)) - raw[:, i, i].sum(1)
        pc, pv = _soft(c), _soft(v)
        w = np.einsum("ked,nke->nkd", inv, z)  # S^-1 d
        gr = pc.T @ x0 / self.eps - np.einsum("nk,nkd->kd", pv, w) / self.eps
        # by L: x0 (L^T x0)^T / eps from C, and S^-1 d (L^-1 d)^T / eps - L^-T from v
        gl = np.einsum("nk,nd,nke->kde", pc, x0, y, optimize=True) / self.eps - (np.einsum("nk,nkd,nke->kde", pv, w, z, optimize=True) / self.eps - pv.sum(0)[:, None, None] * np.swapaxes(inv, 1, 2))
        gl = np.tril(gl)
        gl[:, i, i] *= low[:, i, i]
        return float((_log_sum(c) - _log_sum(v)).sum()), [pc.sum(0) - pv.sum(0), gr, gl]


@dataclass
class LightSolver(Solver):
    """Light Schroedinger bridge: a Gaussian mixture potential fitted by closed-form gradients of
    mean log C(x0) - mean log v(x1), from the prior to the data; sampling draws from the plan. The covariances are diagonal
    or full (Cholesky factors). All rows are read, a minibatch a step, `epochs` times."""

    cols: list[str]
    components: int = 12
    eps: float = 0.3
    epochs: int = 2
    batches: int = 30
    least_steps: int = 50
    rate: float = 8e-2
    covariance: str = "diagonal"
    seed: int = 0
    sde_steps: int = 0
    state: tuple | None = None
    losses: list[float] = field(default_factory=list)

    def fit(self, df: DataFrame, id_col: str) -> LightSolver:
        if self.covariance not in ("diagonal", "full"):
            raise ValueError(f"no such covariance: {self.covariance}")
        table = TrainingTable.build(df, id_col, self.cols, self.batches)
        centres = _spread_rows(table, self.components, self.seed)
        k, d = centres.shape
        scale = np.full((k, d), np.log(0.3)) if self.covariance == "diagonal" else np.repeat(np.diag(np.full(d, 0.5 * np.log(0.3)))[None], k, 0)
        params = [np.zeros(k), centres, scale]
        # a small table has few steps an epoch
        epochs = max(self.epochs, -(-self.least_steps // table.batches))
        self.losses = train(table, params, LightObjective(self.eps), epochs, self.rate, clip=None, seed=self.seed, anneal=True) if k else []
        self.state = tuple(params)
        table.drop()
        return self

    def _covariances(self) -> np.ndarray:
        low = lower_factors(self.state[2])
        return low @ np.swapaxes(low, 1, 2)

    def transport(self, x0: np.ndarray, e: np.ndarray, u: np.ndarray) -> np.ndarray:
        la, r, ls = self.state
        if ls.ndim == 3:
            s, low = self._covariances(), lower_factors(ls)
            c = la + (np.einsum("nd,kde,ne->nk", x0, s, x0, optimize=True) + 2 * x0 @ r.T) / (2 * self.eps)
        else:
            s = np.exp(ls)
            c = la + ((x0**2) @ s.T + 2 * x0 @ r.T) / (2 * self.eps)
        k = (np.cumsum(_soft(c), 1) < u[:, None]).sum(1).clip(0, len(la) - 1)
        if ls.ndim == 3:
            return r[k] + np.einsum("nde,ne->nd", s[k], x0) + np.sqrt(self.eps) * np.einsum("nde,ne->nd", low[k], e)
        return r[k] + s[k] * x0 + np.sqrt(self.eps * s[k]) * e

    def drift(self, x: np.ndarray, t: float) -> np.ndarray:
        """The bridge's drift: towards the mean of the end given the state, over the time that is left."""
        la, r, ls = self.state
        if ls.ndim == 3:
            inv, d = np.linalg.inv(self._covariances()), x.shape[1]
            pull = t / (self.eps * (1 - t)) * np.eye(d) + inv / self.eps
            back = np.linalg.inv(pull)
            push = np.einsum("kde,ke->kd", inv, r) / self.eps
            h = x[:, None, :] / (self.eps * (1 - t)) + push
            mean = np.einsum("kde,nke->nkd", back, h)
            w = la + 0.5 * (h * mean).sum(2) - 0.5 * (push * r).sum(1) - 0.5 * np.linalg.slogdet(pull)[1] + 0.5 * np.linalg.slogdet(inv)[1]
            return (np.einsum("nk,nkd->nd", _soft(w), mean) - x) / (1 - t)
        s = np.exp(ls)
        pull = t / (self.eps * (1 - t)) + 1 / (self.eps * s)
        h = x[:, None, :] / (self.eps * (1 - t)) + r / (self.eps * s)
        w = la + (h**2 / (2 * pull) - r**2 / (2 * self.eps * s) - 0.5 * np.log(pull) - 0.5 * ls).sum(2)
        return (np.einsum("nk,nkd->nd", _soft(w), h / pull) - x) / (1 - t)

    def generate(self, ids: np.ndarray, seed: int) -> np.ndarray:
        """Draws from the plan; with sde_steps by integrating the drift instead."""
        if self.sde_steps:
            z, dt = keyed_normals(ids, seed, (self.sde_steps + 1, len(self.cols))), 1 / self.sde_steps
            x = z[:, 0]
            for k in range(self.sde_steps):
                x = x + dt * self.drift(x, k * dt) + np.sqrt(self.eps * dt) * z[:, k + 1]
            return x
        z = keyed_normals(ids, seed, (3, len(self.cols)))
        u = 0.5 * (1 + np.vectorize(math.erf)(z[:, 2, 0] / math.sqrt(2)))
        return self.transport(z[:, 0], z[:, 1], u)

    def paths(self, x0: np.ndarray, x1: np.ndarray, times: np.ndarray, e: np.ndarray) -> np.ndarray:
        """Brownian bridges between the ends at the given times: (times, rows, columns)."""
        return np.stack([(1 - t) * x0 + t * x1 + np.sqrt(self.eps * t * (1 - t)) * e[i] for i, t in enumerate(times)])


def _spread_rows(table: TrainingTable, k: int, seed: int) -> np.ndarray:
    """k rows of a training table to begin with: the first one of each of k blocks' orders, in the order of blocks."""
    some = table.blocks.orderBy(F.xxhash64("block", F.lit(seed)), "block", "part").limit(k).select("block", "part", "n", "x").collect()
    rng, d = generator(seed, 77), len(table.cols)
    rows = [np.frombuffer(bytes(r["x"])).reshape(-1, d) for r in some]
    if not rows:
        return np.zeros((0, d))
    # from few blocks, several rows each
    picks = [rng.permutation(len(x))[: -(-k // len(rows))] for x in rows]
    return np.concatenate([x[p] for x, p in zip(rows, picks)])[:k].copy()


def _log_sum(q: np.ndarray) -> np.ndarray:
    top = q.max(1)
    return top + np.log(np.exp(q - top[:, None]).sum(1))


def _soft(q: np.ndarray) -> np.ndarray:
    e = np.exp(q - q.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


@dataclass
class CategoricalSolver(Solver):
    """Bridge matching for categorical columns, alone or (with `numeric`) beside numeric ones, by one network.

    The network sees the state and the time n/K and gives logits of the end of each categorical column and the drift
    of the numeric ones. Loss: KL of the true bridge step against the model's step, plus `weight` times cross entropy,
    plus the squared error of the drift. Directions alternate; alpha falls by `decay` every fifth outer round.
    """

    cols: list[str]
    states: dict[str, int]
    steps: int = 8
    alpha: float = 0.15
    kernel: str = "uniform"
    rounds: int = 2
    inner: int = 500
    weight: float = 0.3
    sigma: float = 1.0
    decay: float = 0.9
    hidden: tuple[int, ...] = (64, 64)
    train_rows: int = 4000
    seed: int = 0
    nets: dict = field(default_factory=dict)
    refs: dict = field(default_factory=dict)

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.cols if c not in self.states]

    @property
    def cats(self) -> list[str]:
        return [c for c in self.cols if c in self.states]

    def _inputs(self, num: np.ndarray, cat: np.ndarray, n: np.ndarray) -> np.ndarray:
        hot = [np.eye(self.states[c])[cat[:, j]] for j, c in enumerate(self.cats)]
        return np.concatenate([num, *hot, (n / self.steps)[:, None], time_features(n / self.steps, 8)], 1)

    def _powers(self) -> dict[str, np.ndarray]:
        return {c: CategoricalReference(self.states[c], self.steps, self.alpha, self.kernel).powers for c in self.cats}

    @staticmethod
    def _pick(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
        return (np.cumsum(p, 1) < rng.uniform(size=(len(p), 1))).sum(1).clip(0, p.shape[1] - 1)

    def _train(self, direction: str, start: tuple, end: tuple, rng: np.random.Generator) -> None:
        """start: data side (num, cat); end: prior side. Forward predicts the end from the state, backward the start."""
        q, dn, kk = self._powers(), len(self.numeric), self.steps
        outs = dn + sum(self.states[c] for c in self.cats)
        net = self.nets.get(direction) or MLP([dn + sum(self.states[c] for c in self.cats) + 9, *self.hidden, outs], self.seed + (direction == "f"))

        def batches():
            for i in minibatches(len(start[0]), self.inner, 256, rng):
                n = rng.integers(0, kk, len(i)) if direction == "f" else rng.integers(1, kk + 1, len(i))
                t, e = (n / kk)[:, None], rng.normal(size=(len(i), dn))
                t = np.clip(t, 0.5 / kk, 1 - 0.5 / kk)
                a, b = start[0][i], end[0][i]
                x = (1 - t) * a + t * b + self.sigma * np.sqrt(t * (1 - t)) * e
                y = b - a - self.sigma * np.sqrt(t / (1 - t)) * e if direction == "f" else a - b - self.sigma * np.sqrt((1 - t) / t) * e
                state, true, kernel = np.zeros((len(i), len(self.cats)), int), [], []
                for j, c in enumerate(self.cats):
                    a0, b1, p = start[1][i, j], end[1][i, j], q[c]
                    w = p[n, a0] * np.swapaxes(p[kk - n], 1, 2)[np.arange(len(i)), b1]
                    state[:, j] = self._pick(w / w.sum(1, keepdims=True), rng)
                    s = state[:, j]
                    if direction == "f":  # (rows, end, next state)
                        k = p[1][s][:, None, :] * np.swapaxes(p[kk - 1 - n], 1, 2)
                        goal = b1
                    else:  # (rows, start, previous state)
                        k = p[n - 1] * p[1].T[s][:, None, :]
                        goal = a0
                    k = k / np.maximum(k.sum(2, keepdims=True), 1e-30)
                    kernel.append(k)
                    true.append(goal)
                yield self._inputs(x, state, n), (y, true, kernel)

        def gradient(out, extra):
            y, true, kernel = extra
            g = np.zeros_like(out)
            if dn:
                g[:, :dn] = 2 * (out[:, :dn] - y) / y.size
            at = dn
            for j, c in enumerate(self.cats):
                s = self.states[c]
                p = _soft(out[:, at : at + s])
                rows = np.arange(len(out))
                step = kernel[j][rows, true[j]]  # the true bridge's step
                model = np.einsum("ne,nes->ns", p, kernel[j])
                dp = -np.einsum("ns,nes->ne", step / np.maximum(model, 1e-9), kernel[j])
                kl = p * (dp - (dp * p).sum(1, keepdims=True))
                ce = p - np.eye(s)[true[j]]
                g[:, at : at + s] = (kl + self.weight * ce) / (len(out) * max(1, len(self.cats)))
                at += s
            return g

        net.train(batches(), gradient)
        self.nets[direction] = net

    def _walk(self, direction: str, num: np.ndarray, cat: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        q, kk, dn = self._powers(), self.steps, len(self.numeric)
        num, cat = num.copy(), cat.copy()
        for n in range(kk) if direction == "f" else range(kk, 0, -1):
            out, _ = self.nets[direction].forward(self._inputs(num, cat, np.full(len(cat), n, float)))
            last = n == (kk - 1 if direction == "f" else 1)
            num = num + out[:, :dn] / kk + (0 if last else self.sigma * np.sqrt(1 / kk) * rng.normal(size=num.shape))
            at = dn
            for j, c in enumerate(self.cats):
                s = self.states[c]
                p, x = _soft(out[:, at : at + s]), cat[:, j]
                k = q[c][1][x][:, None, :] * q[c][kk - 1 - n].T[None] if direction == "f" else q[c][n - 1][None] * q[c][1].T[x][:, None, :]
                k = k / np.maximum(k.sum(2, keepdims=True), 1e-30)
                m = np.einsum("ne,nes->ns", p, k)
                cat[:, j] = self._pick(m / m.sum(1, keepdims=True), rng)
                at += s
        return num, cat

    def _prior(self, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
        return rng.normal(size=(n, len(self.numeric))), np.stack([rng.integers(0, self.states[c], n) for c in self.cats], 1) if self.cats else np.zeros((n, 0), int)

    def fit(self, df: DataFrame, id_col: str) -> CategoricalSolver:
        rng = np.random.default_rng(self.seed)
        m = bounded_matrix(df, id_col, [*self.numeric, *self.cats], self.train_rows, self.seed)
        data = m[:, : len(self.numeric)], m[:, len(self.numeric) :].astype(int)
        for i in range(self.rounds):
            prior = self._prior(len(m), rng)
            # the first coupling is independent; later ones walk with the other direction
            ends = prior if i == 0 else self._walk("f", *data, rng)
            self._train("b", data, ends, rng)
            self._train("f", self._walk("b", *prior, rng), prior, rng)
            if i + 1 < self.rounds and (i + 1) % 5 == 0:
                self.alpha *= self.decay
        self._train("b", data, self._walk("f", *data, rng), rng)
        return self

    def generate(self, ids: np.ndarray, seed: int) -> np.ndarray:
        out = np.zeros((len(ids), len(self.cols)))
        block = ids // NOISE_BLOCK
        for b in np.unique(block):  # a block's rows share a generator, so each is made whole
            rng = generator(seed, int(b))
            num, cat = self._walk("b", *self._prior(NOISE_BLOCK, rng), rng)
            own = block == b
            whole = np.empty((NOISE_BLOCK, len(self.cols)))
            for j, c in enumerate(self.cols):
                whole[:, j] = num[:, self.numeric.index(c)] if c in self.numeric else cat[:, self.cats.index(c)]
            out[own] = whole[ids[own] % NOISE_BLOCK]
        return out


def solver(name: str, cols: list[str], **params) -> Solver:
    """The solvers by algorithm, time, structure and field."""
    table = {
        "ipf_continuous_mlp": lambda: IpfSolver(cols, "mlp", "continuous", **params),
        "imf_continuous_mlp": lambda: ImfSolver(cols, "mlp", "continuous", **params),
        "ipf_continuous_trees": lambda: IpfSolver(cols, "trees", "continuous", **params),
        "imf_continuous_trees": lambda: ImfSolver(cols, "trees", "continuous", **params),
        "ipf_continuous_structural": lambda: IpfSolver(cols, "trees", "continuous", "featurewise", **params),
        "ipf_discrete_mlp": lambda: IpfSolver(cols, "mlp", "discrete", **params),
        "imf_discrete_mlp": lambda: ImfSolver(cols, "mlp", "discrete", **params),
        "ipf_discrete_trees": lambda: IpfSolver(cols, "trees", "discrete", **params),
        "imf_discrete_trees": lambda: ImfSolver(cols, "trees", "discrete", **params),
        "ipf_discrete_structural": lambda: IpfSolver(cols, "trees", "discrete", "featurewise", **params),
        "imf_discrete_featurewise": lambda: ImfSolver(cols, "trees", "discrete", "featurewise", **params),
        "light": lambda: LightSolver(cols, **params),
        "categorical": lambda: CategoricalSolver(cols, **params),
        "mixed": lambda: CategoricalSolver(cols, **params),
    }
    return table[name]()
