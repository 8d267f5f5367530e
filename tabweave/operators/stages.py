"""Fields fitted over whole tables of training rows, a field for each group of rows (a step of time).

Rows are a stored table: g (the group), id, x0.., y0... All fields of a table are fitted together: linear ones from sums of products
in one aggregate, trees from a task per group (or, where a group is larger than `memory`, over the cluster by the same
algorithm, with the same trees), networks by rounds of local descent in which each round moves every group's weights.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabweave.functions.rand import generator
from tabweave.operators.boosting import WholeTrees
from tabweave.operators.fields import MLP, RidgeField
from tabweave.operators.training import Step, TrainingTable
from tabweave.sources.readers import scratch_path

MEMORY = 128_000_000
#: Rows that a network answers at a time.
AT_ONCE = 1024


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt to at least as many tasks as there are cores, for work that is heavy for its bytes."""
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()), key)


def dropped(df: DataFrame) -> None:
    """Removes a table of stored() that nothing reads again."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def matrix(batch: pa.RecordBatch | pa.Table, cols: list[str]) -> np.ndarray:
    if not cols:
        return np.zeros((batch.num_rows, 0))
    return np.stack([batch.column(c).to_numpy() if isinstance(batch, pa.Table) else batch.column(c).to_numpy(zero_copy_only=False) for c in cols], 1).astype(float)


def columns_of(df: DataFrame, letter: str) -> list[str]:
    """x0, x1, ... in order."""
    return sorted((c for c in df.columns if c[0] == letter and c[1:].isdigit()), key=lambda c: int(c[1:]))


def fit_groups(rows: DataFrame, groups: list[int], kind: str, params: dict, memory: int = MEMORY) -> dict:
    """{group: field}; fields have predict(x). A group without rows gets a field only if `kind` can do without."""
    xs, ys = columns_of(rows, "x"), columns_of(rows, "y")
    if kind in ("ridge", "linear"):
        return _linear(rows, xs, ys, groups, params if kind == "ridge" else {"features": 0, "ridge": 0.0})
    if kind == "trees":
        return _trees(rows, xs, ys, groups, params, memory)
    if kind == "mlp":
        return _networks(rows, xs, ys, groups, params)
    raise ValueError(f"no such field: {kind}")


def _linear(rows: DataFrame, xs: list[str], ys: list[str], groups: list[int], params: dict) -> dict:
    kind = "g int, sums binary"

    def partial(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            g, x, y = b.column("g").to_numpy(), matrix(b, xs), matrix(b, ys)
            for k in np.unique(g):
                hh, hy = RidgeField(**params).sums(x[g == k], y[g == k])
                mine = np.concatenate([hh.ravel(), hy.ravel(), [(g == k).sum()]])
                held[int(k)] = held[int(k)] + mine if int(k) in held else mine
        if held:
            yield pa.RecordBatch.from_pydict({"g": pa.array(list(held), pa.int32()), "sums": pa.array([v.tobytes() for v in held.values()], pa.binary())})

    def total(t: pa.Table) -> pa.Table:
        return pa.table({"g": t.column("g").slice(0, 1), "sums": pa.array([sum(np.frombuffer(s) for s in t.column("sums").to_pylist()).tobytes()], pa.binary())})

    out = {}
    for r in rows.select("g", *xs, *ys).mapInArrow(partial, kind).groupBy("g").applyInArrow(total, kind).collect():  # a row a group
        v = np.frombuffer(bytes(r["sums"]))
        side = int(round((-len(ys) + np.sqrt(len(ys) ** 2 + 4 * (len(v) - 1))) / 2))
        out[r["g"]] = RidgeField(**params).solve(v[: side * side].reshape(side, side), v[side * side : -1].reshape(side, -1), int(v[-1]))
    return {g: out[g] for g in groups}


def _trees(rows: DataFrame, xs: list[str], ys: list[str], groups: list[int], params: dict, memory: int) -> dict:
    largest = rows.groupBy("g").count().agg(F.max("count")).collect()[0][0] or 0
    if largest * (len(xs) + len(ys)) * 8 > memory:
        return {g: WholeTrees(**params).fit(rows.filter(F.col("g") == g), "id", xs, ys) for g in groups}

    def fit(t: pa.Table) -> pa.Table:
        own = WholeTrees(**params).fit_rows(matrix(t, xs), matrix(t, ys))
        return pa.table({"g": t.column("g").slice(0, 1), "field": pa.array([pickle.dumps(own)], pa.binary())})

    found = {r["g"]: pickle.loads(bytes(r["field"])) for r in rows.select("g", *xs, *ys).groupBy("g").applyInArrow(fit, "g int, field binary").collect()}
    return {g: found[g] for g in groups}


@dataclass
class _GroupMoments:
    """Rows, sums and squares off a mean of each group; the first column of x is the group's place."""

    groups: int
    mean: np.ndarray
    unit: np.ndarray

    def __call__(self, x: np.ndarray, rng) -> list[np.ndarray]:
        out = np.zeros((3, self.groups, x.shape[1] - 1))
        for g in np.unique(x[:, 0]).astype(int):
            z = x[x[:, 0] == g, 1:] / self.unit - self.mean[g]
            out[0, g], out[1, g], out[2, g] = len(z), z.sum(0), (z * z).sum(0)
        return [out]


@dataclass
class LocalSteps:
    """Squared errors of a network per group, by local descent: a block's rows of a group take steps of `small` rows from the shared
    weights, and what the weights moved by is the block's gradient; the driver moves by the mean over a group's rows. So a round
    of one job is worth many steps, and its result doesn't depend on where blocks are."""

    groups: int
    inputs: int
    mean: np.ndarray
    std: np.ndarray
    share: np.ndarray
    rate: float
    small: int = 16
    single: bool = False

    @property
    def together(self) -> int:
        """Blocks at a time: so that as many networks take steps side by side as a core's cache holds the rows of."""
        return max(1, (768 if self.single else 48 * self.small) // self.small // self.groups)

    def __call__(self, params: list[np.ndarray], x: np.ndarray, rng) -> tuple[float, list[np.ndarray]]:
        return self.many(params, [(x, rng)])[0]

    def many(self, params: list[np.ndarray], blocks: list) -> list[tuple[float, list[np.ndarray]]]:
        """The same of several blocks (rows, rng), whose groups take their steps side by side; a block's result doesn't depend on those
        beside it: each has its own products, of `small` rows whatever is left (rows that aren't there have no error). With `single`, steps
        are taken in single precision."""
        per, lanes, kind = len(params) // self.groups, [], np.float32 if self.single else float
        for i, (x, rng) in enumerate(blocks):
            for g in np.unique(x[:, 0]).astype(int):
                own = slice(None) if self.groups == 1 else x[:, 0] == g
                z = ((x[own, 1:] - self.mean[g]) / self.std[g]).astype(kind, copy=False)
                lanes.append((i, g, z[rng.permutation(len(z))]))
        found = [(0.0, [np.zeros_like(p) for p in params]) for _ in blocks]
        if not lanes:
            return found
        lanes.sort(key=lambda lane: -len(lane[2]))  # those that still have rows come first
        rows = np.array([len(z) for _, _, z in lanes])
        most, outputs = -(-rows[0] // self.small), lanes[0][2].shape[1] - self.inputs
        data = np.zeros((len(lanes), most * self.small, self.inputs + outputs), kind)
        for j, (_, _, z) in enumerate(lanes):
            data[j, : len(z)] = z
        # all weights of a network lie in a row, and so do their gradients
        flat = np.stack([np.concatenate([p.ravel() for p in params[g * per : (g + 1) * per]]) for _, g, _ in lanes]).astype(kind)
        start, grads = flat.copy(), np.empty_like(flat)
        ends = np.cumsum([p.size for p in params[:per]])
        parts = lambda rows: [rows[:, end - p.size : end].reshape(len(rows), *p.shape) for p, end in zip(params, ends)]
        loss = np.zeros(len(lanes))
        for lo in range(0, rows[0], self.small):
            live = int((rows > lo).sum())
            part, some = data[:live, lo : lo + self.small], np.minimum(rows[:live] - lo, self.small)
            now, into, moved = parts(flat[:live]), parts(grads[:live]), grads[:live]
            out, kept = _forward(now, np.ascontiguousarray(part[:, :, : self.inputs]))
            out -= part[:, :, self.inputs :]
            for j in np.flatnonzero(some < self.small):
                out[j, some[j] :] = 0
            loss[:live] += np.einsum("li,li->l", out.reshape(live, -1), out.reshape(live, -1)) / outputs
            out *= (2 / (some * outputs)).astype(kind)[:, None, None]
            _backward(now, kept, out, into)
            norm = np.sqrt(np.einsum("li,li->l", moved, moved))
            moved *= (self.rate * np.minimum(1.0, 1 / (norm + 1e-12))).astype(kind)[:, None]
            flat[:live] -= moved
        total, moves = [r[0] for r in found], parts((start - flat).astype(float))
        for j, (i, g, z) in enumerate(lanes):
            total[i] += loss[j]
            for k in range(per):
                found[i][1][g * per + k] = moves[k][j] * len(z) / self.share[g]
        return [(float(t), moved) for t, (_, moved) in zip(total, found)]


def _forward(params: list[np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list]:
    """MLP.forward of many networks, (networks, rows, columns)."""
    kept, layers = [], len(params) // 2
    with np.errstate(over="ignore"):
        for i in range(layers):
            z = x @ params[2 * i]
            z += params[2 * i + 1][:, None]
            if i == layers - 1:
                kept.append((x, None))
                return z, kept
            s = np.negative(z)
            np.exp(s, out=s)
            s += 1
            np.reciprocal(s, out=s)
            z *= s
            slope = 1 - s
            slope *= z
            slope += s
            kept.append((x, slope))
            x = z


def _backward(params: list[np.ndarray], kept: list, g: np.ndarray, into: list[np.ndarray]) -> None:
    """MLP.backward of many networks, in the order of params, written to `into`."""
    for i in range(len(kept) - 1, -1, -1):
        x, slope = kept[i]
        if slope is not None:
            g *= slope
        np.matmul(np.ones((1, g.shape[1]), g.dtype), g, out=into[2 * i + 1][:, None])  # sums over rows
        np.matmul(np.swapaxes(x, 1, 2), g, out=into[2 * i])
        if i:
            g = g @ np.swapaxes(params[2 * i], 1, 2)


@dataclass
class GroupNet:
    """A fitted group's network. It answers in single precision, `AT_ONCE` rows at a time, so that a layer's values stay in a core's cache."""

    net: MLP
    mean: np.ndarray
    std: np.ndarray
    inputs: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        k, out = self.inputs, np.empty((len(x), len(self.mean) - self.inputs))
        single = MLP.of([p.astype(np.float32) for p in self.net.params()])
        for lo in range(0, len(x), AT_ONCE):
            some = (x[lo : lo + AT_ONCE] - self.mean[:k]) / self.std[:k]
            out[lo : lo + AT_ONCE] = single.forward(some.astype(np.float32))[0]
        out *= self.std[k:]
        out += self.mean[k:]
        return out


def _networks(rows: DataFrame, xs: list[str], ys: list[str], groups: list[int], params: dict) -> dict:
    p = {"hidden": (64, 64), "epochs": 2, "batches": 10, "rate": 0.1, "seed": 0} | params
    place = F.element_at(F.create_map(*[F.lit(v) for k, g in enumerate(groups) for v in (g, k)]), F.col("g")).cast("double")
    table = TrainingTable.build(rows.withColumn("place", place), "id", ["place", *xs, *ys], p["batches"], least=4096, block_rows=4096)
    width, n = len(xs) + len(ys), len(groups)
    top = np.abs(np.stack(table.scale()))[:, 1:]
    unit = 2.0 ** np.ceil(np.log2(top.sum(0)))
    count, s, _ = table.sums(_GroupMoments(n, np.zeros((n, width)), unit))[0]
    mean = s / np.maximum(count, 1)
    q = table.sums(_GroupMoments(n, mean, unit))[0][2]
    mean, std = mean * unit, np.sqrt(q / np.maximum(count, 1)) * unit + 1e-6
    nets = [MLP([len(xs), *p["hidden"], len(ys)], p["seed"]) for _ in groups]
    weights = [w for net in nets for w in net.params()]
    share = np.maximum(count[:, 0], 1) / max(table.rows, 1)
    for epoch in range(p["epochs"]):
        for k, batch in enumerate(generator(p["seed"], epoch).permutation(table.batches)):
            left = 1 - (epoch * table.batches + k) / (p["epochs"] * table.batches)
            step = Step(LocalSteps(n, len(xs), mean, std, share, p["rate"] * left), weights)
            out = table.sums(step, (p["seed"], epoch), int(batch) if table.batches > 1 else None)
            for w, moved in zip(weights, out[1:]):
                w -= moved / out[0][0]
    table.drop()
    return {g: GroupNet(net, mean[k], std[k], len(xs)) for k, (g, net) in enumerate(zip(groups, nets))}
