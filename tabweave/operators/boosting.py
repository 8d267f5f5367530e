"""Gradient-boosted trees over all rows: level-wise growth from sums of (node, feature, bin).

Rows are stored once as bin codes (a byte each) and residuals in whole steps of 2**-22 of the largest one, so that every sum is exact and a
tree doesn't depend on how rows are partitioned. Each level of a tree is one aggregate: a task counts its blocks' rows and
sums their residuals by node, feature and bin, the sums (nodes * features * bins values, whatever the number of rows) are added, and the
driver chooses the splits of all outputs. Residuals are brought up to date in the tasks and written anew every few trees.

Cuts are exact quantiles of all rows: all ranks of all columns are narrowed together, a byte of the number's ordered bits
at a time, from counts of fixed size.

A table of at most `memory` bytes is fitted by the same code in one task, and one of few cells of bins from the sums of its cells, which
saves jobs and changes no tree.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tabweave.operators.fields import TreeField
from tabweave.operators.training import TrainingTable
from tabweave.sources.readers import scratch_path

STEPS = 2.0**22
#: Where there are so many cells of bins at most, trees of any number of rows grow from one aggregate.
MOST_CELLS = 256
CODED = "block bigint, part int, n bigint, codes binary, res binary"


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order."""
    b = (np.ascontiguousarray(x, float) + 0.0).view(np.int64)
    return np.where(b < 0, ~b, b ^ np.int64(-(2**63))).view(np.uint64)


def from_ordered_bits(u: np.ndarray) -> np.ndarray:
    b = u.view(np.int64)
    return np.where(b < 0, b ^ np.int64(-(2**63)), ~b).view(float)


@dataclass
class _Narrow:
    """Counts of the next byte among rows that share each wanted prefix: (columns, ranks, 256)."""

    prefixes: np.ndarray
    byte: int

    def __call__(self, x: np.ndarray, rng) -> list[np.ndarray]:
        d, ranks = self.prefixes.shape
        out = np.zeros((d, ranks, 256))
        down = np.uint64(56 - 8 * self.byte)
        for j in range(d):
            top = ordered_bits(x[:, j]) >> down
            head, low = top >> np.uint64(8), (top & np.uint64(255)).astype(np.int64)
            wanted, place = np.unique(self.prefixes[j], return_inverse=True)
            at = np.searchsorted(wanted, head).clip(0, len(wanted) - 1)
            hit = wanted[at] == head
            counts = np.bincount(at[hit] * 256 + low[hit], minlength=256 * len(wanted)).reshape(-1, 256)
            out[j] = counts[place]
        return [out]


def order_statistics(table: TrainingTable, columns: int, ranks: np.ndarray) -> np.ndarray:
    """The values of these ranks (from 0) in each of the first columns, exactly: (columns, ranks). Eight jobs."""
    left = np.repeat(ranks[None].astype(np.int64), columns, 0)
    prefixes = np.zeros((columns, len(ranks)), np.uint64)
    for byte in range(8):
        counts = np.rint(table.sums(_First(columns, _Narrow(prefixes, byte)))[0]).astype(np.int64)
        running = np.cumsum(counts, 2)
        chosen = (running <= left[:, :, None]).sum(2)
        before = np.take_along_axis(np.concatenate([np.zeros_like(running[:, :, :1]), running], 2), chosen[:, :, None], 2)[:, :, 0]
        left -= before
        prefixes = prefixes << np.uint64(8) | chosen.astype(np.uint64)
    return from_ordered_bits(prefixes)


@dataclass
class _First:
    columns: int
    work: Callable

    def __call__(self, x: np.ndarray, rng) -> list[np.ndarray]:
        return self.work(x[:, : self.columns], rng)


def exact_cuts(table: TrainingTable, columns: int, bins: int) -> list[np.ndarray]:
    """Distinct quantiles between the bins of each column, by linear interpolation between order statistics."""
    q = np.linspace(0, 1, bins)[1:-1] * (table.rows - 1)
    low = np.floor(q).astype(np.int64)
    ranks = np.unique(np.concatenate([low, np.minimum(low + 1, table.rows - 1)]))
    values = order_statistics(table, columns, ranks)
    at = lambda r: values[:, np.searchsorted(ranks, r)]
    a, b, t = at(low), at(np.minimum(low + 1, table.rows - 1)), q - low
    # numpy's own form of the interpolation, so that equal data give equal cuts
    mixed = np.where(t < 0.5, a + (b - a) * t, b - (b - a) * (1 - t))
    return [np.unique(row) for row in mixed]


class Grown:
    """A tree of one output while it grows, as a heap: feature and last left bin of each split, or a leaf's value."""

    def __init__(self, depth: int):
        self.feature = np.full(2 ** (depth + 1), -1)
        self.bin = np.zeros(2 ** (depth + 1), np.int64)
        self.leaf = np.zeros(2 ** (depth + 1))

    def places(self, codes: np.ndarray, level: int) -> np.ndarray:
        """The node of each row, after at most `level` splits."""
        at = np.ones(len(codes), np.int64)
        for _ in range(level):
            at = self.below(codes, at)
        return at

    def below(self, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The nodes of rows a level below the nodes `at`; a leaf stays."""
        f = self.feature[at]
        return np.where(f >= 0, 2 * at + (codes[np.arange(len(codes)), f] > self.bin[at]), at)

    def nested(self, at: int = 1):
        if self.feature[at] < 0:
            return float(self.leaf[at])
        return [int(self.feature[at]), int(self.bin[at]), self.nested(2 * at), self.nested(2 * at + 1)]


def histograms(trees: list[Grown], level: int, codes: np.ndarray, res: np.ndarray, bins: int, n: np.ndarray | None = None, at: list[np.ndarray] | None = None) -> np.ndarray:
    """(outputs, 2, nodes of this level, features, bins): rows, and their residuals in whole steps. n: codes are of cells of so many rows
    each, and res are their sums. at: the nodes of rows in each tree, where they are known."""
    d, first = codes.shape[1], 2**level
    out = np.zeros((len(trees), 2, first, d, bins))
    for o, tree in enumerate(trees):
        node = (tree.places(codes, level) if at is None else at[o]) - first
        live = node >= 0
        some, left = (codes, res[:, o]) if live.all() else (codes[live], res[live, o])
        many = n if n is None or len(some) == len(codes) else n[live]
        base, left = (node if len(some) == len(codes) else node[live]) * bins, left.astype(float)
        for j in range(d):
            key = base + some[:, j]
            out[o, 0, :, j] = np.bincount(key, weights=many, minlength=first * bins).reshape(first, bins)
            out[o, 1, :, j] = np.bincount(key, weights=left, minlength=first * bins).reshape(first, bins)
    return out


@dataclass
class WholeTrees(TreeField):
    """TreeField over all rows of a table. bins: at most 256."""

    memory: int = 64_000_000
    settle: int = 8
    unit: np.ndarray | None = None
    jobs: int = field(default=0, repr=False)
    answers: np.ndarray | None = field(default=None, repr=False)

    def fit(self, df: DataFrame, id_col: str, x_cols: list[str], y_cols: list[str]) -> WholeTrees:
        table = TrainingTable.build(df, id_col, [*x_cols, *y_cols], batches=1)
        self.fit_table(table, len(x_cols))
        table.drop()
        return self

    def fit_table(self, table: TrainingTable, features: int) -> WholeTrees:
        if not 2 <= self.bins <= 256:
            raise ValueError("a code is one byte")
        outputs = len(table.cols) - features
        self.model, self.jobs = [[] for _ in range(outputs)], 0
        if not table.rows:
            self.cuts, self.base = [np.zeros(0)] * features, np.zeros(outputs)
            return self
        if table.rows * len(table.cols) * 8 <= self.memory:
            found = table.blocks.select("block", "part", "x").orderBy("block", "part").coalesce(1).mapInArrow(_InOneTask(self, features, len(table.cols)), "fitted binary").collect()
            self.cuts, self.base, self.unit, self.model = pickle.loads(bytes(found[0][0]))
            return self
        self.cuts = exact_cuts(table, features, self.bins)
        self.base = _steady(table.scale()[0][features:], np.abs(order_statistics(table, len(table.cols), np.array([0, table.rows - 1]))[features:]).max(1))
        far = table.blocks.select("x").mapInArrow(_Farthest(len(table.cols), features, self.base), "top array<double>").selectExpr(*[f"max(top[{j}])" for j in range(outputs)]).collect()[0]
        self.unit = np.array([2.0 ** np.ceil(np.log2(t)) if t > 0 else 1.0 for t in far])
        if self.cells() <= MOST_CELLS:
            return self._fit_sums(*table.sums(_InCells(self, features)))
        self._fit_in_jobs(self._coded(table, features), features, outputs)
        return self

    def fit_rows(self, x: np.ndarray, y: np.ndarray) -> WholeTrees:
        """The same trees from rows in memory."""
        y = y.reshape(len(x), -1)
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        self.base = _steady(y.mean(0), np.abs(y).max(0))
        far = np.abs(y - self.base).max(0)
        self.unit = np.array([2.0 ** np.ceil(np.log2(t)) if t > 0 else 1.0 for t in far])
        if self.cells() <= MOST_CELLS:
            return self._fit_sums(*_InCells(self, x.shape[1])(np.concatenate([x, y], 1), None))
        self.model = self._fit_here(self._codes(x).astype(np.uint8), np.rint((y - self.base) / self.unit * STEPS).astype(np.int64))
        return self

    def _fit_sums(self, n: np.ndarray, res: np.ndarray) -> WholeTrees:
        seen = np.flatnonzero(n)
        codes = np.stack(np.unravel_index(seen, [len(c) + 1 for c in self.cuts]), 1).astype(np.uint8)
        return self.fit_cells(codes, np.rint(n[seen]).astype(np.int64), np.rint(res[seen] * STEPS).astype(np.int64))

    def fit_cells(self, codes: np.ndarray, n: np.ndarray, res: np.ndarray) -> WholeTrees:
        """The same trees from cells of equal codes: their rows and sums of residuals in whole steps of the fitted unit, off the base."""
        self.model = self._fit_here(codes, res, n)
        return self

    def cells(self) -> int:
        return int(np.prod([len(c) + 1.0 for c in self.cuts]))

    def tabulate(self) -> None:
        """Keeps the answer of every cell of bins. A leaf is a box of cells, so a tree costs one addition a cell."""
        shape = [len(c) + 1 for c in self.cuts]
        total = np.zeros((len(self.model), *shape))

        def add(box: np.ndarray, tree, low: list[int]) -> None:
            if not isinstance(tree, list):
                box += tree
                return
            j, k, a, b = tree
            cut = min(max(k + 1 - low[j], 0), box.shape[j])
            at = (slice(None),) * j
            add(box[(*at, slice(cut))], a, low)
            add(box[(*at, slice(cut, None))], b, [x + cut * (i == j) for i, x in enumerate(low)])

        for box, own in zip(total, self.model):
            for tree in own:
                add(box, tree, [0] * len(shape))
        self.answers = np.ascontiguousarray((self.base[:, None] + self.rate * total.reshape(len(total), -1)).T)

    def _answers(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([self.base[d] + self.rate * sum((self._value(t, codes) for t in own), np.zeros(len(codes))) for d, own in enumerate(self.model)], axis=1)

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = self._codes(x)
        if self.answers is None:
            return self._answers(codes)
        return self.answers[np.ravel_multi_index(tuple(codes.T), [len(c) + 1 for c in self.cuts])]

    # what is stored

    def _coded(self, table: TrainingTable, features: int) -> DataFrame:
        cuts, base, unit, d = self.cuts, self.base, self.unit, len(table.cols)

        def code(batches):
            for b in batches:
                codes, res = [], []
                for raw in b.column("x").to_pylist():
                    x = np.frombuffer(raw).reshape(-1, d)
                    codes.append(np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)], 1).astype(np.uint8).tobytes())
                    res.append(np.rint((x[:, features:] - base) / unit * STEPS).astype(np.int64).tobytes())
                yield pa.RecordBatch.from_pydict({"block": b.column("block"), "part": b.column("part"), "n": b.column("n"), "codes": pa.array(codes, pa.binary()), "res": pa.array(res, pa.binary())})

        return _stored(table.blocks.select("block", "part", "n", "x").mapInArrow(code, CODED), "codes")

    def _moved(self, trees: list[Grown], codes: np.ndarray, res: np.ndarray, n: np.ndarray | None = None) -> np.ndarray:
        """Residuals after a round of trees, one of each output."""
        steps = [np.rint(self.rate * t.leaf / u * STEPS).astype(np.int64) for t, u in zip(trees, self.unit)]
        return res - np.stack([s[t.places(codes, self.depth)] for s, t in zip(steps, trees)], 1) * (1 if n is None else n[:, None])

    # growth

    def _round(self, sums: Callable[[list[Grown], int], np.ndarray], outputs: int) -> list[Grown]:
        """A tree of each output. sums(trees, level) gives the histograms of all rows."""
        trees = [Grown(self.depth) for _ in range(outputs)]
        open_nodes = {(o, 1) for o in range(outputs)}
        for level in range(self.depth + 1):
            if not open_nodes:
                break
            found, after = sums(trees, level), set()
            for o, at in sorted(open_nodes):
                n, s = found[o, 0, at - 2**level], found[o, 1, at - 2**level] * (self.unit[o] / STEPS)
                if not self._split(trees[o], at, n, s, level):
                    trees[o].leaf[at] = s[0].sum() / (n[0].sum() + 1)
                else:
                    after |= {(o, 2 * at), (o, 2 * at + 1)}
            open_nodes = after
        return trees

    def _split(self, tree: Grown, at: int, n: np.ndarray, s: np.ndarray, level: int) -> bool:
        """Chooses the split of largest gain of a node; n, s: (features, bins)."""
        rows, total = n[0].sum(), s[0].sum()
        if level == self.depth or rows < 2 * self.least:
            return False
        best = 1e-12
        for j in range(len(n)):
            m, left = np.cumsum(n[j])[:-1], np.cumsum(s[j])[:-1]
            fit = (m >= self.least) & (rows - m >= self.least)
            if not fit.any():
                continue
            gain = np.where(fit, left**2 / (m + 1) + (total - left) ** 2 / (rows - m + 1) - total**2 / (rows + 1), -1)
            k = int(gain.argmax())
            if gain[k] > best:
                best, tree.feature[at], tree.bin[at] = float(gain[k]), j, k
        return tree.feature[at] >= 0

    def _fit_here(self, codes: np.ndarray, res: np.ndarray, n: np.ndarray | None = None) -> list[list]:
        model = [[] for _ in range(res.shape[1])]
        at: list[np.ndarray] = []

        def sums(trees: list[Grown], level: int) -> np.ndarray:
            at[:] = [t.below(codes, a) for t, a in zip(trees, at)] if level else [np.ones(len(codes), np.int64)] * len(trees)
            # leaves take sums alone, which every feature gives
            return histograms(trees, level, codes if level < self.depth else codes[:, :1], res, self.bins, n, at)

        for _ in range(self.trees):
            grown = self._round(sums, res.shape[1])
            res = self._moved(grown, codes, res, n)
            for own, tree in zip(model, grown):
                own.append(tree.nested())
        return model

    def _fit_in_jobs(self, coded: DataFrame, features: int, outputs: int) -> None:
        coded_table = TrainingTable(coded, ["x"], 0, 1)
        pending: list[list[Grown]] = []
        for k in range(self.trees):

            def sums(trees, level):
                self.jobs += 1
                return coded_table.sums_of(("codes", "res"), _Level(self, trees, level, list(pending), features, outputs))[0]

            grown = self._round(sums, outputs)
            pending.append(grown)
            for own, tree in zip(self.model, grown):
                own.append(tree.nested())
            if len(pending) == self.settle and k + 1 < self.trees:
                last = coded_table.blocks
                coded_table = TrainingTable(_stored(last.mapInArrow(_Settled(self, pending, features, outputs), CODED), "codes"), ["x"], 0, 1)
                pending = []


def _steady(mean: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Means in steps of 2**-30 of the largest value, which the order of a sum doesn't change."""
    unit = np.array([2.0 ** np.ceil(np.log2(t)) if t > 0 else 1.0 for t in top])
    return np.rint(mean / unit * 2.0**30) / 2.0**30 * unit


def _stored(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class _Farthest:
    width: int
    features: int
    base: np.ndarray

    def __call__(self, batches):
        for b in batches:
            tops = [np.abs(np.frombuffer(raw).reshape(-1, self.width)[:, self.features :] - self.base).max(0).tolist() for raw in b.column("x").to_pylist()]
            yield pa.RecordBatch.from_pydict({"top": pa.array(tops, pa.list_(pa.float64()))})


def _arrays(codes: bytes, res: bytes, features: int, outputs: int) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(codes, np.uint8).reshape(-1, features), np.frombuffer(res, np.int64).reshape(-1, outputs)


@dataclass
class _InCells:
    """Rows of a block by cell of bins, and sums of their residuals in units."""

    trees: WholeTrees
    features: int

    def __call__(self, x: np.ndarray, rng) -> list[np.ndarray]:
        own, shape = self.trees, [len(c) + 1 for c in self.trees.cuts]
        place = np.ravel_multi_index(tuple(own._codes(x[:, : self.features]).T), shape)
        res = np.rint((x[:, self.features :] - own.base) / own.unit * STEPS)
        cells = int(np.prod(shape))
        return [np.bincount(place, minlength=cells), np.stack([np.bincount(place, r, cells) for r in res.T], 1) / STEPS]


@dataclass
class _InOneTask:
    trees: WholeTrees
    features: int
    width: int

    def __call__(self, batches):
        x = np.concatenate([np.frombuffer(raw).reshape(-1, self.width) for b in batches for raw in b.column("x").to_pylist()])
        own = self.trees.fit_rows(x[:, : self.features], x[:, self.features :])
        yield pa.RecordBatch.from_pydict({"fitted": pa.array([pickle.dumps((own.cuts, own.base, own.unit, own.model))], pa.binary())})


@dataclass
class _Level:
    """The histograms of a block at one level, after the rounds that aren't settled yet."""

    trees: WholeTrees
    growing: list[Grown]
    level: int
    pending: list[list[Grown]]
    features: int
    outputs: int

    def __call__(self, codes: bytes, res: bytes) -> list[np.ndarray]:
        c, r = _arrays(codes, res, self.features, self.outputs)
        for done in self.pending:
            r = self.trees._moved(done, c, r)
        return [histograms(self.growing, self.level, c, r, self.trees.bins)]


@dataclass
class _Settled:
    trees: WholeTrees
    pending: list[list[Grown]]
    features: int
    outputs: int

    def __call__(self, batches):
        for b in batches:
            out = []
            for codes, res in zip(b.column("codes").to_pylist(), b.column("res").to_pylist()):
                c, r = _arrays(codes, res, self.features, self.outputs)
                for done in self.pending:
                    r = self.trees._moved(done, c, r)
                out.append(r.tobytes())
            yield pa.RecordBatch.from_pydict({n: pa.array(out, pa.binary()) if n == "res" else b.column(n) for n in b.schema.names})
