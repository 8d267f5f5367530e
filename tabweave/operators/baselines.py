"""Baseline generators under one interface: Gaussian copula, Gaussian-multinomial diffusion, score-based SDE, Langevin
sampling of a class-wise energy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

from tabweave.functions.rand import generator
from tabweave.operators.fields import MLP, ResNet, bounded_matrix, time_features
from tabweave.operators.process import betas
from tabweave.operators.solvers import NOISE_BLOCK, Solver, keyed_normals
from tabweave.operators.training import descend


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    import math

    return 0.5 * (1 + np.vectorize(math.erf)(x / math.sqrt(2)))


def _normal_quantile(p: np.ndarray) -> np.ndarray:
    """By bisection on the distribution function over a table, then linear interpolation."""
    grid = np.linspace(-6, 6, 4001)
    return np.interp(p, _normal_cdf(grid), grid)


def snap_to(values: np.ndarray, support: np.ndarray) -> np.ndarray:
    """The nearest support value of each; of two as near the lower one."""
    support = np.unique(support)
    right = np.clip(np.searchsorted(support, values), 1, len(support) - 1) if len(support) > 1 else np.zeros(len(values), int)
    if len(support) == 1:
        return np.full(len(values), support[0])
    low, high = support[right - 1], support[right]
    return np.where(values - low <= high - values, low, high)


@dataclass
class CopulaBaseline(Solver):
    """Marginals by quantiles, dependence by the correlation of normal scores; discrete columns snap to seen values.

    Quantiles, scores and supports are taken over all rows: quantiles by a sketch (places right to 1 in 20,000 rows, the
    ends exact), then one pass that adds up the scores'
    products (a value's score is that of its place among the quantiles), and the distinct values of discrete columns,
    of which more than `most_values` are refused.
    """

    cols: list[str]
    discrete: list[str] = field(default_factory=list)
    most_values: int = 10_000
    quantiles: np.ndarray | None = None
    root: np.ndarray | None = None
    supports: dict[str, np.ndarray] = field(default_factory=dict)

    def fit(self, df, id_col: str) -> CopulaBaseline:
        from pyspark.sql import functions as F

        rows = df.select(*[F.col(c).cast("double").alias(c) for c in self.cols]).dropna()
        levels = np.linspace(0, 1, 201)
        found = rows.agg(*[f for c in self.cols for f in (F.min(c), F.percentile_approx(c, levels[1:-1].tolist(), 20_000), F.max(c))]).collect()[0]
        if found[0] is None:
            raise ValueError("no row without missing values to fit")
        self.quantiles = np.array([[found[3 * j], *found[3 * j + 1], found[3 * j + 2]] for j in range(len(self.cols))], float).T
        middle = self._places(self.quantiles)
        edges = [np.unique(self.quantiles[:, j]) for j in range(len(self.cols))]

        def sums(batches):
            total, n = np.zeros((len(self.cols) + 1,) * 2), 0
            for batch in batches:
                x = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in self.cols], 1)
                z = np.stack([np.interp(x[:, j], edges[j], middle[j]) for j in range(len(self.cols))], 1)
                z = np.concatenate([z, np.ones((len(z), 1))], 1)
                total, n = total + z.T @ z, n + len(z)
            if n:
                yield pa.RecordBatch.from_pydict({"i": pa.array(range(total.size), pa.int32()), "v": pa.array(total.ravel())})

        parts = rows.mapInArrow(sums, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # columns squared
        d = len(self.cols)
        m = np.array([r["v"] for r in parts]).reshape(d + 1, d + 1) if parts else np.eye(d + 1)
        m = m / max(m[d, d], 1)
        c = m[:d, :d] - np.outer(m[:d, d], m[:d, d])
        scale = np.sqrt(np.maximum(np.diag(c), 1e-12))
        c = c / scale[:, None] / scale
        w, u = np.linalg.eigh(c + 1e-9 * np.eye(d))
        self.root = u * np.sqrt(np.maximum(w, 0))
        for name in (x for x in self.cols if x in self.discrete):
            seen = [r[0] for r in rows.select(name).distinct().limit(self.most_values + 1).collect()]
            if len(seen) > self.most_values:
                raise ValueError(f"{name} has more than {self.most_values} values")
            self.supports[name] = np.array(sorted(seen))
        return self

    @staticmethod
    def _places(quantiles: np.ndarray) -> list[np.ndarray]:
        """The normal score of each distinct quantile: of its middle level."""
        levels, out = np.linspace(0, 1, len(quantiles)), []
        for j in range(quantiles.shape[1]):
            _, back, times = np.unique(quantiles[:, j], return_inverse=True, return_counts=True)
            mid = np.bincount(back, weights=levels) / times
            out.append(_normal_quantile(np.clip(mid, 0.0025, 0.9975)))
        return out

    def generate(self, ids: np.ndarray, seed: int) -> np.ndarray:
        z = keyed_normals(ids, seed, (len(self.cols),)) @ self.root.T
        u = _normal_cdf(z)
        at = np.linspace(0, 1, len(self.quantiles))
        out = np.stack([np.interp(u[:, j], at, self.quantiles[:, j]) for j in range(len(self.cols))], 1)
        for j, c in enumerate(self.cols):
            if c in self.supports:
                out[:, j] = snap_to(out[:, j], self.supports[c])
        return out


@dataclass
class DiffusionBaseline(Solver):
    """Gaussian diffusion for numeric columns and multinomial diffusion for categorical codes, by one denoiser that
    predicts the noise and the logits of the start; ancestral or deterministic sampling. The denoiser is an MLP or a
    residual network (`denoiser`), trained over all rows at a rate that falls linearly to 0; sampling uses the averaged weights."""

    cols: list[str]
    states: dict[str, int] = field(default_factory=dict)
    schedule: str = "cosine"
    steps: int = 50
    inner: int = 1500
    deterministic: bool = False
    hidden: tuple[int, ...] = (128, 128)
    seed: int = 0
    denoiser: str = "mlp"
    average: float = 0.999
    net: MLP | None = None

    @property
    def numeric(self) -> list[str]:
        return [c for c in self.cols if c not in self.states]

    @property
    def cats(self) -> list[str]:
        return [c for c in self.cols if c in self.states]

    def _inputs(self, num, hot, t) -> np.ndarray:
        return np.concatenate([num, *hot, time_features(t / self.steps, 16)], 1)

    @staticmethod
    def _draw(p: np.ndarray, rng) -> np.ndarray:
        return (np.cumsum(p, 1) < rng.uniform(size=(len(p), 1))).sum(1).clip(0, p.shape[1] - 1)

    def fit(self, df, id_col: str) -> DiffusionBaseline:
        width = len(self.numeric) + sum(self.states.values())
        if self.denoiser not in ("mlp", "resnet"):
            raise ValueError(f"no denoiser {self.denoiser}")
        net = MLP([width + 16, *self.hidden, width], self.seed) if self.denoiser == "mlp" else ResNet(width + 16, self.hidden[0], len(self.hidden), width, self.seed)
        descend(df, id_col, [*self.numeric, *self.cats], net, self._noised, self._gradient, self.inner, seed=self.seed, average=self.average, anneal=True)
        self.net = net
        return self

    def _noised(self, x: np.ndarray, rng, progress: float) -> tuple[np.ndarray, tuple]:
        """Rows at drawn times of the diffusion, and what the denoiser is to find: the noise and the codes."""
        dn = len(self.numeric)
        num, cat = x[:, :dn], x[:, dn:].astype(int)
        t = rng.integers(0, self.steps, len(x))
        e, a = rng.normal(size=num.shape), np.cumprod(1 - betas(self.schedule, self.steps))[t][:, None]
        hot = []
        for j, c in enumerate(self.cats):
            p = a * np.eye(self.states[c])[cat[:, j]] + (1 - a) / self.states[c]
            hot.append(np.eye(self.states[c])[self._draw(p, rng)])
        return self._inputs(np.sqrt(a) * num + np.sqrt(1 - a) * e, hot, t), (e, cat)

    def _gradient(self, out: np.ndarray, extra: tuple) -> np.ndarray:
        e, codes = extra
        g, dn = np.zeros_like(out), len(self.numeric)
        if dn:
            g[:, :dn] = 2 * (out[:, :dn] - e) / e.size
        at = dn
        for j, c in enumerate(self.cats):
            s = self.states[c]
            q = np.exp(out[:, at : at + s] - out[:, at : at + s].max(1, keepdims=True))
            g[:, at : at + s] = (q / q.sum(1, keepdims=True) - np.eye(s)[codes[:, j]]) / (len(out) * len(self.cats))
            at += s
        return g

    def _block(self, rng) -> np.ndarray:
        n, dn = NOISE_BLOCK, len(self.numeric)
        beta = betas(self.schedule, self.steps)
        bar = np.cumprod(1 - beta)
        num, cat = rng.normal(size=(n, dn)), [rng.integers(0, self.states[c], n) for c in self.cats]
        for t in range(self.steps - 1, -1, -1):
            out, _ = self.net.forward(self._inputs(num, [np.eye(self.states[c])[k] for c, k in zip(self.cats, cat)], np.full(n, t)))
            before = bar[t - 1] if t else 1.0
            start = np.clip((num - np.sqrt(1 - bar[t]) * out[:, :dn]) / np.sqrt(bar[t]), -6, 6)
            if self.deterministic:
                e = (num - np.sqrt(bar[t]) * start) / np.sqrt(1 - bar[t])
                num = np.sqrt(before) * start + np.sqrt(1 - before) * e
            else:
                mean = np.sqrt(before) * beta[t] / (1 - bar[t]) * start + np.sqrt(1 - beta[t]) * (1 - before) / (1 - bar[t]) * num
                num = mean + np.sqrt(beta[t] * (1 - before) / (1 - bar[t])) * rng.normal(size=num.shape)
            at = dn
            for j, c in enumerate(self.cats):
                s = self.states[c]
                q = np.exp(out[:, at : at + s] - out[:, at : at + s].max(1, keepdims=True))
                x0 = q / q.sum(1, keepdims=True)
                now = (1 - beta[t]) * np.eye(s)[cat[j]] + beta[t] / s
                p = now * (before * x0 + (1 - before) / s)
                cat[j] = self._draw(p / p.sum(1, keepdims=True), rng)
                at += s
        return np.stack([num[:, self.numeric.index(c)] if c in self.numeric else cat[self.cats.index(c)].astype(float) for c in self.cols], 1)

    def generate(self, ids: np.ndarray, seed: int) -> np.ndarray:
        out, block = np.zeros((len(ids), len(self.cols))), ids // NOISE_BLOCK
        for b in np.unique(block):
            own = block == b
            out[own] = self._block(generator(seed, int(b)))[ids[own] % NOISE_BLOCK]
        return out


@dataclass
class ScoreBaseline(Solver):
    """Variance-exploding SDE with a self-paced time range, predictor-corrector sampling and a last denoising step; trained over all
    rows."""

    cols: list[str]
    low: float = 0.02
    high: float = 8.0
    inner: int = 1500
    steps: int = 60
    corrector: float = 0.1
    hidden: tuple[int, ...] = (128, 128)
    seed: int = 0
    net: MLP | None = None

    def _sigma(self, t: np.ndarray) -> np.ndarray:
        return self.low * (self.high / self.low) ** t

    def _score(self, x: np.ndarray, t: np.ndarray) -> np.ndarray:
        s = self._sigma(t)[:, None]
        return -self.net.forward(np.concatenate([x / np.sqrt(1 + s**2), np.log(s), time_features(t, 8)], 1))[0] / s

    def fit(self, df, id_col: str) -> ScoreBaseline:
        d = len(self.cols)
        net = MLP([d + 9, *self.hidden, d], self.seed)
        descend(df, id_col, self.cols, net, self._noised, self._gradient, self.inner, seed=self.seed)
        self.net = net
        return self

    def _noised(self, x: np.ndarray, rng, progress: float) -> tuple[np.ndarray, np.ndarray]:
        most = min(1.0, 0.3 + 2 * progress)  # easy times first
        t, e = rng.uniform(0, most, len(x)), rng.normal(size=x.shape)
        s = self._sigma(t)[:, None]
        x = x + s * e
        return np.concatenate([x / np.sqrt(1 + s**2), np.log(s), time_features(t, 8)], 1), e

    @staticmethod
    def _gradient(out: np.ndarray, e: np.ndarray) -> np.ndarray:
        return 2 * (out - e) / out.size

    def generate(self, ids: np.ndarray, seed: int) -> np.ndarray:
        z = keyed_normals(ids, seed, (2 * self.steps + 1, len(self.cols)))
        times = np.linspace(1, 0, self.steps + 1)
        x = self.high * z[:, 0]
        for i, (t, nxt) in enumerate(zip(times, times[1:])):
            tt = np.full(len(x), t)
            gap = self._sigma(tt[:1])[0] ** 2 - self._sigma(np.array([nxt]))[0] ** 2
            x = x + gap * self._score(x, tt) + np.sqrt(gap) * z[:, 2 * i + 1] * (i < self.steps - 1)
            if i < self.steps - 1:
                tn = np.full(len(x), nxt)
                e = 2 * (self.corrector * self._sigma(tn[:1])[0]) ** 2
                x = x + e / 2 * self._score(x, tn) + np.sqrt(e) * z[:, 2 * i + 2] * 0.5
        end = np.zeros(len(x))
        return x + self._sigma(end[:1])[0] ** 2 * self._score(x, end)


@dataclass
class LangevinBaseline(Solver):
    """Stochastic gradient Langevin dynamics over the energy of rows given their target, from noised real rows.

    The energy is that of a kernel density over the context rows of the same class; it stands where a pretrained
    in-context classifier would. A regression target (see `schema.detect_task`) moves with the features, a class is drawn
    by its share and stays. The context is a hashed sample of at most about `train_rows` rows; a table without complete
    rows is refused. A context of one row gives rows around it."""

    cols: list[str]
    target: str | None = None
    task: str = "regression"
    steps: int = 60
    step: float = 0.1
    width: float = 0.25
    start_noise: float = 0.3
    train_rows: int = 2000
    seed: int = 0
    context: np.ndarray | None = None

    def fit(self, df, id_col: str) -> LangevinBaseline:
        self.context = bounded_matrix(df, id_col, self.cols, self.train_rows, self.seed)
        if not len(self.context):
            raise ValueError("no row without missing values to fit")
        return self

    def score(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Gradient of the log density of x under kernels at the rows `own`, whose columns have spread 1."""
        h = self.width**2
        d = -((x**2).sum(1)[:, None] - 2 * x @ own.T + (own**2).sum(1)) / (2 * h)
        w = np.exp(d - d.max(1, keepdims=True))
        return (w / w.sum(1, keepdims=True) @ own - x) / h

    def generate(self, ids: np.ndarray, seed: int) -> np.ndarray:
        out, block = np.zeros((len(ids), len(self.cols))), ids // NOISE_BLOCK
        for b in np.unique(block):  # whole blocks, as a product's last bits depend on its number of rows
            own = block == b
            out[own] = self._block(np.arange(b * NOISE_BLOCK, (b + 1) * NOISE_BLOCK), seed)[ids[own] % NOISE_BLOCK]
        return out

    def _block(self, ids: np.ndarray, seed: int) -> np.ndarray:
        fixed = self.cols.index(self.target) if self.target and self.task == "classification" else None
        moving = [j for j in range(len(self.cols)) if j != fixed]
        shift, spread = self.context[:, moving].mean(0), self.context[:, moving].std(0) + 1e-9
        rows = (self.context[:, moving] - shift) / spread
        group = self.context[:, fixed] if fixed is not None else np.zeros(len(rows))
        z = keyed_normals(ids, seed, (self.steps + 2, len(moving)))
        first = np.minimum((_normal_cdf(z[:, -1, 0]) * len(rows)).astype(int), len(rows) - 1)
        x, e = rows[first] + self.start_noise * z[:, 0], self.step * self.width**2
        for g in np.unique(group[first]):
            mine, own = group[first] == g, rows[group == g]
            for i in range(self.steps):
                x[mine] += e / 2 * self.score(x[mine], own) + np.sqrt(e) * z[mine, i + 1]
        out = np.empty((len(ids), len(self.cols)))
        out[:, moving] = x * spread + shift
        if fixed is not None:
            out[:, fixed] = group[first]
        return out
