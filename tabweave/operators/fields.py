"""Learned fields: regressors from states to drifts, in NumPy. training, boosting and stages fit them over whole tables."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def time_features(t: np.ndarray, dim: int = 16, max_period: float = 10_000.0) -> np.ndarray:
    """Sinusoidal embedding of times: cosines, then sines."""
    half = dim // 2
    f = np.exp(-np.log(max_period) * np.arange(half) / half)
    a = np.asarray(t, float).reshape(-1, 1) * f * 1000
    return np.concatenate([np.cos(a), np.sin(a)], axis=1)


@dataclass
class RidgeField:
    """Ridge regression on the inputs and random Fourier features; exact from sums of products, so it trains on any
    number of rows by adding up what each partition has."""

    features: int = 128
    scale: float = 1.0
    ridge: float = 1e-3
    seed: int = 0
    weights: np.ndarray | None = None

    def _lift(self, x: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        w = rng.normal(0, self.scale, (x.shape[1], self.features))
        b = rng.uniform(0, 2 * np.pi, self.features)
        return np.concatenate([np.ones((len(x), 1)), x, np.cos(x @ w + b)], axis=1)

    def sums(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = self._lift(x)
        return h.T @ h, h.T @ y

    def solve(self, hh: np.ndarray, hy: np.ndarray, rows: int) -> RidgeField:
        self.weights = np.linalg.solve(hh + self.ridge * max(rows, 1) * np.eye(len(hh)), hy)
        return self

    def fit(self, x: np.ndarray, y: np.ndarray) -> RidgeField:
        return self.solve(*self.sums(x, y), len(x))

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._lift(x) @ self.weights


@dataclass
class TreeField:
    """Gradient-boosted trees on quantile bins, one ensemble per output."""

    trees: int = 40
    depth: int = 4
    rate: float = 0.15
    bins: int = 32
    least: int = 8
    cuts: list[np.ndarray] = field(default_factory=list)
    base: np.ndarray | None = None
    model: list[list[list]] = field(default_factory=list)

    def _codes(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(self.cuts)], axis=1)

    def _grow(self, codes: np.ndarray, res: np.ndarray, rows: np.ndarray, depth: int):
        total, n = res[rows].sum(), len(rows)
        if depth == 0 or n < 2 * self.least:
            return float(total / (n + 1))
        best = (1e-12, None)
        for j in range(codes.shape[1]):
            c = codes[rows, j]
            s = np.cumsum(np.bincount(c, weights=res[rows], minlength=self.bins))[:-1]
            m = np.cumsum(np.bincount(c, minlength=self.bins))[:-1]
            ok = (m >= self.least) & (n - m >= self.least)
            if ok.any():
                gain = np.where(ok, s**2 / (m + 1) + (total - s) ** 2 / (n - m + 1) - total**2 / (n + 1), -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (float(gain[k]), (j, k))
        if best[1] is None:
            return float(total / (n + 1))
        j, k = best[1]
        left = codes[rows, j] <= k
        return [j, k, self._grow(codes, res, rows[left], depth - 1), self._grow(codes, res, rows[~left], depth - 1)]

    def _value(self, tree, codes: np.ndarray) -> np.ndarray:
        if not isinstance(tree, list):
            return np.full(len(codes), tree)
        j, k, a, b = tree
        out, left = np.empty(len(codes)), codes[:, j] <= k
        out[left], out[~left] = self._value(a, codes[left]), self._value(b, codes[~left])
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> TreeField:
        y = y.reshape(len(x), -1)
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins)[1:-1])) for j in range(x.shape[1])]
        codes, self.base = self._codes(x), y.mean(0)
        self.model = []
        for d in range(y.shape[1]):
            res, own = y[:, d] - self.base[d], []
            for _ in range(self.trees):
                own.append(self._grow(codes, res, np.arange(len(x)), self.depth))
                res = res - self.rate * self._value(own[-1], codes)
            self.model.append(own)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        codes = self._codes(x)
        return np.stack([self.base[d] + self.rate * sum((self._value(t, codes) for t in own), np.zeros(len(codes))) for d, own in enumerate(self.model)], axis=1)


class Adam:
    """AdamW with clipped gradients over arrays that it changes in place."""

    def __init__(self, params: list[np.ndarray], rate: float = 2e-3, decay: float = 1e-4, clip: float = 1.0, betas: tuple[float, float] = (0.9, 0.999)):
        self.params, self.rate, self.decay, self.clip, self.betas, self.steps = params, rate, decay, clip, betas, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray], share: float = 1.0) -> None:
        """One step at this share of the rate."""
        self.steps += 1
        a, b = self.betas
        norm = np.sqrt(sum((g * g).sum() for g in grads))
        for p, m, v, g in zip(self.params, self.m, self.v, grads):
            g = g * min(1.0, self.clip / (norm + 1e-12))
            # in place: the arrays are large beside a step's rows
            d = g - m
            d *= 1 - a
            m += d
            np.multiply(g, g, out=d)
            d -= v
            d *= 1 - b
            v += d
            np.divide(v, 1 - b**self.steps, out=d)
            np.sqrt(d, out=d)
            d += 1e-8
            np.divide(m, 1 - a**self.steps, out=g)
            g /= d
            np.multiply(p, self.decay, out=d)
            g += d
            g *= share * self.rate
            p -= g


class MLP:
    """SiLU layers with AdamW and clipped gradients; the loss gives the gradient at the output."""

    def __init__(self, sizes: list[int], seed: int = 0):
        rng = np.random.default_rng(seed)
        self.w = [rng.normal(0, np.sqrt(1 / a), (a, b)) for a, b in zip(sizes, sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]

    def params(self) -> list[np.ndarray]:
        """Weights and biases in the order of backward()."""
        return [p for pair in zip(self.w, self.b) for p in pair]

    @classmethod
    def of(cls, params: list[np.ndarray]) -> MLP:
        """A network over these weights."""
        net = cls.__new__(cls)
        net.w, net.b = list(params[::2]), list(params[1::2])
        return net

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        kept = []
        for i, (w, b) in enumerate(zip(self.w, self.b)):
            z = x @ w
            z += b
            if i == len(self.w) - 1:
                kept.append((x, None, None))
                return z, kept
            s = np.negative(z)  # the sigmoid, in place: the arrays are large beside what is done to them
            with np.errstate(over="ignore"):
                np.exp(s, out=s)
            s += 1
            np.divide(1, s, out=s)
            z *= s
            kept.append((x, z, s))
            x = z
        return x, kept

    def backward(self, kept: list, g: np.ndarray) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for i in range(len(self.w) - 1, -1, -1):
            x, y, s = kept[i]
            if s is not None:  # g is a product made here, so it may change in place
                slope = 1 - s
                slope *= y
                slope += s
                g *= slope
            out += [g.sum(0), x.T @ g]
            if i:  # nothing reads the gradient at the inputs
                g = g @ self.w[i].T
        return out[::-1]

    def train(self, batches, loss_gradient, rate: float = 2e-3, decay: float = 1e-4, clip: float = 1.0, anneal_over: int | None = None, average: float | None = None) -> None:
        """batches: (x, extra) pairs; loss_gradient(out, extra) gives d loss / d out. The rate falls linearly to 0 over
        `anneal_over` steps; with `average`, the weights end as their moving average of that decay (less of it early)."""
        params = self.params()
        adam, mean = Adam(params, rate, decay, clip), [p.copy() for p in params] if average else []
        for step, (x, extra) in enumerate(batches):
            out, kept = self.forward(x)
            adam.step(self.backward(kept, loss_gradient(out, extra)), max(0.0, 1 - step / anneal_over) if anneal_over else 1.0)
            for m, p in zip(mean, params):
                m += (1 - min(average, (1 + step) / (10 + step))) * (p - m)
        for m, p in zip(mean, params):
            p[:] = m


class ResNet(MLP):
    """Residual blocks of two layers on normalised rows, then a head."""

    def __init__(self, inputs: int, width: int, blocks: int, outputs: int, seed: int = 0):
        super().__init__([inputs, *[width] * (2 * blocks + 1), outputs], seed)

    @staticmethod
    def _norm(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        s = np.sqrt(h.var(1, keepdims=True) + 1e-5)
        return (h - h.mean(1, keepdims=True)) / s, s

    @staticmethod
    def _norm_back(g: np.ndarray, n: np.ndarray, s: np.ndarray) -> np.ndarray:
        return (g - g.mean(1, keepdims=True) - n * (g * n).mean(1, keepdims=True)) / s

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list]:
        h, kept = x @ self.w[0] + self.b[0], [(x,)]
        for k in range(1, len(self.w) - 1, 2):
            n, s = self._norm(h)
            a = np.maximum(n @ self.w[k] + self.b[k], 0)
            h = h + a @ self.w[k + 1] + self.b[k + 1]
            kept.append((n, s, a))
        n, s = self._norm(h)
        kept.append((n, s, np.maximum(n, 0)))
        return kept[-1][2] @ self.w[-1] + self.b[-1], kept

    def backward(self, kept: list, g: np.ndarray) -> list[np.ndarray]:
        n, s, a = kept[-1]
        out = [g.sum(0), a.T @ g]
        g = self._norm_back(g @ self.w[-1].T * (n > 0), n, s)
        for k in range(len(self.w) - 3, 0, -2):
            n, s, a = kept[(k + 1) // 2]
            inner = g @ self.w[k + 1].T * (a > 0)
            out += [g.sum(0), a.T @ g, inner.sum(0), n.T @ inner]
            g = g + self._norm_back(inner @ self.w[k].T, n, s)
        out += [g.sum(0), kept[0][0].T @ g]
        return out[::-1]


def minibatches(n: int, steps: int, size: int, rng: np.random.Generator):
    """Row indices of each step; a table smaller than a batch is one batch."""
    size = min(size, n)
    for _ in range(steps):
        yield rng.integers(0, n, size)


@dataclass
class MLPField:
    """A regressor by an MLP on standardised inputs."""

    hidden: tuple[int, ...] = (64, 64)
    steps: int = 400
    batch: int = 256
    seed: int = 0
    net: MLP | None = None
    scale: tuple | None = None

    def fit(self, x: np.ndarray, y: np.ndarray) -> MLPField:
        y = y.reshape(len(x), -1)
        self.scale = (x.mean(0), x.std(0) + 1e-6, y.mean(0), y.std(0) + 1e-6)
        a, b = (x - self.scale[0]) / self.scale[1], (y - self.scale[2]) / self.scale[3]
        self.net = MLP([x.shape[1], *self.hidden, y.shape[1]], self.seed)
        rng = np.random.default_rng(self.seed + 1)
        self.net.train(((a[i], b[i]) for i in minibatches(len(x), self.steps, self.batch, rng)), lambda out, t: 2 * (out - t) / out.size)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.net.forward((x - self.scale[0]) / self.scale[1])[0] * self.scale[3] + self.scale[2]


KINDS = {"ridge": RidgeField, "trees": TreeField, "mlp": MLPField}


def make_field(kind: str, **params):
    return KINDS[kind](**params)


def bounded_matrix(df: DataFrame, id_col: str, cols: list[str], most: int, seed: int | str = 0) -> np.ndarray:
    """A training matrix of at most about `most` rows, chosen by a hash of the id, ordered by it."""
    from pyspark.sql import functions as F

    from tabweave.functions.rand import uniform

    total = df.count()
    pick = df if total <= most else df.filter(uniform(f"train{seed}", F.col(id_col)) < most / total)
    t = pick.select(F.col(id_col).alias("id__"), *[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(cols)]).dropna().toArrow().sort_by("id__")
    return np.stack([t.column(f"c{i}").to_numpy() for i in range(len(cols))], axis=1) if t.num_rows else np.zeros((0, len(cols)))


def ridge_over(df: DataFrame, x_cols: list[str], y_cols: list[str], model: RidgeField) -> RidgeField:
    """Fits a RidgeField on all rows of df: partitions send sums of products, whose size is that of the model."""
    def run(batches):
        hh = hy = None
        n = 0
        for batch in batches:
            m = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in [*x_cols, *y_cols]], axis=1)
            m = m[np.isfinite(m).all(1)]
            a, b = model.sums(m[:, : len(x_cols)], m[:, len(x_cols) :])
            hh, hy, n = (a, b, len(m)) if hh is None else (hh + a, hy + b, n + len(m))
        if hh is not None:
            yield pa.RecordBatch.from_pydict({"hh": pa.array([hh.tobytes()], pa.binary()), "hy": pa.array([hy.tobytes()], pa.binary()), "n": pa.array([n], pa.int64()), "side": pa.array([len(hh)], pa.int64())})

    from pyspark.sql import functions as F

    def total(t: pa.Table) -> pa.Table:
        hh = sum(np.frombuffer(b) for b in t.column("hh").to_pylist())
        hy = sum(np.frombuffer(b) for b in t.column("hy").to_pylist())
        return pa.table({"hh": pa.array([hh.tobytes()], pa.binary()), "hy": pa.array([hy.tobytes()], pa.binary()), "n": pa.array([sum(t.column("n").to_pylist())], pa.int64()), "side": t.column("side").slice(0, 1)})

    kind = "hh binary, hy binary, n bigint, side bigint"
    parts = df.select(*x_cols, *y_cols).mapInArrow(run, kind).withColumn("g", F.pmod(F.xxhash64("hh"), F.lit(16)))
    rows = parts.groupBy("g").applyInArrow(lambda t: total(t.drop(["g"])), kind).collect()  # at most 16 sums
    side = rows[0]["side"]
    hh = sum(np.frombuffer(bytes(r["hh"])) for r in rows).reshape(side, side)
    hy = sum(np.frombuffer(bytes(r["hy"])) for r in rows).reshape(side, -1)
    return model.solve(hh, hy, sum(r["n"] for r in rows))
