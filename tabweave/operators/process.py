"""Bridge processes as column expressions: time grids, Gaussian and categorical references, couplings, tuples, steps.

Nothing here iterates over rows: a step, a bridge or a training tuple is a projection, a short path is an unrolled
expression, and noise is a function of (tag, row id, coordinate), so any partitioning gives the same values.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabweave.functions.rand import normal, uniform


@dataclass(frozen=True)
class TimeGrid:
    """K steps of sizes gamma, linear or geometric between both ends; t is their running sum, total the whole."""

    steps: int
    low: float = 1e-4
    high: float = 1e-2
    schedule: str = "geom"

    def __post_init__(self) -> None:
        if self.steps < 2:
            raise ValueError("a grid has two steps or more")
        if not 0 < self.low <= self.high:
            raise ValueError("step sizes are positive and rise")
        if self.schedule not in ("linear", "geom"):
            raise ValueError(f"unknown schedule {self.schedule}")

    @cached_property  # a path asks for them at every step
    def gamma(self) -> np.ndarray:
        return np.linspace(self.low, self.high, self.steps) if self.schedule == "linear" else np.geomspace(self.low, self.high, self.steps)

    @cached_property
    def t(self) -> np.ndarray:
        return np.cumsum(self.gamma)

    @property
    def total(self) -> float:
        return float(self.gamma.sum())

    def table(self, spark: SparkSession) -> DataFrame:
        """(k, gamma, t, remaining); K rows."""
        share = F.col("k") / F.lit(float(self.steps - 1))
        gamma = F.lit(self.low) + share * F.lit(self.high - self.low) if self.schedule == "linear" else F.lit(self.low) * F.pow(F.lit(self.high / self.low), share)
        over = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # K rows, not data
        grid = spark.range(self.steps).select(F.col("id").cast("int").alias("k")).withColumn("gamma", gamma).withColumn("t", F.sum("gamma").over(over))
        return grid.withColumn("remaining", F.lit(self.total) - F.col("t"))


def midpoint_times(spark: SparkSession, steps: int, eps: float = 1e-3) -> DataFrame:
    """(k, t): the middle of each of K equal steps, kept eps away from both ends."""
    t = (F.col("id") + 0.5) / F.lit(float(steps))
    return spark.range(steps).select(F.col("id").cast("int").alias("k"), F.least(F.greatest(t, F.lit(eps)), F.lit(1 - eps)).alias("t"))


def gaussian_reference(ids: DataFrame, id_col: str, dims: int, mean: float = 0.0, std: float = 1.0, seed: int | str = 0) -> DataFrame:
    """ids with z1_0 .. z1_{dims-1}: independent normals keyed by id."""
    return ids.withColumns({f"z1_{j}": F.lit(mean) + F.lit(std) * normal(f"prior{seed}:{j}", F.col(id_col)) for j in range(dims)})


def bridge_point(z0: Column, z1: Column, t: Column, sigma: float, e: Column) -> Column:
    return (F.lit(1.0) - t) * z0 + t * z1 + F.lit(sigma) * F.sqrt(t * (F.lit(1.0) - t)) * e


def bridge_target(z0: Column, z1: Column, t: Column, sigma: float, e: Column, direction: str) -> Column:
    """The drift to learn at a bridge's point: towards z1 ('f') or towards z0 ('b')."""
    odds = t / (F.lit(1.0) - t)
    if direction == "f":
        return z1 - z0 - F.lit(sigma) * F.sqrt(odds) * e
    if direction == "b":
        return z0 - z1 - F.lit(sigma) * F.sqrt(F.lit(1.0) / odds) * e
    raise ValueError(direction)


def bridge_tuple(df: DataFrame, id_col: str, pairs: dict[str, tuple[Column, Column]], sigma: float, direction: str, seed: str | int, eps: float = 1e-3) -> DataFrame:
    """Per row a time, the bridge's points x_<name> and the targets y_<name>, for endpoints pairs[name] = (z0, z1)."""
    t = F.least(F.greatest(uniform(f"t{seed}", F.col(id_col)), F.lit(eps)), F.lit(1 - eps))
    base = df.withColumn("t", t)
    out = {}
    for name, (z0, z1) in pairs.items():
        e = normal(f"e{seed}:{name}", F.col(id_col))
        out[f"x_{name}"] = bridge_point(z0, z1, F.col("t"), sigma, e)
        out[f"y_{name}"] = bridge_target(z0, z1, F.col("t"), sigma, e, direction)
    return base.withColumns(out)


def reference_coupling(z0: Column, sigma: float, seed: str | int, id_col: str, name: str) -> Column:
    """The other end by the reference process itself: z0 + sigma * noise."""
    return z0 + F.lit(sigma) * normal(f"ref{seed}:{name}", F.col(id_col))


def independent_coupling(df: DataFrame, prior: DataFrame, id_col: str, seed: str | int) -> DataFrame:
    """Rows of df paired with rows of prior by their ranks in two independent permutations; a prior of fewer rows starts
    again from its first rank, so every row of df has a partner."""
    from tabweave.operators.ranks import permutation_rank

    a = permutation_rank(df, id_col, f"{seed}:a", "r__").drop("n__")
    b = permutation_rank(prior, id_col, f"{seed}:b", "r__").drop("n__").withColumnRenamed(id_col, f"{id_col}_prior")
    rows = prior.count()
    if not rows:
        raise ValueError("the prior has no rows")
    return a.withColumn("r__", F.pmod(F.col("r__") - 1, F.lit(rows)) + 1).join(b, "r__").drop("r__")


def euler_step(x: Column, drift: Column, gamma: Column | float, sigma: float, noise: Column | None) -> Column:
    g = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    out = x + drift * g
    return out if noise is None else out + F.lit(sigma) * F.sqrt(g) * noise


def euler_path(df: DataFrame, id_col: str, x_col: str, drift, grid: TimeGrid, sigma: float, seed: str | int, noisy: bool = True, backward: bool = False) -> DataFrame:
    """df with path: array of K + 1 states of a closed-form drift(x, k) -> Column, step by step in columns."""
    ks = list(range(grid.steps))
    out = df.withColumn("s__0", F.col(x_col).cast("double"))
    for i, k in enumerate(reversed(ks) if backward else ks):
        x = F.col(f"s__{i}")
        out = out.withColumn(f"s__{i + 1}", euler_step(x, drift(x, k), float(grid.gamma[k]), sigma, normal(f"em{seed}:{k}", F.col(id_col)) if noisy else None))
    cols = [F.col(f"s__{i}") for i in range(grid.steps + 1)]
    return out.withColumn("path", F.array(*cols)).drop(*[f"s__{i}" for i in range(grid.steps + 1)])


def ou_target(x: Column, gamma: Column | float, alpha: float = 1.0) -> Column:
    """Mean of one Ornstein-Uhlenbeck step."""
    return x - (gamma if isinstance(gamma, Column) else F.lit(float(gamma))) * F.lit(alpha) * x


def ipf_target(x_next: Column, mean_at_x: Column, mean_at_next: Column) -> Column:
    """The residual target of an iterative proportional fitting step."""
    return x_next + (mean_at_x - mean_at_next)


def one_step_cache(df: DataFrame, id_col: str, x_col: str, drift, grid: TimeGrid, sigma: float, seed: str | int) -> DataFrame:
    """Per row a random step k, the next state by the opposite drift and the displacement back, over gamma."""
    k = F.floor(uniform(f"k{seed}", F.col(id_col)) * F.lit(grid.steps)).cast("int")
    gamma = F.element_at(F.array(*[F.lit(float(g)) for g in grid.gamma]), F.col("k") + 1)
    x = F.col(x_col).cast("double")
    out = df.withColumn("k", F.least(k, F.lit(grid.steps - 1))).withColumn("gamma", gamma)
    out = out.withColumn("x_next", euler_step(x, drift(x, F.col("k")), F.col("gamma"), sigma, normal(f"c{seed}", F.col(id_col))))
    return out.withColumn("target", (x - F.col("x_next")) / F.col("gamma"))


def regression_loss(df: DataFrame, pairs: list[tuple[str, str]], kind: str = "mse", delta: float = 1.0, weight: str | None = None, reduction: str = "mean") -> DataFrame:
    """One row loss: the mean over coordinates of squared or Huber errors, weighted, as mean or sum over rows."""
    def one(p: str, y: str) -> Column:
        e = F.col(p) - F.col(y)
        return F.pow(e, 2) if kind == "mse" else F.when(F.abs(e) <= delta, 0.5 * F.pow(e, 2)).otherwise(F.lit(delta) * (F.abs(e) - 0.5 * delta))

    row = sum((one(p, y) for p, y in pairs[1:]), one(*pairs[0])) / len(pairs)
    row = row * F.col(weight) if weight else row
    return df.agg((F.avg(row) if reduction == "mean" else F.sum(row)).alias("loss"))


# Categorical references


def uniform_kernel(i: Column, j: Column, k: Column, states: int, alpha: float) -> Column:
    """Entry (i, j) of the k-th power of the uniform kernel, in closed form; k = 0 is the identity."""
    b = alpha * states / (states - 1 + 1e-6)
    bar = F.pow(F.lit(1 - b), k)
    jump = (F.lit(1.0) - bar) / states
    same = i == j
    return F.when(k == 0, F.when(same, 1.0).otherwise(0.0)).otherwise(F.when(same, bar + jump).otherwise(jump))


def uniform_matrix(states: int, alpha: float, k: int) -> np.ndarray:
    if k == 0:
        return np.eye(states)
    bar = (1 - alpha * states / (states - 1 + 1e-6)) ** k
    return np.eye(states) * bar + (1 - bar) / states


def ordered_matrix(states: int, alpha: float, k: int, widen_from: int = 30) -> np.ndarray:
    """The k-th power of a kernel whose jumps fall with the squared distance of ordered states; from `widen_from`
    steps on, one step of k times the variance."""
    if k == 0:
        return np.eye(states)
    i = np.arange(states)
    var = alpha**2 * (1 if k < widen_from else k) * (states - 1) ** 2 + 1e-12
    e = np.exp(-4 * (i[:, None] - i) ** 2 / var)
    q = e / e.sum(1, keepdims=True)
    return np.linalg.matrix_power(q, k) if k < widen_from else q


@dataclass(frozen=True)
class CategoricalColumn:
    """What the categorical losses read of one column: its kernel, an array of logits, the true end and the state."""

    reference: CategoricalReference
    logits: Column
    true: Column
    state: Column


def bound_once(value: Column, use) -> Column:
    """use(value), where an expensive value is computed once however often it is used (as the variable of a lambda)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shares(weights: Column) -> Column:
    """An array of weights over their sum."""
    total = lambda w: F.greatest(F.aggregate(w, F.lit(0.0), lambda a, x: a + x), F.lit(1e-30))
    return bound_once(weights, lambda w: bound_once(total(w), lambda t: F.transform(w, lambda x: x / t)))


def csbm_terms(column: CategoricalColumn, n: Column, direction: str) -> tuple[Column, Column]:
    """(KL of the bridge's step against the model's, cross entropy of the end) of a row. Forward steps go to the state at n + 1
    and the logits are of the last state, backward ones to n - 1 and of the first."""
    if direction not in ("forward", "backward"):
        raise ValueError("direction must be forward or backward")
    ref, forward = column.reference, direction == "forward"

    def divergence(model: Column, target: Column) -> Column:
        each = F.zip_with(target, model, lambda t, m: F.when(t > 0, t * (F.ln(t) - F.ln(m + F.lit(1e-12)))).otherwise(F.lit(0.0)))
        return F.aggregate(each, F.lit(0.0), lambda acc, x: acc + x)

    target = ref.next_given_prev(column.state, column.true, n) if forward else ref.prev_given_next(column.true, column.state, n)
    step = bound_once(softmax(column.logits), lambda p: ref.model_next(column.state, p, n) if forward else ref.model_prev(column.state, p, n))
    kl = bound_once(step, lambda m: divergence(m, target))
    log_sum = bound_once(F.array_max(column.logits), lambda top: top + F.ln(F.aggregate(column.logits, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))))
    return kl, log_sum - F.element_at(column.logits, column.true + 1)


def csbm_loss(df: DataFrame, columns: list[CategoricalColumn], n: Column, direction: str, weight: float = 0.001) -> DataFrame:
    """loss: mean KL plus `weight` times mean cross entropy, over all rows and columns, in one aggregate."""
    kl, ce = zip(*(csbm_terms(c, n, direction) for c in columns))
    mean = lambda terms: sum((F.avg(t) for t in terms[1:]), F.avg(terms[0])) / F.lit(float(len(terms)))
    return df.agg((mean(kl) + F.lit(weight) * mean(ce)).alias("loss"))


def mixed_loss(df: DataFrame, numeric: list[tuple[str, str]], columns: list[CategoricalColumn], n: Column, direction: str, numeric_share: float = 0.5, categorical_share: float = 0.5, weight: float = 0.001) -> DataFrame:
    """loss: numeric_share times the mean squared error of the (prediction, target) pairs, plus categorical_share times the
    categorical loss over the number of categorical columns; one aggregate."""
    off = [F.pow(F.col(p).cast("double") - F.col(y).cast("double"), 2) for p, y in numeric]
    kl, ce = zip(*(csbm_terms(c, n, direction) for c in columns))
    total = lambda terms: sum((F.avg(t) for t in terms[1:]), F.avg(terms[0])) / F.lit(float(len(terms)))
    return df.agg((F.lit(numeric_share) * total(off) + F.lit(categorical_share / len(columns)) * (total(kl) + F.lit(weight) * total(ce))).alias("loss"))


@dataclass(frozen=True)
class CategoricalReference:
    """All powers 0 .. steps of one column's kernel."""

    states: int
    steps: int
    alpha: float
    kind: str = "uniform"

    @property
    def powers(self) -> np.ndarray:
        make = uniform_matrix if self.kind == "uniform" else ordered_matrix
        return np.stack([make(self.states, self.alpha, k) for k in range(self.steps + 1)])

    def with_alpha(self, alpha: float) -> CategoricalReference:
        return CategoricalReference(self.states, self.steps, alpha, self.kind)

    def table(self, spark: SparkSession) -> DataFrame:
        """(k, i, j, p): (steps + 1) * states**2 rows, for broadcast joins."""
        k, i, j = np.meshgrid(range(self.steps + 1), range(self.states), range(self.states), indexing="ij")
        return spark.createDataFrame(list(zip(k.ravel().tolist(), i.ravel().tolist(), j.ravel().tolist(), self.powers.ravel().tolist())), "k int, i int, j int, p double")

    def _entry(self, k: Column, i: Column, j: Column) -> Column:
        if self.kind == "uniform":
            return uniform_kernel(i, j, k, self.states, self.alpha)
        flat = F.array(*[F.lit(float(x)) for x in self.powers.ravel()])
        return F.element_at(flat, (k * self.states + i) * self.states + j + 1)

    def _normalised(self, weight) -> Column:
        return shares(F.array(*[weight(F.lit(s)) for s in range(self.states)]))

    def bridge(self, x0: Column, x1: Column, t: Column) -> Column:
        """Probabilities of the state at step t between x0 at step 0 and x1 at the last step."""
        return self._normalised(lambda s: self._entry(t, x0, s) * self._entry(F.lit(self.steps) - t, s, x1))

    def next_given_prev(self, xt: Column, x1: Column, n: Column) -> Column:
        """Of the state at step n + 1, given that at n and the last one."""
        return self._normalised(lambda s: self._entry(F.lit(1), xt, s) * self._entry(F.lit(self.steps - 1) - n, s, x1))

    def next_drawn(self, xt: Column, x1: Column, n: int, u: Column) -> Column:
        """A draw by next_given_prev at a step known beforehand. Its running sums are constants of (xt, x1) then, and a row looks up its
        own; a value that is no state equals none, as in the closed form."""
        if self.kind != "uniform" or not 2 <= self.states <= 16:
            return draw(self.next_given_prev(xt, x1, F.lit(n)), u)
        near, far = (np.vstack([m, np.full(self.states, m[0, 1])]) for m in (uniform_matrix(self.states, self.alpha, k) for k in (1, self.steps - 1 - n)))
        w = near[:, None] * far
        upto = np.cumsum(w / np.maximum(np.cumsum(w, 2)[:, :, -1:], 1e-30), 2)
        place = lambda x: F.when((x >= 0) & (x < self.states), x).otherwise(self.states)
        at = place(xt) * (self.states + 1) + place(x1) + 1
        below = [(F.element_at(F.array(*[F.lit(float(v)) for v in upto[:, :, s].ravel()]), at) < u).cast("int") for s in range(self.states - 1)]
        return sum(below[1:], below[0])

    def prev_given_next(self, x0: Column, xt: Column, n: Column) -> Column:
        """Of the state at step n - 1, given the first one and that at n."""
        return self._normalised(lambda s: self._entry(n - 1, x0, s) * self._entry(F.lit(1), s, xt))

    def model_next(self, xt: Column, ends: Column, n: Column) -> Column:
        """next_given_prev averaged over an array of probabilities of the last state (its normaliser is a kernel power)."""
        left = F.lit(self.steps - 1) - n
        return self._averaged(ends, lambda e: self._entry(left + 1, xt, e), lambda s: self._entry(F.lit(1), xt, s), lambda s, e: self._entry(left, s, e))

    def model_prev(self, xt: Column, starts: Column, n: Column) -> Column:
        """prev_given_next averaged over an array of probabilities of the first state."""
        return self._averaged(starts, lambda e: self._entry(n, e, xt), lambda s: self._entry(F.lit(1), s, xt), lambda s, e: self._entry(n - 1, e, s))

    def _averaged(self, weights: Column, norm, near, far) -> Column:
        every = F.sequence(F.lit(0), F.lit(self.states - 1))
        share = F.transform(every, lambda e: F.element_at(weights, e + 1) / F.greatest(norm(e), F.lit(1e-30)))
        return bound_once(share, lambda own: shares(F.transform(every, lambda s: near(s) * F.aggregate(every, F.lit(0.0), lambda acc, e: acc + F.element_at(own, e + 1) * far(s, e)))))


def draw(probs: Column, u: Column) -> Column:
    """A state by the inverse of the running sum of probabilities, at a uniform."""
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("at"))
    walked = F.aggregate(probs, start, lambda acc, p: F.struct((acc["sum"] + p).alias("sum"), (acc["at"] + F.when(acc["sum"] + p < u, 1).otherwise(0)).alias("at")))
    return F.least(walked["at"], F.size(probs) - 1)


def softmax(logits: Column) -> Column:
    e = bound_once(logits, lambda g: bound_once(F.array_max(g), lambda top: F.transform(g, lambda x: F.exp(x - top))))
    return bound_once(e, lambda w: bound_once(F.aggregate(w, F.lit(0.0), lambda a, b: a + b), lambda total: F.transform(w, lambda x: x / total)))


def gumbel_argmax(df: DataFrame, id_col: str, cat_col: str, logit: str, seed: str | int) -> DataFrame:
    """Per id the category of the largest logit plus Gumbel noise, from rows (id, category, logit)."""
    u = uniform(f"gumbel{seed}", F.col(id_col), F.col(cat_col))
    return df.groupBy(id_col).agg(F.max_by(cat_col, F.col(logit) - F.ln(-F.ln(u))).alias(cat_col))


# Light Schroedinger bridge potentials


@dataclass(frozen=True)
class LightPotential:
    """A mixture of K Gaussians with diagonal covariances: weights alpha, centres r (K, D), scales s (K, D)."""

    log_alpha: tuple[float, ...]
    r: tuple[tuple[float, ...], ...]
    s: tuple[tuple[float, ...], ...]
    eps: float = 1.0

    def _sum(self, terms: list[Column]) -> Column:
        top = F.greatest(*terms) if len(terms) > 1 else terms[0]
        return top + F.ln(sum((F.exp(x - top) for x in terms[1:]), F.exp(terms[0] - top)))

    def c_terms(self, x: list[Column]) -> list[Column]:
        """Log weights of the components of the plan from x."""
        out = []
        for a, r, s in zip(self.log_alpha, self.r, self.s):
            q = sum((F.lit(sj) * xj * xj + F.lit(2 * rj) * xj for xj, rj, sj in zip(x[1:], r[1:], s[1:])), F.lit(s[0]) * x[0] * x[0] + F.lit(2 * r[0]) * x[0])
            out.append(F.lit(a) + q / F.lit(2 * self.eps))
        return out

    def log_c(self, x: list[Column]) -> Column:
        return self._sum(self.c_terms(x))

    def log_v(self, x: list[Column]) -> Column:
        out = []
        for a, r, s in zip(self.log_alpha, self.r, self.s):
            terms = [F.lit(-0.5) * (F.pow(xj - F.lit(rj), 2) / F.lit(self.eps * sj) + F.lit(float(np.log(2 * np.pi * self.eps * sj)))) for xj, rj, sj in zip(x, r, s)]
            out.append(F.lit(a) + sum(terms[1:], terms[0]))
        return self._sum(out)

    def plan_sample(self, df: DataFrame, id_col: str, cols: list[str], seed: str | int) -> DataFrame:
        """df with y_<col>: a draw of the other end for each row."""
        x = [F.col(c).cast("double") for c in cols]
        w = F.array(*self.c_terms(x))
        k = draw(softmax(w), uniform(f"plan{seed}", F.col(id_col)))
        out = df.withColumn("component", k)
        pick = lambda m, j: F.element_at(F.array(*[F.lit(float(row[j])) for row in m]), F.col("component") + 1)
        return out.withColumns({f"y_{c}": pick(self.r, j) + pick(self.s, j) * x[j] + F.sqrt(F.lit(self.eps) * pick(self.s, j)) * normal(f"plan{seed}:{j}", F.col(id_col)) for j, c in enumerate(cols)})


@dataclass(frozen=True)
class FullLightPotential(LightPotential):
    """The same mixture with full covariances: s holds symmetric positive definite matrices (K, D, D)."""

    s: tuple[tuple[tuple[float, ...], ...], ...]

    def c_terms(self, x: list[Column]) -> list[Column]:
        out, dims = [], range(len(x))
        for a, r, s in zip(self.log_alpha, self.r, self.s):
            square = [F.lit(float(s[i][j])) * x[i] * x[j] for i in dims for j in dims]
            terms = square + [F.lit(2.0 * r[j]) * x[j] for j in dims]
            out.append(F.lit(a) + sum(terms[1:], terms[0]) / F.lit(2 * self.eps))
        return out

    def log_v(self, x: list[Column]) -> Column:
        out, dims = [], range(len(x))
        for a, r, s in zip(self.log_alpha, self.r, self.s):
            inverse = np.linalg.inv(self.eps * np.array(s))
            log_det = float(np.linalg.slogdet(2 * np.pi * self.eps * np.array(s))[1])
            off = [xj - F.lit(float(rj)) for xj, rj in zip(x, r)]
            terms = [F.lit(float(inverse[i, j])) * off[i] * off[j] for i in dims for j in dims]
            out.append(F.lit(a) - F.lit(0.5) * (sum(terms[1:], terms[0]) + F.lit(log_det)))
        return self._sum(out)

    def plan_sample(self, df: DataFrame, id_col: str, cols: list[str], seed: str | int) -> DataFrame:
        """df with y_<col>: a draw of the other end for each row, correlated by the Cholesky factor of its component."""
        x = [F.col(c).cast("double") for c in cols]
        out = df.withColumn("component", draw(softmax(F.array(*self.c_terms(x))), uniform(f"plan{seed}", F.col(id_col))))
        factors = [np.linalg.cholesky(self.eps * np.array(s)) for s in self.s]
        pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col("component") + 1)
        noise = [normal(f"plan{seed}:{j}", F.col(id_col)) for j in range(len(cols))]
        ends = {}
        for i, c in enumerate(cols):
            terms = [pick([r[i] for r in self.r])] + [pick([s[i][j] for s in self.s]) * x[j] for j in range(len(cols))] + [pick([f[i, j] for f in factors]) * noise[j] for j in range(i + 1)]
            ends[f"y_{c}"] = sum(terms[1:], terms[0])
        return out.withColumns(ends)


# Diffusion schedules of the baselines


def beta_schedule(spark: SparkSession, kind: str, steps: int) -> DataFrame:
    """(k, beta, alpha_bar, log_alpha_sum): linear (scaled to 1000 steps) or squared-cosine."""
    k = F.col("id").cast("double")
    if kind == "linear":
        scale = 1000 / steps
        beta = F.lit(scale * 1e-4) + k * F.lit((scale * 0.02 - scale * 1e-4) / (steps - 1))
    elif kind == "cosine":
        f = lambda u: F.pow(F.cos((u + F.lit(0.008)) / F.lit(1.008) * F.lit(np.pi / 2)), 2)
        beta = F.least(F.lit(1.0) - f((k + 1) / steps) / f(k / steps), F.lit(0.999))
    else:
        raise ValueError(kind)
    over = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)  # `steps` rows, not data
    out = spark.range(steps).select(F.col("id").cast("int").alias("k"), beta.alias("beta"))
    logs = F.sum(F.ln(F.lit(1.0) - F.col("beta"))).over(over)
    return out.withColumn("log_alpha_sum", logs).withColumn("alpha_bar", F.exp("log_alpha_sum"))


def betas(kind: str, steps: int) -> np.ndarray:
    if kind == "linear":
        return np.linspace(1000 / steps * 1e-4, 1000 / steps * 0.02, steps)
    f = lambda u: np.cos((u + 0.008) / 1.008 * np.pi / 2) ** 2
    k = np.arange(steps)
    return np.minimum(1 - f((k + 1) / steps) / f(k / steps), 0.999)


def q_sample(x0: Column, alpha_bar: Column, noise: Column) -> Column:
    return F.sqrt(alpha_bar) * x0 + F.sqrt(F.lit(1.0) - alpha_bar) * noise


def q_posterior(x0: Column, xt: Column, beta: Column, bar: Column, bar_prev: Column) -> tuple[Column, Column]:
    """Mean and variance of the previous state given the start and the present one."""
    one = F.lit(1.0)
    mean = F.sqrt(bar_prev) * beta / (one - bar) * x0 + F.sqrt(one - beta) * (one - bar_prev) / (one - bar) * xt
    return mean, beta * (one - bar_prev) / (one - bar)


def vb_term(mean: Column, log_var: Column, model_mean: Column, model_log_var: Column) -> Column:
    """A term of the variational bound in bits: KL of the true against the model's posterior."""
    from tabweave.functions.scalars import normal_kl

    return normal_kl(mean, log_var, model_mean, model_log_var) / F.lit(float(np.log(2)))


def prior_kl(x0: Column, bar: Column) -> Column:
    """KL of the last noised state against the standard normal, in bits."""
    return vb_term(F.sqrt(bar) * x0, F.ln(F.lit(1.0) - bar), F.lit(0.0), F.lit(0.0))


def q_pred(onehot: Column, states: int, bar: Column) -> Column:
    """Multinomial diffusion: probability of a state after t steps from its indicator at the start."""
    return bar * onehot + (F.lit(1.0) - bar) / states


def ve_sigma(t: Column, low: float, high: float) -> Column:
    """Variance-exploding noise scale."""
    return F.lit(low) * F.pow(F.lit(high / low), t)
