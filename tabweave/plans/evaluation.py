"""Evaluation and tuning plans: utility, k-fold drivers, random and Parzen search, comparison tables."""

from __future__ import annotations

import math
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.operators import metrics, ranks
from tabweave.operators.boosting import WholeTrees
from tabweave.operators.fields import TreeField
from tabweave.operators.schema import TabularSchema
from tabweave.operators.stages import dropped, matrix, stored
from tabweave.operators.transforms import TransformPipeline


def predicted(df: DataFrame, features: list[str], keep: list[str], models: dict[str, TreeField]) -> DataFrame:
    """`keep` of every row of df with no missing feature, and a column of each model's first output."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(models)
    xs = [f"x{i}" for i in range(len(features))]

    def run(batches):
        for b in batches:
            x = matrix(b, xs)
            yield pa.RecordBatch.from_pydict({c: b.column(c) for c in keep} | {n: pa.array(m.predict(x)[:, 0]) for n, m in shared.value.items()})

    rows = df.select(*keep, *[F.col(c).cast("double").alias(x) for c, x in zip(features, xs)]).dropna(subset=xs)
    kind = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), *(f"`{n}` double" for n in models)])
    return rows.mapInArrow(run, kind)


def utility_delta(train: DataFrame, test: DataFrame, synth: DataFrame, features: list[str], target: str, id_col: str, synth_id: str = "row_id", trees: int = 60, depth: int = 5) -> dict[str, float]:
    """R2 on all real test rows of regressors trained on all real and on all synthetic rows, and their relative difference."""
    fit = lambda df, key: WholeTrees(trees=trees, depth=depth).fit(df, key, features, [target])
    models = {"real": fit(train, id_col), "synth": fit(synth, synth_id)}
    held = test.select(*dict.fromkeys(features), F.col(target).cast("double").alias("truth")).filter("truth is not null")
    scored = metrics.r2(predicted(held, features, ["truth"], models), "truth", "real", "synth").collect()[0]
    real, fake = (float("nan") if v is None else float(v) for v in (scored["r2_real"], scored["r2_synth"]))
    return {"r2_real": real, "r2_synth": fake, "delta_r2_percent": (fake - real) / (abs(real) + 1e-12) * 100}


def kfold_evaluate(df: DataFrame, name: str, schema: TabularSchema, make_solver, id_col: str, k: int = 5, seed: int = 42, done: DataFrame | None = None) -> DataFrame:
    """One row per fold: dataset, fold, n_train, n_test, avg_wd, avg_kl, corr_frob and utility. make_solver(cols) -> Solver.
    Folds present in `done` are taken from there."""
    spark, cols = df.sparkSession, list(schema.numeric) + ([schema.target] if schema.target else [])
    # every fold reads the deal several times
    folds = stored(ranks.kfold(df.select(*dict.fromkeys([id_col, *cols])), id_col, k, seed), "folds")
    have = {r["fold"] for r in done.filter(F.col("dataset") == name).select("fold").collect()} if done is not None else set()
    rows = []
    scaled = TabularSchema(continuous=tuple(cols), id=id_col)
    for i in (i for i in range(k) if i not in have):
        pipe = TransformPipeline.dropna_and_scale().fit(folds.filter(F.col("fold") != i), scaled)
        train, test = pipe.transform(folds.filter(F.col("fold") != i)), pipe.transform(folds.filter(F.col("fold") == i))
        n_train, n_test = train.count(), test.count()
        synth = make_solver(cols).fit(train, id_col).sample(spark, n_test, seed + 1000 + i)
        row = {"dataset": name, "fold": i, "n_train": n_train, "n_test": n_test}
        row["avg_wd"] = metrics.average_wasserstein(test, synth, cols).collect()[0][0]
        row["avg_kl"] = metrics.histogram_kl_by_column(test, synth, cols).agg(F.avg("kl")).collect()[0][0]
        row["corr_frob"] = metrics.correlation_frobenius(test, synth, cols).collect()[0][0]
        if schema.target:
            row |= utility_delta(train, test, synth, [c for c in cols if c != schema.target], schema.target, id_col)
        rows.append(row)
    dropped(folds)
    kind = "dataset string, fold int, n_train bigint, n_test bigint, avg_wd double, avg_kl double, corr_frob double" + ", r2_real double, r2_synth double, delta_r2_percent double" * bool(schema.target)
    out = spark.createDataFrame([tuple(r.values()) for r in rows], kind)
    return out if done is None else out.unionByName(done.filter(F.col("dataset") == name).select(*out.columns))


@dataclass(frozen=True)
class Choice:
    values: tuple

    def draw(self, rng: np.random.Generator):
        return self.values[int(rng.integers(len(self.values)))]


@dataclass(frozen=True)
class Range:
    low: float
    high: float
    log: bool = False
    whole: bool = False

    def draw(self, rng: np.random.Generator):
        x = math.exp(rng.uniform(math.log(self.low), math.log(self.high))) if self.log else rng.uniform(self.low, self.high)
        return int(round(x)) if self.whole else float(x)


#: Search spaces of the solvers, as far as they have these parameters.
SPACES = {
    "imf": {"steps": Range(6, 24, whole=True), "sigma": Range(0.3, 1.5, log=True), "first": Choice(("ind", "ref")), "sequence": Choice((("b",), ("b", "f", "b"), ("b", "f", "b", "f", "b"))), "noise": Choice((True, False))},
    "ipf": {"rounds": Range(1, 4, whole=True), "alpha": Range(0.3, 2.0, log=True)},
    "light": {"components": Range(4, 64, log=True, whole=True), "eps": Range(0.05, 1.0, log=True), "rate": Range(3e-3, 5e-2, log=True)},
    "diffusion": {"steps": Range(20, 100, whole=True), "schedule": Choice(("linear", "cosine")), "denoiser": Choice(("mlp", "resnet"))},
    "adversarial": {"inner": Range(200, 1500, whole=True), "latent": Range(16, 128, log=True, whole=True), "rate": Range(2e-4, 2e-3, log=True), "pac": Choice((1, 5, 10))},
}


def layer_widths(rng: np.random.Generator) -> list[int]:
    """Widths of an even number (2 to 8) of layers, powers of two from 128 to 1024; the inner ones share one width."""
    n = 2 * int(rng.integers(1, 5))
    first, inner, last = (2 ** int(rng.integers(7, 11)) for _ in range(3))
    return [first, *[inner] * (n - 2), last]


def _parzen(x: np.ndarray, centres: np.ndarray, low: float, high: float) -> np.ndarray:
    """Log density at x of equal normals at the centres and one over the whole range."""
    at = np.append(centres, (low + high) / 2)
    width = np.append(np.full(len(centres), max((high - low) / min(100, len(centres) + 2), 1e-12)), high - low)
    z = -0.5 * ((x[:, None] - at) / width) ** 2 - np.log(width)
    top = z.max(1, keepdims=True)
    return (top + np.log(np.exp(z - top).mean(1, keepdims=True)))[:, 0]


def propose(space: dict, seen: list[tuple[dict, float]], rng: np.random.Generator, candidates: int = 24) -> dict:
    """Tree-structured Parzen draw: of candidates near the best trials (a tenth, 25 at most), for each parameter the one
    whose density among them stands highest over that among the others."""
    order = sorted(range(len(seen)), key=lambda i: (seen[i][1], i))
    best = set(order[: max(1, min(math.ceil(0.1 * len(order)), 25))])
    out = {}
    for name, kind in space.items():
        good, rest = ([seen[i][0][name] for i in range(len(seen)) if (i in best) == own] for own in (True, False))
        if isinstance(kind, Choice):
            share = [np.array([1 + 10 * sum(g == v for g in own) / max(len(own), 1) for v in kind.values]) for own in (good, rest)]
            share = [w / w.sum() for w in share]
            drawn = rng.choice(len(kind.values), candidates, p=share[0])
            out[name] = kind.values[int(drawn[np.argmax((share[0] / share[1])[drawn])])]
            continue
        to, back = (np.log, np.exp) if kind.log else (np.asarray, np.asarray)
        low, high = float(to(kind.low)), float(to(kind.high))
        centres, others = (np.asarray(to(np.array(v, float))) for v in (good, rest))
        width = max((high - low) / min(100, len(centres) + 2), 1e-12)
        pick = rng.integers(0, len(centres) + 1, candidates)
        x = np.where(pick < len(centres), np.append(centres, 0)[pick] + width * rng.normal(size=candidates), rng.uniform(low, high, candidates)).clip(low, high)
        value = float(back(x[np.argmax(_parzen(x, centres, low, high) - _parzen(x, others, low, high))]))
        out[name] = int(round(value)) if kind.whole else value
    return out


def search(spark: SparkSession, objective, space: dict, trials: int = 20, seed: int = 42, threads: int = 4, sampler: str = "random", startup: int = 10, prune: bool = False) -> DataFrame:
    """A seeded search, trials in parallel as Spark jobs: number, value, params (json), state, error, ascending.

    `random` draws every trial alone; `tpe` does so for `startup` trials, then proposes rounds of `threads` trials from all
    that earlier rounds found, so its trials depend on the seed and the values, not on which job ends first. A trial that
    raises, or whose value is no number, gets the value inf and keeps its error. With `prune`, a trial after the first
    `startup` whose value is above the median of the complete ones of earlier rounds is marked pruned."""
    import json

    if sampler not in ("random", "tpe"):
        raise ValueError(f"no sampler {sampler}")

    def run(i: int, params: dict):
        try:
            value = float(objective(params))
            if math.isnan(value):
                raise ValueError("value is not a number")
            return i, value, json.dumps(params), "complete", None
        except Exception as e:
            return i, float("inf"), json.dumps(params), "fail", f"{type(e).__name__}: {e}"[:500]

    rows, seen, at = [], [], 0
    with ThreadPoolExecutor(threads) as pool:
        while at < trials:
            n = min(threads if at >= startup else startup - at, trials - at) if sampler == "tpe" or prune else trials
            # a whole round is proposed before any of it runs
            if sampler == "tpe" and at >= startup:
                drawn = [propose(space, seen, np.random.default_rng([seed, i])) for i in range(at, at + n)]
            else:
                drawn = [{k: v.draw(np.random.default_rng([seed, i, j])) for j, (k, v) in enumerate(space.items())} for i in range(at, at + n)]
            done = list(pool.map(run, range(at, at + n), drawn))
            complete = [r[1] for r in rows if r[3] == "complete"]
            if prune and at >= startup and complete:
                done = [(*r[:3], "pruned", None) if r[3] == "complete" and r[1] > np.median(complete) else r for r in done]
            rows, seen, at = rows + done, seen + [(p, r[1]) for p, r in zip(drawn, done)], at + n
    return spark.createDataFrame(rows, "number int, value double, params string, state string, error string").orderBy("value", "number")


def best_trial(trials: DataFrame) -> DataFrame:
    """The complete trial of least value, of ties the earliest; failed trials have the value inf. A table
    without states has no pruned trials."""
    own = trials.filter(F.col("state") != "pruned") if "state" in trials.columns else trials
    return own.orderBy("value", "number").limit(1)


def compare_models(results: DataFrame, dataset: str, model: str, metric: str) -> DataFrame:
    """Average rank of each model over datasets, from texts such as '0.12 ± 0.01'; r2 metrics rank by absolute value."""
    from tabweave.functions.scalars import first_number

    score = first_number(F.col(metric).cast("string"))
    score = F.abs(score) if "r2" in metric.lower() else score
    return ranks.average_rank(results.withColumn("score__", score).filter(F.col("score__").isNotNull()), dataset, model, "score__").orderBy("avg_rank")
