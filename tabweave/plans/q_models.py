"""Queries of the learned generators: rows of a fitted model, which no SQL can express, and a summary of each against
the real rows (its size, missing values, range, mean and spread), whose SQL states what must hold.

Bridge solvers, light and the copula are fitted on all rows. The others read a hashed sample of at most this many rows: categorical
solvers 4,000, diffusion and score 8,000, adversarial 10,000, Langevin 2,000.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabweave.operators import metrics
from tabweave.operators.adversarial import AdversarialBaseline
from tabweave.operators.baselines import CopulaBaseline, DiffusionBaseline, LangevinBaseline, ScoreBaseline
from tabweave.operators.schema import TabularSchema
from tabweave.operators.solvers import CategoricalSolver, ImfSolver, IpfSolver, learn_structure, solver
from tabweave.operators.transforms import IntegerCode, StandardScaler
from tabweave.plans import evaluation
from tabweave.plans.q_process import n_sql
from tabweave.sources.readers import table

COLS = ["l_quantity", "l_extendedprice", "l_discount"]
N = 1000  # rows to generate: the size of the sample asked for


def scaled_lines(spark, d):
    lines = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax").alias("row_key"), *COLS)
    return StandardScaler().fit(lines, TabularSchema(continuous=tuple(COLS))).transform(lines)


def _mixed(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    schema = TabularSchema(continuous=("o_totalprice",), categorical=("o_orderpriority", "o_orderstatus"))
    codes = IntegerCode().fit(o, schema)
    df = codes.transform(StandardScaler().fit(o, schema).transform(o))
    return df, {c: len(v) for c, v in codes.categories.items()}


_FITTED: dict = {}


def _fitted(spark, name, d, make):
    """A model is fitted once for a session and a bundle; its rows and its summary read the same one."""
    key = (spark.sparkContext.applicationId, name, d)
    if key not in _FITTED:
        _FITTED[key] = make()
    return _FITTED[key]


def _generate(name, **params):
    def query(spark, d):
        return _fitted(spark, name, d, lambda: solver(name, COLS, **params).fit(scaled_lines(spark, d), "row_key")).sample(spark, N, 7)

    query.__name__ = f"{name}_generate"
    return query


DEPENDENT = ["l_quantity", "l_extendedprice", "l_value"]


def dependent_lines(spark, d):
    """Columns with a structure to find: a value that follows the quantity and, less, the price."""
    lines = table(spark, d, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_tax").alias("row_key"), "l_quantity", "l_extendedprice", (F.col("l_quantity") * 1000 + F.col("l_extendedprice") * 0.2).alias("l_value"))
    return StandardScaler().fit(lines, TabularSchema(continuous=tuple(DEPENDENT))).transform(lines)


def structure_edges(spark, d):
    parents = learn_structure(dependent_lines(spark, d), DEPENDENT)
    return spark.createDataFrame([(p, c) for c, ps in parents.items() for p in ps], "parent string, child string")


def ipf_discrete_structural_generate(spark, d):
    df = dependent_lines(spark, d)
    make = lambda: IpfSolver(DEPENDENT, "trees", "discrete", "featurewise", parents=learn_structure(df, DEPENDENT), params={"trees": 15}).fit(df, "row_key")
    return _fitted(spark, "ipf_discrete_structural", d, make).sample(spark, N, 7)


def ipf_continuous_structural_generate(spark, d):
    df = dependent_lines(spark, d)
    make = lambda: IpfSolver(DEPENDENT, "trees", "continuous", "featurewise", parents=learn_structure(df, DEPENDENT), params={"trees": 15}).fit(df, "row_key")
    return _fitted(spark, "ipf_continuous_structural", d, make).sample(spark, N, 7)


def categorical_generate(spark, d):
    df, states = _mixed(spark, d)
    return CategoricalSolver(list(states), states).fit(df, "o_orderkey").sample(spark, N, 7)


def mixed_generate(spark, d):
    df, states = _mixed(spark, d)
    return CategoricalSolver(["o_totalprice", *states], states).fit(df, "o_orderkey").sample(spark, N, 7)


def copula_generate(spark, d):
    return CopulaBaseline(COLS, ["l_discount"]).fit(scaled_lines(spark, d), "row_key").sample(spark, N, 7)


def ddpm_generate(spark, d):
    df, states = _mixed(spark, d)
    return DiffusionBaseline(["o_totalprice", *states], states, inner=600).fit(df, "o_orderkey").sample(spark, N, 7)


def score_generate(spark, d):
    return ScoreBaseline(COLS, inner=600).fit(scaled_lines(spark, d), "row_key").sample(spark, N, 7)


def ddpm_resnet_generate(spark, d):
    df, states = _mixed(spark, d)
    return DiffusionBaseline(["o_totalprice", *states], states, inner=600, denoiser="resnet").fit(df, "o_orderkey").sample(spark, N, 7)


def adversarial_generate(spark, d):
    return AdversarialBaseline(COLS, ["l_discount"]).fit(scaled_lines(spark, d), "row_key").sample(spark, N, 7)


def langevin_generate(spark, d):
    return LangevinBaseline(COLS).fit(scaled_lines(spark, d), "row_key").sample(spark, N, 7)


def langevin_class_generate(spark, d):
    """Rows of a class each: the classes seen, none between them."""
    df, states = _mixed(spark, d)
    return LangevinBaseline(["o_totalprice", "o_orderstatus"], "o_orderstatus", "classification").fit(df, "o_orderkey").sample(spark, N, 7)


def light_generate_quality(spark, d):
    """Distance of the generated rows from the real ones, by column."""
    real = scaled_lines(spark, d)
    return metrics.wasserstein_by_column(real, solver("light", COLS).fit(real, "row_key").sample(spark, N, 7), COLS)


TREES = {"trees": 15, "depth": 4}
MLPS = {"epochs": 1, "hidden": (32, 32)}
QUERIES = {
    q.__name__: q
    for q in (
        _generate("light"),
        _generate("imf_continuous_trees", params=TREES),
        _generate("imf_discrete_trees", params=TREES, steps=6),
        _generate("imf_discrete_featurewise", params=TREES, steps=6),
        _generate("imf_continuous_mlp", params=MLPS),
        _generate("imf_discrete_mlp", params=MLPS, steps=6),
        _generate("ipf_continuous_trees", params=TREES),
        _generate("ipf_discrete_trees", params=TREES),
        _generate("ipf_continuous_mlp", params=MLPS),
        _generate("ipf_discrete_mlp", params=MLPS),
        structure_edges,
        ipf_discrete_structural_generate,
        ipf_continuous_structural_generate,
        categorical_generate,
        mixed_generate,
        copula_generate,
        ddpm_generate,
        score_generate,
        ddpm_resnet_generate,
        adversarial_generate,
        langevin_generate,
        langevin_class_generate,
        light_generate_quality,
    )
}


def _summary(name: str, real, cols: list[str], states=()):
    """One row per column: rows, missing values, and whether range, mean and spread fit the real rows. Numeric columns
    may leave the real range by three deviations, means may differ by half of one, spreads by a factor of two; codes
    must be whole and seen."""
    query = QUERIES[name]

    def summary(spark, d):
        out, truth = query(spark, d), real(spark, d)
        stats = lambda df: df.agg(*[F.struct(F.lit(c).alias("col"), F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")), 1).otherwise(0)).alias("bad"), F.min(c).alias("lo"), F.max(c).alias("hi"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.bool_and(F.col(c) == F.rint(c)).alias("whole")) for c in cols]).collect()[0]
        rows = []
        for a, b in zip(stats(out), stats(truth)):
            free = 0.0 if a.col in states else 3 * b.std
            inside = b.lo - free <= a.lo and a.hi <= b.hi + free and (a.col not in states or a.whole)
            rows.append((a.col, a.n, a.bad, bool(inside), abs(a.mean - b.mean) <= 0.5 * b.std, 0.5 * b.std <= a.std <= 2 * b.std))
        return spark.createDataFrame(rows, "col string, n bigint, missing bigint, in_range boolean, mean_fits boolean, spread_fits boolean")

    summary.__name__ = name.replace("_generate", "_summary")
    return summary


_categories = lambda *cols: (lambda spark, d: _mixed(spark, d)[0].select(*[F.col(c).cast("double") for c in cols]))
_CODES = ("o_orderpriority", "o_orderstatus")
_SUMMARIES = [_summary(n, scaled_lines, COLS) for n in QUERIES if n.endswith("_generate") and "structural" not in n and n not in ("categorical_generate", "mixed_generate", "ddpm_generate", "ddpm_resnet_generate", "langevin_class_generate")]
_SUMMARIES += [_summary(f"ipf_{t}_structural_generate", dependent_lines, DEPENDENT) for t in ("discrete", "continuous")]
_SUMMARIES += [_summary("categorical_generate", _categories(*_CODES), list(_CODES), _CODES)]
_SUMMARIES += [_summary(n, _categories("o_totalprice", *_CODES), ["o_totalprice", *_CODES], _CODES) for n in ("mixed_generate", "ddpm_generate", "ddpm_resnet_generate")]
_SUMMARIES += [_summary("langevin_class_generate", _categories("o_totalprice", "o_orderstatus"), ["o_totalprice", "o_orderstatus"], ("o_orderstatus",))]


def kfold_metrics(spark, d):
    """The k-fold driver with the copula: each fold's sizes, and whether its distances are near those of the real rows."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    out = evaluation.kfold_evaluate(p, "parts", TabularSchema(continuous=("p_size",), target="p_retailprice"), lambda cols: CopulaBaseline(cols), "p_partkey", 3)
    return out.select("dataset", "fold", "n_train", "n_test", F.col("avg_wd").between(0, 0.5).alias("wd_near"), F.col("avg_kl").between(0, 5).alias("kl_near"), F.col("corr_frob").between(0, 1).alias("corr_near"))


def tuning_study(spark, d):
    """A seeded study whose objective is the distance of a copula's scaled sample; some trials fail by design."""
    goal = table(spark, d, "supplier").agg(F.avg("s_acctbal")).collect()[0][0]

    def objective(params):
        if params["kind"] == "bad":
            raise ValueError("no such kind")
        return abs(params["level"] - goal) / 1e4

    out = evaluation.search(spark, objective, {"level": evaluation.Range(0.0, 10_000.0), "kind": evaluation.Choice(("good", "fine", "bad"))}, 24, 5)
    failed = F.col("state") == "fail"
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("number").alias("numbers"), F.bool_and(failed == (F.col("value") == float("inf"))).alias("failures_are_last"), F.bool_and(failed == F.col("error").isNotNull()).alias("errors_kept"), (F.min("value") <= 0.1).alias("near"))


def tuning_study_tpe(spark, d):
    """A study of 40 trials by the Parzen sampler with pruning: complete, as seeded, and near the goal."""
    goal = table(spark, d, "supplier").agg(F.avg("s_acctbal")).collect()[0][0]
    space = {"level": evaluation.Range(0.0, 10_000.0), "kind": evaluation.Choice(("good", "poor"))}
    out = evaluation.search(spark, lambda p: abs(p["level"] - goal) / 1e4 + (p["kind"] == "poor"), space, 40, 5, sampler="tpe", prune=True)
    best = evaluation.best_trial(out).select(F.col("value").alias("least"))
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("number").alias("numbers"), F.bool_and(F.col("state").isin("complete", "pruned")).alias("all_ran")).join(F.broadcast(best), F.lit(True)).select("n", "numbers", "all_ran", (F.col("least") <= 0.05).alias("near"))


def utility_of_copy(spark, d):
    """Utility of a copy of the train rows: both regressors are the same, so their R2 don't differ."""
    p = table(spark, d, "part").select("p_partkey", "p_size", F.col("p_retailprice").alias("price"), (F.col("p_retailprice") * 2 + F.col("p_size")).alias("y"))
    train, test = p.filter("p_partkey % 4 <> 0"), p.filter("p_partkey % 4 = 0")
    out = evaluation.utility_delta(train, test, train, ["p_size", "price"], "y", "p_partkey", "p_partkey")
    return spark.createDataFrame([(out["r2_real"] == out["r2_synth"], out["delta_r2_percent"], out["r2_real"] > 0.8)], "same boolean, delta double, learned boolean")


def _fields_table(spark, fields: dict, direction: str):
    rows = [(direction, k, float(f.weights[0, 0]), float(f.weights[1, 0])) for (_, k), f in sorted(fields.items())]
    return spark.createDataFrame(rows, "direction string, step int, intercept double, slope double")


LINEAR = {"steps": 4, "sigma": 0.8}


def imf_linear_fields(spark, d):
    """Iterative Markovian fitting of order totals with a linear field per step: what both directions have learned from all rows. The
    forward fields are fitted to the coupling that walking the backward ones has made."""
    o = table(spark, d, "orders").select("o_orderkey", ((F.col("o_totalprice") - 150000) / 80000).alias("z"))
    model = ImfSolver(["z"], "linear", "discrete", sequence=("b", "f"), **LINEAR).fit(o, "o_orderkey")
    both = [_fields_table(spark, model.fields[way], way) for way in ("b", "f")]
    out = both[0].unionByName(both[1])
    return out.select("direction", "step", F.round("intercept", 5).alias("intercept"), F.round("slope", 5).alias("slope"))


def _linear_sql() -> str:
    """The same by regr_slope over the pairs of each step, and the walk as nested selects."""
    steps, sigma = LINEAR["steps"], LINEAR["sigma"]
    t = [(k + 0.5) / steps for k in range(steps)]

    def learned(way: str, salt: int) -> str:
        target = {"b": "a - b - {s} * sqrt((1 - t) / t) * e", "f": "b - a - {s} * sqrt(t / (1 - t)) * e"}[way].format(s=f"{sigma!r}::double")
        return f"""(SELECT k, regr_intercept(y, x) AS i, regr_slope(y, x) AS s FROM (SELECT k, (1 - t) * a + t * b + {sigma!r}::double * sqrt(t * (1 - t)) * e AS x, {target} AS y
            FROM (SELECT id, a, b, k, ({t}::double[])[k + 1] AS t, {n_sql(f'imf0:e{salt}:0', 'id', 'k', "'0'")} AS e FROM {{pairs}}, range({steps}) r(k))) GROUP BY k)"""

    walk = "(SELECT id, b, b AS x FROM pairs0)"
    for i in range(steps):
        k = steps - 1 - i
        noise = f" + {sigma!r}::double * sqrt(1 / {steps}.0::double) * {n_sql(f'imf0:path1:{i}:0', 'id')}" if i < steps - 1 else ""
        walk = f"(SELECT id, b, x + ((SELECT i FROM back WHERE k = {k}) + (SELECT s FROM back WHERE k = {k}) * x) / {steps}{noise} AS x FROM {walk})"
    return f"""WITH pairs0 AS MATERIALIZED (SELECT id, a, {n_sql('imf0:prior0', 'id')} AS b FROM (SELECT o_orderkey::varchar AS id, (o_totalprice - 150000) / 80000 AS a FROM orders)),
        back AS MATERIALIZED {learned('b', 0).replace('{pairs}', 'pairs0')},
        pairs1 AS MATERIALIZED (SELECT id, x AS a, b FROM {walk}),
        ahead AS MATERIALIZED {learned('f', 1).replace('{pairs}', 'pairs1')}
        SELECT 'b' AS direction, k::int AS step, round(i, 5) AS intercept, round(s, 5) AS slope FROM back
        UNION ALL SELECT 'f', k::int, round(i, 5), round(s, 5) FROM ahead"""


QUERIES |= {q.__name__: q for q in (*_SUMMARIES, imf_linear_fields, kfold_metrics, tuning_study, tuning_study_tpe, utility_of_copy)}
_fits = lambda cols: " UNION ALL ".join(f"SELECT '{c}' AS col, {N}::bigint AS n, 0::bigint AS missing, true AS in_range, true AS mean_fits, true AS spread_fits" for c in cols)
ORACLES: dict[str, str] = {q.__name__: _fits(COLS) for q in _SUMMARIES}
ORACLES |= {f"ipf_{t}_structural_summary": _fits(DEPENDENT) for t in ("discrete", "continuous")}
ORACLES |= {"categorical_summary": _fits(_CODES), "mixed_summary": _fits(("o_totalprice", *_CODES)), "ddpm_summary": _fits(("o_totalprice", *_CODES)), "ddpm_resnet_summary": _fits(("o_totalprice", *_CODES)), "langevin_class_summary": _fits(("o_totalprice", "o_orderstatus"))}
ORACLES |= {
    "imf_linear_fields": _linear_sql(),
    "kfold_metrics": "SELECT 'parts' AS dataset, f AS fold, (SELECT count(*) FROM p) - count(*) AS n_train, count(*) AS n_test, true AS wd_near, true AS kl_near, true AS corr_near FROM (SELECT (ntile(3) OVER (ORDER BY md5('42|' || p_partkey), p_partkey) - 1)::int AS f FROM part) GROUP BY f".replace("(SELECT count(*) FROM p)", "(SELECT count(*) FROM part)"),
    "tuning_study": "SELECT 24::bigint AS n, 24::bigint AS numbers, true AS failures_are_last, true AS errors_kept, true AS near",
    "tuning_study_tpe": "SELECT 40::bigint AS n, 40::bigint AS numbers, true AS all_ran, true AS near",
    "utility_of_copy": "SELECT true AS same, 0.0::double AS delta, true AS learned",
}
