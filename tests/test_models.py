"""Fields, solvers, baselines, evaluation, sources and streams on small data."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.functions.rand import normal
from tabweave.operators import fields
from tabweave.operators.adversarial import AdversarialBaseline, Critic, modes_of
from tabweave.operators.baselines import CopulaBaseline, DiffusionBaseline, LangevinBaseline, ScoreBaseline, snap_to
from tabweave.operators.schema import TabularSchema
from tabweave.operators.solvers import CategoricalSolver, ImfSolver, IpfSolver, LightSolver, learn_structure, solver, topological
from tabweave.operators.transforms import StandardScaler
from tabweave.plans import evaluation
from tabweave.sources import readers
from tabweave.streaming.apply import apply_pipeline, read_stream


@pytest.fixture(scope="module")
def data(spark):
    """Two dependent, scaled columns: y follows x."""
    df = spark.range(1500).withColumn("x", normal("x", F.col("id")))
    return df.withColumn("y", 0.8 * F.col("x") + 0.6 * normal("y", F.col("id"))).cache()


@pytest.mark.parametrize("kind,params", [("ridge", {}), ("trees", {"trees": 60}), ("mlp", {"steps": 600})])
def test_fields_learn(kind, params):
    rng = np.random.default_rng(0)
    x = rng.uniform(-2, 2, (2000, 2))
    y = np.stack([np.sin(2 * x[:, 0]), x[:, 0] * x[:, 1]], 1)
    p = fields.make_field(kind, **params).fit(x, y).predict(x)
    assert 1 - ((y - p) ** 2).sum() / ((y - y.mean(0)) ** 2).sum() > 0.85


def test_ridge_over_partitions(spark, data):
    model = fields.ridge_over(data.repartition(5), ["x"], ["y"], fields.RidgeField(20))
    m = fields.bounded_matrix(data, "id", ["x", "y"], 10**6)
    assert model.predict(m[:5, :1]) == pytest.approx(fields.RidgeField(20).fit(m[:, :1], m[:, 1:]).predict(m[:5, :1]), abs=1e-6)


def moments(df, cols):
    m = np.array([[r[c] for c in cols] for r in df.collect()])
    return m.mean(0), m.std(0), np.corrcoef(m.T)[0, 1]


FAST = {"trees": 12}


@pytest.mark.parametrize(
    "make",
    [
        lambda: LightSolver(["x", "y"]),
        lambda: LightSolver(["x", "y"], sde_steps=40),
        lambda: ImfSolver(["x", "y"], params=FAST),
        lambda: ImfSolver(["x", "y"], "trees", "discrete", "featurewise", params=FAST),
        lambda: IpfSolver(["x", "y"], params=FAST),
        lambda: IpfSolver(["x", "y"], "trees", "discrete", "featurewise", parents={"y": ["x"]}, params=FAST),
        lambda: CopulaBaseline(["x", "y"]),
        lambda: DiffusionBaseline(["x", "y"], inner=800),
        lambda: ScoreBaseline(["x", "y"], inner=800),
    ],
)
def test_generators_match_moments(spark, data, make):
    model = make().fit(data, "id")
    out = model.sample(spark, 800, 3)
    mean, std, corr = moments(out, ["x", "y"])
    assert np.abs(mean).max() < 0.3 and np.abs(std - 1).max() < 0.35 and corr > 0.45
    assert sorted(map(tuple, model.sample(spark, 50, 3).repartition(4).collect())) == sorted(map(tuple, out.filter("row_id < 50").collect()))


def test_categorical_and_mixed(spark, data):
    df = data.select("id", "x", (F.col("x") > 0.5).cast("int").alias("c"))
    out = CategoricalSolver(["x", "c"], {"c": 2}, inner=300).fit(df, "id").sample(spark, 600, 1).collect()
    c, x = np.array([r.c for r in out]), np.array([r.x for r in out])
    assert set(c) <= {0.0, 1.0} and abs(c.mean() - 0.31) < 0.12 and x[c == 1].mean() - x[c == 0].mean() > 0.6


def test_context_and_structure(spark, data):
    with pytest.raises(ValueError):
        ImfSolver(["x", "y"], structure="featurewise", context={"x": ["y"]})
    with pytest.raises(ValueError):
        ImfSolver(["x", "y"], structure="featurewise", order=("x",))
    parents = learn_structure(data.withColumn("z", normal("z", F.col("id"))), ["x", "y", "z"])
    assert parents["z"] == [] and sum(map(len, parents.values())) == 1
    assert topological(["a", "b", "c"], {"a": ["b"], "b": ["c"]}) == ["c", "b", "a"]
    assert len(topological(["a", "b"], {"a": ["b"], "b": ["a"]})) == 2
    assert snap_to(np.array([0.4, 0.5, 9.0]), np.array([0.0, 1.0])).tolist() == [0.0, 0.0, 1.0]
    assert type(solver("light", ["x"])).__name__ == "LightSolver"


def test_copula_reads_all_rows(spark):
    df = spark.range(60_000).select("id", (F.col("id") % 997).cast("double").alias("x"), F.when(F.col("id") == 59_999, 7.0).otherwise(F.col("id") % 3).alias("k")).repartition(5)
    model = CopulaBaseline(["x", "k"], ["k"]).fit(df, "id")
    assert model.supports["k"].tolist() == [0.0, 1.0, 2.0, 7.0] and model.quantiles[[0, -1], 0].tolist() == [0.0, 996.0]
    with pytest.raises(ValueError):
        CopulaBaseline(["x"], ["x"], most_values=10).fit(df, "id")


def test_structure_over_many_columns(spark):
    """Candidates by shared information give the edges of the exhaustive search, and a table of 40 columns can be searched."""
    df = spark.range(2000).withColumn("c0", normal("s0", F.col("id")))
    for k in range(1, 8):
        df = df.withColumn(f"c{k}", 0.9 * F.col(f"c{k - 1}") + 0.4 * normal(f"s{k}", F.col("id")))
    cols = [f"c{k}" for k in range(8)]
    whole = learn_structure(df, cols, candidates=7)
    assert learn_structure(df, cols, candidates=4) == whole and sum(map(len, whole.values())) >= 7
    wide = df.select("*", *[normal(f"w{k}", F.col("id")).alias(f"w{k}") for k in range(32)]).limit(800)
    found = learn_structure(wide, cols + [f"w{k}" for k in range(32)], bins=3, candidates=3)
    edges = {frozenset((p, c)) for c, ps in found.items() for p in ps}
    assert {frozenset((f"c{k}", f"c{k + 1}")) for k in range(7)} <= edges


def test_structure_of_dependent_columns(spark, sf):
    from tabweave.plans.q_models import structure_edges

    edges = {frozenset((r.parent, r.child)) for r in structure_edges(spark, sf).collect()}
    assert frozenset(("l_quantity", "l_value")) in edges


def test_kfold_driver_and_search(spark, data):
    rows = evaluation.kfold_evaluate(data.limit(600), "toy", TabularSchema(continuous=("x",), target="y"), lambda cols: CopulaBaseline(cols), "id", k=2)
    got = rows.collect()
    assert [r.fold for r in got] == [0, 1] and all(0 <= r.avg_wd < 0.4 and r.n_train == 300 for r in got)
    again = evaluation.kfold_evaluate(data.limit(600), "toy", TabularSchema(continuous=("x",), target="y"), None, "id", k=2, done=rows)
    assert again.count() == 2

    def objective(p):
        if p["a"] > 0.4:
            raise ValueError("no")
        return p["a"]

    out = evaluation.search(spark, objective, {"a": evaluation.Range(0.0, 1.0), "b": evaluation.Choice(("p", "q"))}, 12, 1).collect()
    assert out == sorted(out, key=lambda r: (r.value, r.number)) and {r.state for r in out} == {"complete", "fail"} and out[-1].value == float("inf")
    assert all(len(evaluation.layer_widths(np.random.default_rng(i))) in (2, 4, 6, 8) for i in range(20))
    table = spark.createDataFrame([("d", "m1", "0.5 ± 0.1"), ("d", "m2", "-0.2 ± 0.1"), ("d", "m3", "none")], "d string, m string, r2 string")
    assert [(r.m, r.avg_rank) for r in evaluation.compare_models(table, "d", "m", "r2").collect()] == [("m2", 1.0), ("m1", 2.0)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x;y\n1;2\nbad;4\n")
    df = readers.read_csv(spark, f"file://{tmp_path}/a.csv", {"x": "z"}, ["z"])
    assert [r.z for r in df.collect()] == [1.0, None] and df.columns == ["z", "y"]
    readers.write_bundle({"t": df}, f"file://{tmp_path}/b")
    assert readers.read_bundle(spark, f"file://{tmp_path}/b", ["t"])["t"].count() == 2
    assert readers.existing(spark, f"file://{tmp_path}/none") is None and readers.existing(spark, f"file://{tmp_path}/b/t.parquet").count() == 2
    assert readers.table_metadata(readers.with_table_metadata(df, "z", "regression")) == {"target": "z", "task": "regression"}
    assert readers.best_params('{"best_params": {"a": 1}}') == {"a": 1} and readers.best_params('{"a": 2, "b": {}}') == {"a": 2}
    left = spark.createDataFrame([(0, 1)], "row int, y int")
    assert readers.append_features_target(left, spark.createDataFrame([(0, 9)], "row int, y int"), "row").columns == ["row", "y", "target__y"]
    readers.append_trials(df, f"file://{tmp_path}/trials")
    readers.append_trials(df, f"file://{tmp_path}/trials")
    assert readers.existing(spark, f"file://{tmp_path}/trials").count() == 4
    assert readers.two_moons(spark, 100).select("target").distinct().count() == 2


def test_stream_applies_fitted_state(spark, data, tmp_path):
    src, out = f"file://{tmp_path}/in", f"file://{tmp_path}/out"
    data.select("id", "x").repartition(3).write.parquet(src)
    scaler = StandardScaler().fit(data, TabularSchema(continuous=("x",)))
    apply_pipeline(read_stream(spark, src, data.select("id", "x").schema, 1), [scaler.state()], out, f"file://{tmp_path}/check").awaitTermination(120)
    got = spark.read.parquet(out).agg(F.count("*"), F.avg("x"), F.stddev_pop("x")).collect()[0]
    assert got[0] == 1500 and abs(got[1]) < 1e-9 and got[2] == pytest.approx(1)


def test_row_helpers(spark):
    from tabweave.operators import rows

    df = spark.createDataFrame([(0, 1.0), (1, float("nan")), (2, None)], "id int, x double")
    assert rows.without_nan(df).count() == 1
    with pytest.raises(ValueError):
        rows.require_no_nan(df)
    rep = rows.repeat_rows(df, 3)
    assert rep.count() == 9 and rep.select("rep").distinct().count() == 3
    ids = spark.createDataFrame([(10,), (11,)], "key int")
    out = rows.reattach_ids(spark.range(5).withColumnRenamed("id", "row_id"), "row_id", ids, "key", 1)
    assert out.count() == 5 and {r.key for r in out.collect()} <= {10, 11}
    assert rows.restore_order(df.select("x", "id"), ["id"]).columns == ["id", "x"]


def _slope(f, p):
    out = np.zeros_like(p)
    for i in np.ndindex(p.shape):
        kept = p[i]
        p[i] = kept + 1e-6
        high = f()
        p[i] = kept - 1e-6
        out[i], p[i] = (high - f()) / 2e-6, kept
    return out


def test_gradients_of_residual_net_and_critic():
    rng = np.random.default_rng(0)
    net, x, t = fields.ResNet(3, 5, 2, 2), rng.normal(size=(7, 3)), rng.normal(size=(7, 2))
    out, kept = net.forward(x)
    for p, g in zip([p for q in zip(net.w, net.b) for p in q], net.backward(kept, 2 * (out - t))):
        assert np.allclose(g, _slope(lambda: ((net.forward(x)[0] - t) ** 2).sum(), p), atol=1e-5)
    critic, x = Critic([4, 6, 5, 1], 1), rng.normal(size=(9, 4))
    for p, g in zip([p for q in zip(critic.w, critic.b) for p in q], critic.penalty(x)[1]):
        assert np.allclose(g, _slope(lambda: critic.penalty(x)[0], p), atol=1e-5)


def test_modes():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(-3, 0.3, 2000), rng.normal(4, 0.5, 1000)])
    share, mean, _ = modes_of(x, 2)
    assert np.allclose(np.sort(mean), [-3, 4], atol=0.1) and np.allclose(np.sort(share), [1 / 3, 2 / 3], atol=0.02)
    assert len(modes_of(np.full(5, 2.0))[1]) == 1


def test_adversarial_and_langevin(spark):
    rng = np.random.default_rng(2)
    a, d = rng.normal(size=1500), rng.choice([0.0, 1.0, 2.0], 1500, p=[0.6, 0.3, 0.1])
    df = spark.createDataFrame([(i, float(p + 2 * q), float(q)) for i, (p, q) in enumerate(zip(a, d))], "id long, a double, d double")
    for model in (AdversarialBaseline(["a", "d"], ["d"], inner=600), LangevinBaseline(["a", "d"], "d", "classification")):
        fitted = model.fit(df, "id")
        out = fitted.sample(spark, 600, 3).orderBy("row_id").toPandas()
        assert set(out["d"]) <= {0.0, 1.0, 2.0} and len(set(out["d"])) == 3
        assert abs(out["d"].mean() - 0.5) < 0.15 and np.corrcoef(out["a"], out["d"])[0, 1] > 0.4
        assert (fitted.sample(spark, 300, 3).orderBy("row_id").toPandas() == out.head(300)).all(None)
        with pytest.raises(ValueError):
            model.fit(df.limit(0), "id")


def test_constant_column(spark):
    df = spark.range(50).selectExpr("id", "2.0D as a", "1.0D as d")
    for model in (AdversarialBaseline(["a", "d"], ["d"], inner=5), LangevinBaseline(["a", "d"])):
        out = model.fit(df, "id").sample(spark, 20, 1).toPandas()
        assert np.allclose(out["a"], 2, atol=0.05) and np.allclose(out["d"], 1, atol=0.05)


def test_parzen_search(spark):
    space = {"x": evaluation.Range(1e-3, 10.0, log=True), "n": evaluation.Range(1, 9, whole=True), "k": evaluation.Choice(("a", "b"))}
    goal = lambda p: abs(np.log(p["x"] / 0.5)) + abs(p["n"] - 4) / 4 + (p["k"] == "a")
    runs = [evaluation.search(spark, goal, space, 40, seed, sampler="tpe").collect() for seed in range(3)]
    plain = [evaluation.search(spark, goal, space, 40, seed).collect() for seed in range(3)]
    late = lambda rows: np.mean([r["value"] for r in rows if r["number"] >= 10])
    assert all(late(a) < late(b) for a, b in zip(runs, plain))
    assert runs[0] == evaluation.search(spark, goal, space, 40, 0, sampler="tpe").collect()
    pruned = evaluation.search(spark, goal, space, 30, 1, sampler="tpe", prune=True)
    assert evaluation.best_trial(pruned).collect()[0]["state"] == "complete"
    nan = evaluation.search(spark, lambda p: float("nan"), space, 12, 1, sampler="tpe").collect()
    assert len(nan) == 12 and {r["state"] for r in nan} == {"fail"}
    with pytest.raises(ValueError):
        evaluation.search(spark, goal, space, 3, sampler="grid")


def test_folds_are_dealt_once(spark, data, monkeypatch):
    dealt, real = [], evaluation.stored
    monkeypatch.setattr(evaluation, "stored", lambda df, name: dealt.append(name) or real(df, name))
    out = evaluation.kfold_evaluate(data, "toy", TabularSchema(continuous=("x", "y")), lambda cols: CopulaBaseline(cols), "id", 3)
    assert dealt == ["folds"] and out.count() == 3
