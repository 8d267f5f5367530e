"""Metrics and processes against NumPy derivations and their own invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.functions import scalars
from tabweave.functions.rand import normal, uniform
from tabweave.operators import metrics
from tabweave.operators import process as P


def frame(spark, **cols):
    n = len(next(iter(cols.values())))
    return spark.createDataFrame([tuple(float(c[i]) for c in cols.values()) for i in range(n)], ", ".join(f"{k} double" for k in cols))


def w1(a, b):
    v = np.sort(np.concatenate([a, b]))
    f = lambda s: np.searchsorted(np.sort(s), v[:-1], side="right") / len(s)
    return float((np.abs(f(a) - f(b)) * np.diff(v)).sum())


def test_wasserstein(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=700), np.round(rng.exponential(size=431), 1)
    got = metrics.wasserstein_by_column(frame(spark, x=a), frame(spark, x=b), ["x"]).collect()[0].wd
    assert got == pytest.approx(w1(a, b))
    assert metrics.wasserstein_by_column(frame(spark, x=a), frame(spark, x=a), ["x"]).collect()[0].wd == pytest.approx(0)
    assert metrics.wasserstein_by_column(frame(spark, x=[0.0]), frame(spark, x=[1.0]), ["x"]).collect()[0].wd == pytest.approx(1)


def test_wasserstein_sees_one_set_of_edges(spark):
    """Approximate percentiles may differ each time they are taken: the plan must take them once."""
    a = frame(spark, x=np.arange(50))
    plan = metrics.wasserstein_by_column(a, a, ["x"])._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile_approx" not in plan


def test_average_rank_adds_in_the_order_of_events(spark, tmp_path):
    from tabweave.plans.q_metrics import average_rank

    rng = np.random.default_rng(0)
    folder, rows = tmp_path / "events.parquet", []
    for user in range(200):
        cents = rng.integers(0, 300, 15)
        rows += [(16 * user + i, user, "view", int(c) / 100) for i, c in enumerate([*cents, 4000 - cents.sum()])]  # means of 2.5
    for part in (0, 1):  # events are dealt to two files in turn
        spark.createDataFrame([r for r in rows if r[0] % 2 == part], "event_id long, user_id long, event_type string, value double").coalesce(1).write.mode("append").parquet(f"file://{folder}")
    score = {}
    for _, user, _, v in rows:
        score[user] = score.get(user, 0.0) + v
    score = {u: np.floor(s / 16 + 0.5) for u, s in score.items()}
    assert len(set(score.values())) == 2
    low = sum(s == 2 for s in score.values())
    want = {u: (low + 1) / 2 if s == 2 else low + (200 - low + 1) / 2 for u, s in score.items()}
    assert {r.user_id: r.avg_rank for r in average_rank(spark, f"file://{tmp_path}").collect()} == want


def test_average_rank_of_equal_event_ids_and_missing_values(spark, tmp_path):
    """Events of one id are all added; an entity without a value comes last, as in the SQL."""
    import duckdb

    from tabweave.plans.q_metrics import ORACLES, average_rank

    rows = [(7, user, "view", float(v)) for user in range(40) for v in ((user * 7) % 40, 100, (user * 3) % 11)] + [(8, 40, "view", None), (9, 41, "view", 1e6)]
    df = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted(con.sql(ORACLES["average_rank"]).fetchall())
    assert sorted(tuple(r) for r in average_rank(spark, f"file://{tmp_path}").collect()) == want


def test_histogram_kl_on_edges(spark):
    a, b = np.arange(11) / 100, np.array([0.0, 0.1, 0.1, 0.05])
    p, q = (np.histogram(x, np.linspace(0, 0.1, 21))[0] + 1e-12 for x in (a, b))
    p, q = p / p.sum(), q / q.sum()
    got = metrics.histogram_kl_by_column(frame(spark, x=a), frame(spark, x=b), ["x"]).collect()[0].kl
    assert got == pytest.approx(float((p * (np.log(p) - np.log(q))).sum()))
    assert metrics.histogram_kl_by_column(frame(spark, x=[1.0]), frame(spark, x=[1.0]), ["x"]).collect()[0].kl == 0


def test_correlation_and_js(spark):
    rng = np.random.default_rng(1)
    m, n = rng.normal(size=(300, 3)), rng.normal(size=(300, 3))
    n[:, 2] += n[:, 0]
    got = metrics.correlation_frobenius(frame(spark, a=m[:, 0], b=m[:, 1], c=m[:, 2]), frame(spark, a=n[:, 0], b=n[:, 1], c=n[:, 2]), ["a", "b", "c"]).collect()[0][0]
    assert got == pytest.approx(np.linalg.norm(np.corrcoef(m.T) - np.corrcoef(n.T)))
    one, two = (spark.createDataFrame([(x,) for x in s], "c string") for s in ("aab", "bbb"))
    js = metrics.js_by_column(one, two, ["c"]).collect()[0].js
    assert 0 < js < np.log(2) and metrics.js_by_column(one, one, ["c"]).collect()[0].js == pytest.approx(0)


@pytest.mark.parametrize("states", [2, 3, 5])
@pytest.mark.parametrize("kind", ["uniform", "ordered"])
def test_kernels(states, kind):
    for k in (0, 1, 29, 30):
        q = P.CategoricalReference(states, 30, 0.2, kind).powers[k]
        assert q.sum(1) == pytest.approx(1) and (q >= 0).all()
    assert P.CategoricalReference(states, 30, 0.2, kind).powers[0].tolist() == np.eye(states).tolist()


@pytest.mark.parametrize("kind", ["uniform", "ordered"])
def test_bridges(spark, kind):
    ref = P.CategoricalReference(4, 6, 0.2, kind)
    q = ref.powers
    row = spark.range(1).select(ref.bridge(F.lit(1), F.lit(3), F.lit(0)).alias("start"), ref.bridge(F.lit(1), F.lit(3), F.lit(2)).alias("mid"), ref.next_given_prev(F.lit(1), F.lit(3), F.lit(2)).alias("nxt"), ref.prev_given_next(F.lit(0), F.lit(2), F.lit(3)).alias("prv"), ref.model_next(F.lit(1), F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)]), F.lit(2)).alias("model"), ref.model_prev(F.lit(1), F.array(*[F.lit(x) for x in (0.1, 0.2, 0.3, 0.4)]), F.lit(2)).alias("back")).collect()[0]
    assert row.start == pytest.approx([0, 1, 0, 0])
    assert row.mid == pytest.approx((q[2][1] * q[4][:, 3] / q[6][1, 3]).tolist())
    assert row.nxt == pytest.approx((q[1][1] * q[3][:, 3] / q[4][1, 3]).tolist())
    assert row.prv == pytest.approx((q[2][0] * q[1][:, 2] / q[3][0, 2]).tolist())
    w = [0.1, 0.2, 0.3, 0.4]
    want = sum(w[e] * q[1][1] * q[3][:, e] / q[4][1, e] for e in range(4))
    assert row.model == pytest.approx((want / want.sum()).tolist())
    want = sum(w[e] * q[1][e] * q[1][:, 1] / q[2][e, 1] for e in range(4))
    assert row.back == pytest.approx((want / want.sum()).tolist())


def test_noise_is_keyed_by_row(spark):
    pick = lambda df: sorted((r.id, r.u, r.z) for r in df.select("id", uniform("a", F.col("id")).alias("u"), normal("a", F.col("id")).alias("z")).collect())
    one = pick(spark.range(4000).coalesce(1))
    assert one == pick(spark.range(4000).repartition(7))
    z = np.array([r[2] for r in one])
    assert abs(z.mean()) < 0.06 and abs(z.std() - 1) < 0.05 and 0 < min(r[1] for r in one) and max(r[1] for r in one) < 1


def test_grids_and_terms(spark):
    g = P.TimeGrid(9, 1e-3, 1e-1)
    rows = g.table(spark).orderBy("k").collect()
    assert [r.gamma for r in rows] == pytest.approx(g.gamma.tolist()) and rows[-1].t == pytest.approx(g.total) and rows[-1].remaining == pytest.approx(0)
    for bad in ((1, 1e-3, 1e-1, "geom"), (3, 0, 1, "geom"), (3, 2, 1, "geom"), (3, 0.1, 1, "x")):
        with pytest.raises(ValueError):
            P.TimeGrid(*bad)
    with pytest.raises(ValueError):
        scalars.time_embedding(F.lit(0.0), 3)
    for kind in ("linear", "cosine"):
        assert [r.beta for r in P.beta_schedule(spark, kind, 20).orderBy("k").collect()] == pytest.approx(P.betas(kind, 20).tolist())


def test_light_potential_matches_numpy(spark):
    pot = P.LightPotential((0.1, -0.4), ((0.0, 1.0), (2.0, -1.0)), ((0.5, 1.0), (1.5, 0.2)), 0.7)
    x = np.array([0.3, -0.8])
    c = [a + (x * x @ s + 2 * x @ r) / 1.4 for a, r, s in zip(np.array(pot.log_alpha), np.array(pot.r), np.array(pot.s))]
    got = spark.range(1).select(pot.log_c([F.lit(0.3), F.lit(-0.8)]).alias("c")).collect()[0].c
    assert got == pytest.approx(np.log(np.exp(c).sum()))


def test_coupling_keeps_every_row(spark):
    from tabweave.operators.process import independent_coupling

    df, few = spark.range(50).withColumnRenamed("id", "k"), spark.range(7).withColumnRenamed("id", "k")
    out = independent_coupling(df, few, "k", 3).collect()
    assert sorted(r.k for r in out) == list(range(50)) and {r.k_prior for r in out} == set(range(7))
    with pytest.raises(ValueError):
        independent_coupling(df, few.filter("k < 0"), "k", 3)


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_noise_of_a_path_stands_once_in_its_plan(spark, sf):
    from tabweave.plans.q_process import QUERIES

    assert optimized(QUERIES["euler_ou_path"](spark, sf)).count("md5(") == 10


def test_kernel_weights_stand_once(spark):
    ref, df = P.CategoricalReference(4, 6, 0.2), spark.range(3).selectExpr("cast(id as int) a", "cast(id + 1 as int) b", "array(0.1D * id, 0.2D, 0.3D, 0.4D) w")
    assert optimized(df.select(ref.next_given_prev(F.col("a"), F.col("b"), F.lit(2)).alias("p"))).count("CASE WHEN") == 8
    # the normaliser, the near kernel and the far one
    assert optimized(df.select(ref.model_next(F.col("a"), F.col("w"), F.lit(2)).alias("p"))).count("CASE WHEN") == 3
    assert optimized(df.select(P.softmax(F.col("w")).alias("p"))).lower().count("exp(") == 1


def test_draws_at_a_fixed_step_are_those_of_its_probabilities(spark):
    values = F.array(*[F.lit(x) for x in (None, -1, 0, 1, 2, 3, 4)])
    rows = spark.range(20).select("id", F.explode(values).alias("a")).select("id", "a", F.explode(values).alias("b")).withColumn("u", uniform("u", F.col("id"), F.coalesce("a", F.lit(9)), F.coalesce("b", F.lit(9))))
    for states, steps, kind in ((4, 5, "uniform"), (2, 5, "uniform"), (4, 5, "ordered")):
        ref = P.CategoricalReference(states, steps, 0.3, kind)
        some = rows if kind == "uniform" else rows.filter("a between 0 and 3 and b between 0 and 3")
        for n in (0, steps - 2, steps - 1):
            pairs = some.select(ref.next_drawn(F.col("a"), F.col("b"), n, F.col("u")), P.draw(ref.next_given_prev(F.col("a"), F.col("b"), F.lit(n)), F.col("u"))).collect()
            assert pairs and all(x == y for x, y in pairs)
