"""Queries of the bridge processes, each with its SQL; noise is the same hash in both engines."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import functions as F

from tabweave.functions import scalars
from tabweave.functions.rand import normal, uniform
from tabweave.operators import process as P
from tabweave.operators.stages import spread
from tabweave.plans.q_transforms import r
from tabweave.sources.readers import table

GRID = P.TimeGrid(5, 0.01, 0.2)
REF = P.CategoricalReference(5, 10, 0.08)
LIGHT = P.LightPotential((math.log(0.3), math.log(0.7)), ((-0.5, 0.25), (1.0, -0.75)), ((0.6, 1.1), (0.9, 0.4)), 0.5)
SIGMA = 0.7


def u_sql(tag: str, *ids: str) -> str:
    return f"((('0x' || substr(md5('{tag}|' || " + " || '|' || ".join(ids) + "), 1, 13))::ubigint + 0.5) / 4503599627370496.0::double)"


def n_sql(tag: str, *ids: str) -> str:
    return f"(sqrt(-2 * ln({u_sql(tag + ':a', *ids)})) * cos(2 * pi() * {u_sql(tag + ':b', *ids)}))"


def _orders(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", ((F.col("o_totalprice") - 150000) / 80000).alias("z"), (F.ascii("o_orderpriority") - 49).alias("code"), F.floor(uniform("other", F.col("o_orderkey")) * 5).cast("int").alias("other"))


def time_grid_linear(spark, d):
    return P.TimeGrid(20, 1e-4, 1e-2, "linear").table(spark).select("k", r("gamma", "gamma"), r("t", "t"), r("remaining", "remaining"))


def time_grid_geom(spark, d):
    return P.TimeGrid(20, 1e-4, 1e-2, "geom").table(spark).select("k", r("gamma", "gamma"), r("t", "t"), r("remaining", "remaining"))


def midpoint_grid(spark, d):
    return P.midpoint_times(spark, 8, 0.07).select("k", r("t", "t"))


def gaussian_reference(spark, d):
    return P.gaussian_reference(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 2, 0.5, 2.0, 9).select("o_orderkey", r("z1_0", "z1_0"), r("z1_1", "z1_1"))


def _tuple(spark, d, direction):
    o = _orders(spark, d)
    pairs = {"z": (F.col("z"), normal("prior3", F.col("o_orderkey")))}
    return P.bridge_tuple(o, "o_orderkey", pairs, SIGMA, direction, 5).select("o_orderkey", r("t", "t"), r("x_z", "x_z"), r("y_z", "y_z"))


def bridge_tuple_f(spark, d):
    return _tuple(spark, d, "f")


def bridge_tuple_b(spark, d):
    return _tuple(spark, d, "b")


def first_coupling_ref(spark, d):
    return _orders(spark, d).select("o_orderkey", r(P.reference_coupling(F.col("z"), SIGMA, 1, "o_orderkey", "z"), "z1"))


def first_coupling_ind(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_acctbal")
    prior = P.gaussian_reference(c.select("c_custkey"), "c_custkey", 1, seed=4)
    return P.independent_coupling(c, prior, "c_custkey", 2).select("c_custkey", "c_custkey_prior", r("z1_0", "z1_0"))


def euler_ou_path(spark, d):
    c = spread(table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 5000).alias("x")), "c_custkey")
    path = P.euler_path(c, "c_custkey", "x", lambda x, k: -x, GRID, 1.0, 8)
    # outer: a path is never empty, and the filter that Spark puts before a plain posexplode would hold every step twice in the next
    return path.select("c_custkey", F.posexplode_outer("path").alias("step", "x")).select("c_custkey", "step", r("x", "x"))


def euler_mean_path_backward(spark, d):
    c = table(spark, d, "customer").select("c_custkey", (F.col("c_acctbal") / 5000).alias("x"))
    path = P.euler_path(c, "c_custkey", "x", lambda x, k: F.lit(1.0) - x, GRID, 1.0, 8, noisy=False, backward=True)
    return path.select("c_custkey", r(F.element_at("path", -1), "x_end"))


def one_step_cache(spark, d):
    out = P.one_step_cache(_orders(spark, d), "o_orderkey", "z", lambda x, k: -x, GRID, 1.0, 6)
    return out.select("o_orderkey", "k", r("x_next", "x_next"), r("target", "target"))


def ou_pretrain_target(spark, d):
    return _orders(spark, d).select("o_orderkey", r(P.ou_target(F.col("z"), 0.05, 2.0), "y"))


def ipf_residual_target(spark, d):
    z = F.col("z")
    nxt = P.euler_step(z, -z, 0.1, 1.0, normal("ipf", F.col("o_orderkey")))
    mean = lambda x: P.ou_target(x, 0.1)
    o = _orders(spark, d).withColumn("nxt", nxt)
    return o.select("o_orderkey", r(P.ipf_target(F.col("nxt"), mean(z), mean(F.col("nxt"))), "y"))


def regression_loss(spark, d):
    x = table(spark, d, "lineitem").select((F.col("l_quantity") / 50).alias("a"), (F.col("l_extendedprice") / 75000).alias("b"), F.col("l_discount").alias("w"), (F.col("l_tax") * 10).alias("c"))
    mse = P.regression_loss(x, [("a", "b"), ("a", "c")]).withColumn("kind", F.lit("mse"))
    huber = P.regression_loss(x, [("a", "b"), ("a", "c")], "huber", 0.2, "w", "sum").withColumn("kind", F.lit("huber"))
    return mse.unionByName(huber).select("kind", F.round("loss", 4).alias("loss"))


def uniform_kernel(spark, d):
    grid = spark.range(11 * 25).select((F.col("id") / 25).cast("int").alias("k"), ((F.col("id") / 5).cast("int") % 5).alias("i"), (F.col("id") % 5).cast("int").alias("j"))
    return grid.select("k", "i", "j", r(P.uniform_kernel(F.col("i"), F.col("j"), F.col("k"), 5, 0.08), "p"))


def ordered_kernel(spark, d):
    return P.CategoricalReference(6, 2, 0.3, "ordered").table(spark).select("k", "i", "j", r("p", "p"))


def _states(spark, d, probs):
    return _orders(spark, d).select("o_orderkey", F.posexplode_outer(probs).alias("state", "p")).select("o_orderkey", "state", r("p", "p"))


def categorical_bridge(spark, d):
    return _states(spark, d, REF.bridge(F.col("code"), F.col("other"), F.lit(4)))


def categorical_next(spark, d):
    return _states(spark, d, REF.next_given_prev(F.col("code"), F.col("other"), F.lit(3)))


def categorical_prev(spark, d):
    return _states(spark, d, REF.prev_given_next(F.col("code"), F.col("other"), F.lit(3)))


ENDS = (0.1, 0.2, 0.3, 0.15, 0.25)


def categorical_model_step(spark, d):
    return _states(spark, d, REF.model_next(F.col("code"), F.array(*[F.lit(x) for x in ENDS]), F.lit(3)))


def categorical_model_prev(spark, d):
    return _states(spark, d, REF.model_prev(F.col("code"), F.array(*[F.lit(x) for x in ENDS]), F.lit(3)))


def categorical_new_alpha(spark, d):
    """The bridge after alpha was updated."""
    return _states(spark, d, REF.with_alpha(0.03).bridge(F.col("code"), F.col("other"), F.lit(4)))


def categorical_path(spark, d):
    """A path of the reference from its start to its end: each step is drawn given the state before and the end."""
    o = spread(_orders(spark, d).select("o_orderkey", "code", "other"), "o_orderkey").withColumn("s0", F.col("code"))
    for n in range(REF.steps):
        o = o.withColumn(f"s{n + 1}", REF.next_drawn(F.col(f"s{n}"), F.col("other"), n, uniform(f"path{n}", F.col("o_orderkey"))))
    return o.select("o_orderkey", *[f"s{n}" for n in range(REF.steps + 1)], "other")


def mixed_path(spark, d):
    """One step of a mixed path: a numeric bridge point beside a categorical draw, at the same time."""
    o = _orders(spark, d)
    x = P.bridge_point(F.col("z"), normal("mix1", F.col("o_orderkey")), F.lit(0.4), SIGMA, normal("mix2", F.col("o_orderkey")))
    return o.select("o_orderkey", r(x, "x"), P.draw(REF.bridge(F.col("code"), F.col("other"), F.lit(4)), uniform("mix3", F.col("o_orderkey"))).alias("state"))


def bridge_sample(spark, d):
    return _orders(spark, d).select("o_orderkey", P.draw(REF.bridge(F.col("code"), F.col("other"), F.lit(4)), uniform("draw", F.col("o_orderkey"))).alias("state"))


def gumbel_draw(spark, d):
    o = _orders(spark, d).select("o_orderkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("cat"))
    return P.gumbel_argmax(o.withColumn("logit", -F.abs(F.col("cat") - 2).cast("double")), "o_orderkey", "cat", "logit", 1)


def lightsb_log_c(spark, d):
    return _orders(spark, d).select("o_orderkey", r(LIGHT.log_c([F.col("z"), F.col("code") / 4.0]), "log_c"))


def lightsb_log_v(spark, d):
    return _orders(spark, d).select("o_orderkey", r(LIGHT.log_v([F.col("z"), F.col("code") / 4.0]), "log_v"))


def lightsb_plan_sample(spark, d):
    o = _orders(spark, d).withColumn("c4", F.col("code") / 4.0)
    return LIGHT.plan_sample(o, "o_orderkey", ["z", "c4"], 1).select("o_orderkey", "component", r("y_z", "y_z"), r("y_c4", "y_c4"))


LIGHT_FULL = P.FullLightPotential((math.log(0.4), math.log(0.6)), ((-0.5, 0.25), (1.0, -0.75)), (((0.6, 0.25), (0.25, 1.1)), ((0.9, -0.3), (-0.3, 0.4))), 0.5)


def lightsb_log_c_full(spark, d):
    return _orders(spark, d).select("o_orderkey", r(LIGHT_FULL.log_c([F.col("z"), F.col("code") / 4.0]), "log_c"))


def lightsb_log_v_full(spark, d):
    return _orders(spark, d).select("o_orderkey", r(LIGHT_FULL.log_v([F.col("z"), F.col("code") / 4.0]), "log_v"))


def lightsb_plan_sample_full(spark, d):
    o = _orders(spark, d).withColumn("c4", F.col("code") / 4.0)
    return LIGHT_FULL.plan_sample(o, "o_orderkey", ["z", "c4"], 1).select("o_orderkey", "component", r("y_z", "y_z"), r("y_c4", "y_c4"))


LOSS_WEIGHT = 0.05


def _losses(spark, d, loss):
    o = _orders(spark, d).withColumn("logits", F.array(*[F.col("z") * (0.3 * e) - 0.2 * F.abs(F.lit(e) - F.col("code")) for e in range(5)])).withColumn("guess", F.col("z") * 0.9 + F.col("code") * 0.1)
    column = P.CategoricalColumn(REF, F.col("logits"), F.col("other"), F.col("code"))
    return loss(o, column, "forward").unionByName(loss(o, column, "backward")).select("direction", r("loss", "loss"))


def csbm_loss(spark, d):
    return _losses(spark, d, lambda o, c, way: P.csbm_loss(o, [c], F.lit(3), way, LOSS_WEIGHT).withColumn("direction", F.lit(way)))


def mixed_loss(spark, d):
    return _losses(spark, d, lambda o, c, way: P.mixed_loss(o, [("guess", "z")], [c], F.lit(3), way, 0.7, 0.3, LOSS_WEIGHT).withColumn("direction", F.lit(way)))


def beta_schedule_linear(spark, d):
    return P.beta_schedule(spark, "linear", 50).select("k", *[r(c, c) for c in ("beta", "log_alpha_sum", "alpha_bar")])


def beta_schedule_cosine(spark, d):
    return P.beta_schedule(spark, "cosine", 50).select("k", *[r(c, c) for c in ("beta", "log_alpha_sum", "alpha_bar")])


def ddpm_q_sample(spark, d):
    s = F.broadcast(P.beta_schedule(spark, "linear", 50))  # 50 rows
    o = _orders(spark, d).withColumn("k", F.floor(uniform("ddpm", F.col("o_orderkey")) * 50).cast("int"))
    return o.join(s, "k").select("o_orderkey", "k", r(P.q_sample(F.col("z"), F.col("alpha_bar"), normal("ddpm", F.col("o_orderkey"))), "x"))


def ddpm_posterior(spark, d):
    o = _orders(spark, d)
    mean, var = P.q_posterior(F.col("z"), F.col("code").cast("double"), F.lit(0.02), F.lit(0.5), F.lit(0.51))
    return o.select("o_orderkey", r(mean, "mean"), r(var, "var"))


def ddpm_bound_terms(spark, d):
    z, c = F.col("z"), F.col("code").cast("double")
    mean, var = P.q_posterior(z, c, F.lit(0.02), F.lit(0.5), F.lit(0.51))
    return _orders(spark, d).select("o_orderkey", r(P.vb_term(mean, F.ln(var), c * 0.9, F.lit(-3.0)), "vb"), r(P.prior_kl(z, F.lit(0.01)), "prior"))


def multinomial_q(spark, d):
    o = _orders(spark, d).select("o_orderkey", "code", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("state"))
    return o.select("o_orderkey", "state", r(P.q_pred((F.col("code") == F.col("state")).cast("double"), 5, F.lit(0.37)), "p"))


def ve_sigma_schedule(spark, d):
    return spark.range(21).select(F.col("id").cast("int").alias("k"), r(P.ve_sigma(F.col("id") / 20, 0.01, 50.0), "sigma"))


def time_embedding(spark, d):
    return spark.range(10).select(F.col("id").cast("int").alias("k"), F.posexplode(scalars.time_embedding(F.col("id") / 10, 8)).alias("i", "e")).select("k", "i", r("e", "e"))


def gaussian_terms(spark, d):
    z, c = F.col("z"), F.col("code").cast("double")
    return _orders(spark, d).select("o_orderkey", r(scalars.normal_kl(z, c / 4 - 1, c / 5, F.lit(-0.5)), "kl"), r(scalars.discretized_log_likelihood(z / 4, c / 10 - 0.2, F.lit(-1.0)), "log_lik"))


def log_space_helpers(spark, d):
    z, c = F.col("z"), F.col("code").cast("double")
    top = F.greatest(z, c) + 0.5
    return _orders(spark, d).select("o_orderkey", r(scalars.log_add_exp(z, c), "add"), r(scalars.log_sub_exp(top, z), "sub"), r(scalars.log_one_minus_exp(-F.abs(z) - 0.1), "one_minus"), r(scalars.log_sum_exp(F.array(z, c, -z)), "log_sum"))


O = f"(SELECT o_orderkey, (o_totalprice - 150000) / 80000 AS z, ascii(o_orderpriority) - 49 AS code, floor({u_sql('other', 'o_orderkey')} * 5)::int AS other FROM orders)"
T5 = f"least(greatest({u_sql('t5', 'o_orderkey')}, 1e-3), 1 - 1e-3)"
E5 = n_sql("e5:z", "o_orderkey")


def _grid_sql(gamma: str, n: int) -> str:
    return f"SELECT k, round(g, 6) AS gamma, round(sum(g) OVER (ORDER BY k), 6) AS t, round(sum(g) OVER () - sum(g) OVER (ORDER BY k), 6) AS remaining FROM (SELECT i::int AS k, {gamma} AS g FROM range({n}) t(i))"


def _tuple_sql(target: str) -> str:
    return f"SELECT o_orderkey, round(t, 6) AS t, round((1 - t) * z + t * z1 + 0.7 * sqrt(t * (1 - t)) * e, 6) AS x_z, round({target}, 6) AS y_z FROM (SELECT o_orderkey, z, {n_sql('prior3', 'o_orderkey')} AS z1, {T5}::double AS t, {E5} AS e FROM {O})"


def _path_sql() -> str:
    q = "SELECT c_custkey, c_acctbal / 5000 AS x0 FROM customer"
    for k, g in enumerate(GRID.gamma):
        q = f"SELECT *, x{k} - x{k} * {float(g)!r}::double + sqrt({float(g)!r}::double) * {n_sql(f'em8:{k}', 'c_custkey')} AS x{k + 1} FROM ({q})"
    return " UNION ALL ".join(f"SELECT c_custkey, {k} AS step, round(x{k}, 6) AS x FROM p" for k in range(len(GRID.gamma) + 1)).join([f"WITH p AS ({q}) ", ""])


def _back_sql() -> str:
    q = "SELECT c_custkey, c_acctbal / 5000 AS x FROM customer"
    for g in GRID.gamma[::-1]:
        q = f"SELECT c_custkey, x + (1 - x) * {float(g)!r}::double AS x FROM ({q})"
    return f"SELECT c_custkey, round(x, 6) AS x_end FROM ({q})"


def q_sql(i: str, j: str, k: str, s: int = 5, a: float = 0.08) -> str:
    b = f"pow({1 - a * s / (s - 1 + 1e-6)!r}::double, {k})"
    return f"(CASE WHEN {k} = 0 THEN CASE WHEN {i} = {j} THEN 1.0::double ELSE 0.0::double END WHEN {i} = {j} THEN {b} + (1 - {b}) / {s} ELSE (1 - {b}) / {s} END)"


def _state_sql(weight: str) -> str:
    return f"SELECT o_orderkey, state, round(w / sum(w) OVER (PARTITION BY o_orderkey), 6) AS p FROM (SELECT o_orderkey, s::int AS state, {weight} AS w FROM {O}, range(5) t(s))"


def _walk_sql() -> str:
    q = f"SELECT o_orderkey, code AS s0, other FROM {O}"
    for n in range(REF.steps):
        w = [f"({q_sql(f's{n}', str(s), '1')} * {q_sql(str(s), 'other', str(REF.steps - 1 - n))})" for s in range(5)]
        upto = ["(" + " + ".join(w[: s + 1]) + ")" for s in range(5)]
        steps = " + ".join(f"CASE WHEN {x} / {upto[-1]} < u THEN 1 ELSE 0 END" for x in upto)
        q = f"SELECT * EXCLUDE (u), least({steps}, 4)::int AS s{n + 1} FROM (SELECT *, {u_sql(f'path{n}', 'o_orderkey')} AS u FROM ({q}))"
    return q


BRIDGE_W = f"{q_sql('code', 's', '4')} * {q_sql('s', 'other', '6')}"
NEXT_W = f"{q_sql('code', 's', '1')} * {q_sql('s', 'e', '6')}"
PREV_W = f"{q_sql('e', 's', '2')} * {q_sql('s', 'code', '1')}"
_ends = "[" + ", ".join(map(str, ENDS)) + "]"
_c = [f"({la!r}::double + ({s[0]!r}::double * z * z + {2 * rr[0]!r}::double * z + {s[1]!r}::double * c4 * c4 + {2 * rr[1]!r}::double * c4) / {2 * LIGHT.eps!r}::double)" for la, rr, s in zip(LIGHT.log_alpha, LIGHT.r, LIGHT.s)]
_v = ["(" + f"{la!r}::double" + "".join(f" - 0.5 * (pow({x} - ({m!r}::double), 2) / {LIGHT.eps * q!r}::double + {float(np.log(2 * np.pi * LIGHT.eps * q))!r}::double)" for x, m, q in zip(("z", "c4"), rr, s)) + ")" for la, rr, s in zip(LIGHT.log_alpha, LIGHT.r, LIGHT.s)]
O4 = f"(SELECT *, code / 4.0::double AS c4 FROM {O})"
_lse = lambda a, b: f"(greatest({a}, {b}) + ln(exp({a} - greatest({a}, {b})) + exp({b} - greatest({a}, {b}))))"
_pick = lambda m, j: f"(CASE component WHEN 0 THEN {m[0][j]!r}::double ELSE {m[1][j]!r}::double END)"
_cdf = lambda x: f"(0.5 * (1 + tanh({math.sqrt(2 / math.pi)!r}::double * (({x}) + 0.044715::double * pow(({x}), 3)))))"
_fl = lambda p: f"ln(greatest({p}, 1e-12))"
_up, _down = (_cdf(f"exp(1.0::double) * (z / 4 - (code / 10.0::double - 0.2::double) {s} {1 / 255!r}::double)") for s in "+-")
BETA_LIN = f"({1000 / 50 * 1e-4!r}::double + k * {(1000 / 50 * 0.02 - 1000 / 50 * 1e-4) / 49!r}::double)"
_f = lambda u: f"pow(cos((({u}) + 0.008::double) / 1.008::double * {np.pi / 2!r}::double), 2)"
BETA_COS = f"least(1 - {_f('(k + 1) / 50.0::double')} / {_f('k / 50.0::double')}, 0.999::double)"
_beta_sql = lambda b: f"SELECT k, round(beta, 6) AS beta, round(sum(ln(1 - beta)) OVER (ORDER BY k), 6) AS log_alpha_sum, round(exp(sum(ln(1 - beta)) OVER (ORDER BY k)), 6) AS alpha_bar FROM (SELECT k, {b} AS beta FROM (SELECT i::int AS k FROM range(50) t(i)))"
_gamma_list = "[" + ", ".join(f"{float(g)!r}::double" for g in GRID.gamma) + "]"
_one = "WITH l AS (SELECT l_quantity / 50 AS a, l_extendedprice / 75000 AS b, l_discount AS w, l_tax * 10 AS c FROM lineitem)"
_hub = lambda e: f"(CASE WHEN abs({e}) <= 0.2 THEN 0.5 * pow({e}, 2) ELSE 0.2 * (abs({e}) - 0.1) END)"

QUERIES = {f.__name__: f for f in (time_grid_linear, time_grid_geom, midpoint_grid, gaussian_reference, bridge_tuple_f, bridge_tuple_b, first_coupling_ref, first_coupling_ind, euler_ou_path, euler_mean_path_backward, one_step_cache, ou_pretrain_target, ipf_residual_target, regression_loss, uniform_kernel, ordered_kernel, categorical_bridge, categorical_next, categorical_prev, categorical_model_step, categorical_model_prev, categorical_new_alpha, categorical_path, mixed_path, bridge_sample, gumbel_draw, lightsb_log_c, lightsb_log_v, lightsb_plan_sample, lightsb_log_c_full, lightsb_log_v_full, lightsb_plan_sample_full, csbm_loss, mixed_loss, beta_schedule_linear, beta_schedule_cosine, ddpm_q_sample, ddpm_posterior, ddpm_bound_terms, multinomial_q, ve_sigma_schedule, time_embedding, gaussian_terms, log_space_helpers)}
def _full_terms():
    """SQL of the components' terms of log C and log v: matrices written out by adjugates."""
    c, v = [], []
    for a, (r0, r1), ((p, q), (_, w)) in zip(LIGHT_FULL.log_alpha, LIGHT_FULL.r, LIGHT_FULL.s):
        e, det = LIGHT_FULL.eps, p * w - q * q
        c.append(f"({a!r}::double + ({p!r}::double * z * z + 2 * {q!r}::double * z * c4 + {w!r}::double * c4 * c4 + 2 * {r0!r}::double * z + 2 * {r1!r}::double * c4) / (2 * {e!r}::double))")
        dz, dc = f"(z - {r0!r}::double)", f"(c4 - {r1!r}::double)"
        v.append(f"({a!r}::double - 0.5 * (({w!r}::double * {dz} * {dz} - 2 * {q!r}::double * {dz} * {dc} + {p!r}::double * {dc} * {dc}) / ({e!r}::double * {det!r}::double) + 2 * ln(2 * pi() * {e!r}::double) + ln({det!r}::double)))")
    return c, v


_cf, _vf = _full_terms()
_pick_full = lambda values: f"CASE component WHEN 0 THEN {values[0]!r}::double ELSE {values[1]!r}::double END"
_chol = [((math.sqrt(0.5 * p), 0.0), (0.5 * q / math.sqrt(0.5 * p), math.sqrt(0.5 * w - 0.5 * q * q / p))) for ((p, q), (_, w)) in LIGHT_FULL.s]
_side = lambda i: f"{_pick_full([x[i] for x in LIGHT_FULL.r])} + {_pick_full([x[i][0] for x in LIGHT_FULL.s])} * z + {_pick_full([x[i][1] for x in LIGHT_FULL.s])} * c4 + {_pick_full([x[i][0] for x in _chol])} * {n_sql('plan1:0', 'o_orderkey')} + {_pick_full([x[i][1] for x in _chol])} * {n_sql('plan1:1', 'o_orderkey')}"
_logit = "z * (0.3::double * e) - 0.2::double * abs(e - code)"
_loss_rows = lambda w: f"SELECT o_orderkey, s, sum(pe * k) AS model, sum(CASE WHEN e = other THEN k END) AS target, max(CASE WHEN e = other THEN -ln(pe) END) AS ce FROM (SELECT *, exp(g) / sum(exp(g)) OVER (PARTITION BY o_orderkey, s) AS pe, w / sum(w) OVER (PARTITION BY o_orderkey, e) AS k FROM (SELECT o_orderkey, other, s, e, {_logit} AS g, {w} AS w FROM {O}, range(5) t(s), range(5) v(e))) GROUP BY 1, 2"
_csbm = lambda w: f"(SELECT sum(target * (ln(target) - ln(model + 1e-12))) / count(DISTINCT o_orderkey) + {LOSS_WEIGHT!r}::double * avg(ce) FROM ({_loss_rows(w)}))"
_error = f"(SELECT avg(pow(z * 0.9::double + code * 0.1::double - z, 2)) FROM {O})"
ORACLES = {
    "lightsb_log_c_full": f"SELECT o_orderkey, round({_lse(*_cf)}, 6) AS log_c FROM {O4}",
    "lightsb_log_v_full": f"SELECT o_orderkey, round({_lse(*_vf)}, 6) AS log_v FROM {O4}",
    "lightsb_plan_sample_full": f"""WITH w AS (SELECT *, CASE WHEN exp({_cf[0]} - {_lse(*_cf)}) < {u_sql('plan1', 'o_orderkey')} THEN 1 ELSE 0 END AS component FROM {O4})
        SELECT o_orderkey, component, round({_side(0)}, 6) AS y_z, round({_side(1)}, 6) AS y_c4 FROM w""",
    "csbm_loss": " UNION ALL ".join(f"SELECT '{way}' AS direction, round({_csbm(w)}, 6) AS loss" for way, w in (("forward", NEXT_W), ("backward", PREV_W))),
    "mixed_loss": " UNION ALL ".join(f"SELECT '{way}' AS direction, round(0.7::double * {_error} + 0.3::double * {_csbm(w)}, 6) AS loss" for way, w in (("forward", NEXT_W), ("backward", PREV_W))),
    "time_grid_linear": _grid_sql("1e-4 + i / 19.0::double * (1e-2 - 1e-4)", 20),
    "time_grid_geom": _grid_sql("1e-4 * pow(1e-2 / 1e-4, i / 19.0::double)", 20),
    "midpoint_grid": "SELECT i::int AS k, round(least(greatest((i + 0.5) / 8.0::double, 0.07), 1 - 0.07), 6)::double AS t FROM range(8) t(i)",
    "gaussian_reference": f"SELECT o_orderkey, round(0.5 + 2 * {n_sql('prior9:0', 'o_orderkey')}, 6) AS z1_0, round(0.5 + 2 * {n_sql('prior9:1', 'o_orderkey')}, 6) AS z1_1 FROM orders",
    "bridge_tuple_f": _tuple_sql("z1 - z - 0.7 * sqrt(t / (1 - t)) * e"),
    "bridge_tuple_b": _tuple_sql("z - z1 - 0.7 * sqrt((1 - t) / t) * e"),
    "first_coupling_ref": f"SELECT o_orderkey, round(z + 0.7 * {n_sql('ref1:z', 'o_orderkey')}, 6) AS z1 FROM {O}",
    "first_coupling_ind": f"""WITH a AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('2:a|' || c_custkey), c_custkey) AS k FROM customer), b AS (SELECT c_custkey AS c_custkey_prior, {n_sql('prior4:0', 'c_custkey')} AS z, row_number() OVER (ORDER BY md5('2:b|' || c_custkey), c_custkey) AS k FROM customer)
        SELECT c_custkey, c_custkey_prior, round(z, 6) AS z1_0 FROM a JOIN b USING (k)""",
    "euler_ou_path": _path_sql(),
    "euler_mean_path_backward": _back_sql(),
    "one_step_cache": f"""SELECT o_orderkey, k, round(n, 6) AS x_next, round((z - n) / g, 6) AS target FROM (SELECT *, z - z * g + sqrt(g) * {n_sql('c6', 'o_orderkey')} AS n FROM (SELECT *, {_gamma_list}[k + 1] AS g FROM (SELECT *, least(floor({u_sql('k6', 'o_orderkey')} * 5), 4)::int AS k FROM {O})))""",
    "ou_pretrain_target": f"SELECT o_orderkey, round(z - 0.05::double * 2 * z, 6) AS y FROM {O}",
    "ipf_residual_target": f"SELECT o_orderkey, round(n + ((z - 0.1::double * z) - (n - 0.1::double * n)), 6) AS y FROM (SELECT *, z - z * 0.1::double + sqrt(0.1::double) * {n_sql('ipf', 'o_orderkey')} AS n FROM {O})",
    "regression_loss": f"{_one} SELECT 'mse' AS kind, round(avg((pow(a - b, 2) + pow(a - c, 2)) / 2), 4) AS loss FROM l UNION ALL SELECT 'huber', round(sum(({_hub('a - b')} + {_hub('a - c')}) / 2 * w), 4) FROM l",
    "uniform_kernel": f"SELECT k::int AS k, i::int AS i, j::int AS j, round({q_sql('i', 'j', 'k')}, 6) AS p FROM range(11) a(k), range(5) b(i), range(5) c(j)",
    "ordered_kernel": """WITH q AS (SELECT i, j, exp(-4 * pow(i - j, 2) / (0.09::double * 25 + 1e-12)) AS e FROM range(6) a(i), range(6) b(j)), p AS (SELECT i, j, e / sum(e) OVER (PARTITION BY i) AS p FROM q)
        SELECT 0 AS k, i::int AS i, j::int AS j, CASE WHEN i = j THEN 1.0::double ELSE 0.0::double END AS p FROM p UNION ALL SELECT 1, i::int, j::int, round(p, 6) FROM p
        UNION ALL SELECT 2, a.i::int, b.j::int, round(sum(a.p * b.p), 6) FROM p a JOIN p b ON a.j = b.i GROUP BY 2, 3""",
    "categorical_bridge": _state_sql(BRIDGE_W),
    "categorical_next": _state_sql(f"{q_sql('code', 's', '1')} * {q_sql('s', 'other', '6')}"),
    "categorical_prev": _state_sql(f"{q_sql('code', 's', '2')} * {q_sql('s', 'other', '1')}"),
    "categorical_model_step": f"""WITH w AS (SELECT o_orderkey, s::int AS state, e, {NEXT_W} AS w FROM {O}, range(5) t(s), range(5) v(e)), c AS (SELECT *, w / sum(w) OVER (PARTITION BY o_orderkey, e) * {_ends}[e + 1] AS p FROM w), m AS (SELECT o_orderkey, state, sum(p) AS p FROM c GROUP BY 1, 2)
        SELECT o_orderkey, state, round(p / sum(p) OVER (PARTITION BY o_orderkey), 6)::double AS p FROM m""",
    "categorical_model_prev": f"""WITH w AS (SELECT o_orderkey, s::int AS state, e, {PREV_W} AS w FROM {O}, range(5) t(s), range(5) v(e)), c AS (SELECT *, w / sum(w) OVER (PARTITION BY o_orderkey, e) * {_ends}[e + 1] AS p FROM w), m AS (SELECT o_orderkey, state, sum(p) AS p FROM c GROUP BY 1, 2)
        SELECT o_orderkey, state, round(p / sum(p) OVER (PARTITION BY o_orderkey), 6)::double AS p FROM m""",
    "categorical_new_alpha": _state_sql(f"{q_sql('code', 's', '4', a=0.03)} * {q_sql('s', 'other', '6', a=0.03)}"),
    "categorical_path": _walk_sql(),
    "mixed_path": f"""SELECT o_orderkey, any_value(round(0.6::double * z + 0.4::double * {n_sql('mix1', 'o_orderkey')} + 0.7 * sqrt(0.24::double) * {n_sql('mix2', 'o_orderkey')}, 6)) AS x, least(sum(CASE WHEN c < u THEN 1 ELSE 0 END), 4)::int AS state
        FROM (SELECT o_orderkey, z, {u_sql('mix3', 'o_orderkey')} AS u, sum(w) OVER (PARTITION BY o_orderkey ORDER BY s) / sum(w) OVER (PARTITION BY o_orderkey) AS c FROM (SELECT o_orderkey, z, s, {BRIDGE_W} AS w FROM {O}, range(5) t(s))) GROUP BY 1""",
    "bridge_sample": f"""SELECT o_orderkey, least(sum(CASE WHEN c < u THEN 1 ELSE 0 END), 4)::int AS state FROM (SELECT o_orderkey, {u_sql('draw', 'o_orderkey')} AS u, sum(w) OVER (PARTITION BY o_orderkey ORDER BY s) / sum(w) OVER (PARTITION BY o_orderkey) AS c FROM (SELECT o_orderkey, s, {BRIDGE_W} AS w FROM {O}, range(5) t(s))) GROUP BY 1""",
    "gumbel_draw": f"SELECT o_orderkey, arg_max(cat, -abs(cat - 2) - ln(-ln({u_sql('gumbel1', 'o_orderkey', 'cat')}))) AS cat FROM orders, (SELECT i::int AS cat FROM range(5) t(i)) GROUP BY 1",
    "lightsb_log_c": f"SELECT o_orderkey, round({_lse(*_c)}, 6) AS log_c FROM {O4}",
    "lightsb_log_v": f"SELECT o_orderkey, round({_lse(*_v)}, 6) AS log_v FROM {O4}",
    "lightsb_plan_sample": f"""WITH w AS (SELECT *, CASE WHEN exp({_c[0]} - {_lse(*_c)}) < {u_sql('plan1', 'o_orderkey')} THEN 1 ELSE 0 END AS component FROM {O4})
        SELECT o_orderkey, component, round({_pick(LIGHT.r, 0)} + {_pick(LIGHT.s, 0)} * z + sqrt({LIGHT.eps!r}::double * {_pick(LIGHT.s, 0)}) * {n_sql('plan1:0', 'o_orderkey')}, 6) AS y_z, round({_pick(LIGHT.r, 1)} + {_pick(LIGHT.s, 1)} * c4 + sqrt({LIGHT.eps!r}::double * {_pick(LIGHT.s, 1)}) * {n_sql('plan1:1', 'o_orderkey')}, 6) AS y_c4 FROM w""",
    "beta_schedule_linear": _beta_sql(BETA_LIN),
    "beta_schedule_cosine": _beta_sql(BETA_COS),
    "ddpm_q_sample": f"""WITH s AS (SELECT k, exp(sum(ln(1 - {BETA_LIN})) OVER (ORDER BY k)) AS a FROM (SELECT i::int AS k FROM range(50) t(i))), o AS (SELECT *, floor({u_sql('ddpm', 'o_orderkey')} * 50)::int AS k FROM {O})
        SELECT o_orderkey, k, round(sqrt(a) * z + sqrt(1 - a) * {n_sql('ddpm', 'o_orderkey')}, 6) AS x FROM o JOIN s USING (k)""",
    "ddpm_posterior": f"SELECT o_orderkey, round(sqrt(0.51::double) * 0.02::double / 0.5::double * z + sqrt(0.98::double) * 0.49::double / 0.5::double * code, 6) AS mean, round(0.02::double * 0.49::double / 0.5::double, 6) AS var FROM {O}",
    "ddpm_bound_terms": f"""WITH m AS (SELECT o_orderkey, z, code * 0.9::double AS mm, sqrt(0.51::double) * 0.02::double / 0.5::double * z + sqrt(0.98::double) * 0.49::double / 0.5::double * code AS mean, ln(0.02::double * 0.49::double / 0.5::double) AS lv FROM {O})
        SELECT o_orderkey, round(0.5 * (-1 + -3.0::double - lv + exp(lv + 3.0::double) + pow(mean - mm, 2) * exp(3.0::double)) / ln(2.0::double), 6) AS vb, round(0.5 * (-1 - ln(0.99::double) + 0.99::double + 0.01::double * z * z) / ln(2.0::double), 6) AS prior FROM m""",
    "multinomial_q": f"SELECT o_orderkey, s::int AS state, round(0.37::double * CASE WHEN code = s THEN 1 ELSE 0 END + 0.63::double / 5, 6) AS p FROM {O}, range(5) t(s)",
    "ve_sigma_schedule": "SELECT i::int AS k, round(0.01::double * pow(5000.0::double, i / 20.0::double), 6) AS sigma FROM range(21) t(i)",
    "time_embedding": "SELECT k::int AS k, i::int AS i, round(CASE WHEN i < 4 THEN cos(k / 10.0::double * exp(-ln(10000.0::double) * i / 4)) ELSE sin(k / 10.0::double * exp(-ln(10000.0::double) * (i - 4) / 4)) END, 6) AS e FROM range(10) a(k), range(8) b(i)",
    "gaussian_terms": f"""SELECT o_orderkey, round(0.5 * (-1 + -0.5::double - (code / 4.0::double - 1) + exp(code / 4.0::double - 1 + 0.5::double) + pow(z - code / 5.0::double, 2) * exp(0.5::double)), 6) AS kl,
        round(CASE WHEN z / 4 < -0.999 THEN {_fl(_up)} WHEN z / 4 > 0.999 THEN {_fl('1 - ' + _down)} ELSE {_fl(_up + ' - ' + _down)} END, 6) AS log_lik FROM {O}""",
    "log_space_helpers": f"SELECT o_orderkey, round(ln(exp(z) + exp(code)), 6) AS add, round(ln(exp(greatest(z, code) + 0.5::double) - exp(z)), 6) AS sub, round(ln(1 - exp(-abs(z) - 0.1::double) + 1e-40), 6) AS one_minus, round(ln(exp(z) + exp(code) + exp(-z)), 6) AS log_sum FROM {O}",
}
