"""Queries of the fidelity metrics, each with its SQL: order lines returned (R) against accepted (A), and others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tabweave.operators import metrics, ranks
from tabweave.plans.q_transforms import _lines, r, wasserstein_sql
from tabweave.sources.readers import table

NUM = ["l_quantity", "l_extendedprice", "l_discount"]


def _sides(spark, d):
    lines = _lines(spark, d)
    return lines.filter("l_returnflag = 'A'"), lines.filter("l_returnflag = 'R'")


def wasserstein_by_column(spark, d):
    return metrics.wasserstein_by_column(*_sides(spark, d), NUM).select("col", r("wd", "wd"))


def avg_wasserstein(spark, d):
    return metrics.average_wasserstein(*_sides(spark, d), NUM).select(r("avg_wd", "avg_wd"))


def kl_hist(spark, d):
    return metrics.histogram_kl_by_column(*_sides(spark, d), NUM, 20).select("col", r("kl", "kl"))


def avg_kl_hist(spark, d):
    return metrics.histogram_kl_by_column(*_sides(spark, d), NUM, 50).agg(r(F.avg("kl"), "avg_kl"))


def corr_frobenius(spark, d):
    a, b = (x.withColumn("constant", F.lit(1.0)) for x in _sides(spark, d))
    return metrics.correlation_frobenius(a, b, [*NUM, "l_tax", "constant"]).select(r("corr_frob", "corr_frob"))


def js_categorical(spark, d):
    o = table(spark, d, "orders").withColumn("half", F.nullif("o_orderpriority", F.lit("2-HIGH")))
    return metrics.js_by_column(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), ["o_orderpriority", "half"]).select("col", r("js", "js"))


def js_discrete(spark, d):
    return metrics.js_by_column(*_sides(spark, d), ["l_linenumber", "l_quantity"], rounded=True).select("col", r("js", "js"))


def composite_score(spark, d):
    a, b = _sides(spark, d)
    return metrics.composite_score(a, b, ["l_extendedprice"], ["l_linenumber"], ["l_linestatus"]).select(*[r(c, c) for c in ("mean_wd", "mean_js", "composite")])


UNITS = metrics.projections(64, 4)


def sliced_wasserstein(spark, d):
    e = table(spark, d, "embeddings")
    return metrics.sliced_wasserstein(e.filter("label % 2 = 0"), e.filter("label % 2 = 1"), "embedding", UNITS).select(r("swd", "swd"))


def column_moments(spark, d):
    return metrics.moments(_lines(spark, d), NUM).select("col", r("mean", "mean"), r("std", "std"))


def fold_summary(spark, d):
    """Fold means of two prices as metrics, summarised by status."""
    o = ranks.kfold(table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey", 5, 42)
    folds = o.groupBy("o_orderstatus", "fold").agg(F.avg("o_totalprice").alias("price"), F.count(F.lit(1)).cast("double").alias("rows"))
    return metrics.fold_summary(folds, "o_orderstatus", ["price", "rows"]).select("o_orderstatus", *[r(c, c) for c in ("price_mean", "price_std", "rows_mean", "rows_std")])


def average_rank(spark, d):
    """Users ranked inside each event type by their rounded mean value."""
    # means that lie on a half are rounded by the last bit of their sum, so values are added in the order of events (of one id: of values) on any cluster
    order = Window.partitionBy("event_type", "user_id").orderBy("event_id", "value")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, d, "events").select("event_type", "user_id", "value", F.sum("value").over(upto).alias("s"), F.row_number().over(order).alias("n"))
    e = e.groupBy("event_type", "user_id").agg(F.round(F.max_by("s", "n") / F.count("value"), 0).alias("score"))
    return ranks.average_rank(e, "event_type", "user_id", "score").select("user_id", r("avg_rank", "avg_rank"), "n_groups")


def r2_delta(spark, d):
    """Two fixed linear rules for the price of a line as predictors of the real and of the synthetic model."""
    x = _lines(spark, d).select("l_extendedprice", (F.col("l_quantity") * 1500).alias("real"), (F.col("l_quantity") * 1400 + 900).alias("synth"))
    out = metrics.r2(x, "l_extendedprice", "real", "synth")
    return out.select(r("r2_real", "r2_real"), r("r2_synth", "r2_synth"), r(metrics.relative_percent(F.col("r2_synth"), F.col("r2_real")), "delta_r2_percent"))


def contingency_counts(spark, d):
    """Counts of a child's bins for each combination of its parents' bins, as a structure score needs them."""
    b, _ = metrics.quantile_bins(_lines(spark, d), ["l_quantity", "l_extendedprice"])
    return b.groupBy("bin_l_extendedprice", "bin_l_quantity", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))


def category_universe(spark, d):
    o = table(spark, d, "orders")
    return o.filter("o_orderstatus = 'F'").select("o_orderpriority").union(o.filter("o_orderstatus = 'P'").select("o_orderpriority")).distinct()


A, B = (f"SELECT * FROM lineitem WHERE l_returnflag = '{f}'" for f in "AR")


def kl_sql(cols: list[str], bins: int) -> str:
    """(col, kl) by counting against an explicit list of edges."""
    out = []
    for c in cols:
        out.append(f"""SELECT '{c}' AS col, sum(p * (ln(p) - ln(q))) AS kl FROM (SELECT (na + 1e-12::double) / sum(na + 1e-12::double) OVER () AS p, (nb + 1e-12::double) / sum(nb + 1e-12::double) OVER () AS q FROM (
            SELECT i, coalesce(sum(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END), 0)::double AS na, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END), 0)::double AS nb
            FROM range({bins}) t(i) LEFT JOIN (SELECT l_returnflag, len(list_filter(e, lambda x: x <= {c})) AS bin FROM lineitem, (SELECT list_transform(range(1, {bins}), lambda k: k * ((hi - lo) / {bins}::double) + lo) AS e FROM (SELECT min({c}) AS lo, max({c}) AS hi FROM lineitem WHERE l_returnflag IN ('A', 'R'))) WHERE l_returnflag IN ('A', 'R')) ON bin = i GROUP BY i))""")
    return " UNION ALL ".join(out)


def js_sql(a: str, b: str, exprs: dict[str, str]) -> str:
    out = []
    for c, e in exprs.items():
        out.append(f"""SELECT '{c}' AS col, sum((p * (ln(p) - ln((p + q) / 2)) + q * (ln(q) - ln((p + q) / 2))) / 2) AS js FROM (
            SELECT (na / sum(na) OVER () + 1e-12::double) / (1 + count(*) OVER () * 1e-12::double) AS p, (nb / sum(nb) OVER () + 1e-12::double) / (1 + count(*) OVER () * 1e-12::double) AS q
            FROM (SELECT v, sum(1 - s)::double AS na, sum(s)::double AS nb FROM (SELECT {e} AS v, 0 AS s FROM ({a}) UNION ALL SELECT {e}, 1 FROM ({b})) GROUP BY v))""")
    return " UNION ALL ".join(out)


def corr_sql(cols: list[str], flag: str) -> str:
    pair = lambda x, y: f"coalesce(covar_pop({x}, {y}) / nullif(stddev_pop({x}) * stddev_pop({y}), 0), 0)"
    exprs = [pair(cols[i], cols[j]) for i in range(len(cols)) for j in range(i)]
    return f"SELECT [{', '.join(exprs)}] AS v FROM (SELECT *, 1.0::double AS constant FROM lineitem WHERE l_returnflag = '{flag}')"


O_F, O_O = (f"SELECT *, nullif(o_orderpriority, '2-HIGH') AS half FROM orders WHERE o_orderstatus = '{s}'" for s in "FO")
_proj = lambda parity: "SELECT " + ", ".join(f"{' + '.join(f'embedding[{j + 1}]::double * ({float(w)!r}::double)' for j, w in enumerate(u))} AS p{i}" for i, u in enumerate(UNITS)) + f" FROM embeddings WHERE label % 2 = {parity}"
BINNED = "(SELECT l.*, len(list_filter(q1, lambda x: x <= l_quantity))::int AS bin_l_quantity, len(list_filter(q2, lambda x: x <= l_extendedprice))::int AS bin_l_extendedprice FROM lineitem l, (SELECT list_distinct(quantile_cont(l_quantity, [0.2, 0.4, 0.6, 0.8])) AS q1, list_distinct(quantile_cont(l_extendedprice, [0.2, 0.4, 0.6, 0.8])) AS q2 FROM lineitem))"

QUERIES = {f.__name__: f for f in (wasserstein_by_column, avg_wasserstein, kl_hist, avg_kl_hist, corr_frobenius, js_categorical, js_discrete, composite_score, sliced_wasserstein, column_moments, fold_summary, average_rank, r2_delta, contingency_counts, category_universe)}
ORACLES = {
    "wasserstein_by_column": wasserstein_sql(A, B, NUM),
    "avg_wasserstein": f"SELECT round(avg(w), 6) AS avg_wd FROM ({wasserstein_sql(A, B, NUM).replace('round(sum(coalesce(abs(f - g) * gap, 0)), 6) AS wd', 'sum(coalesce(abs(f - g) * gap, 0)) AS w')})",
    "kl_hist": f"SELECT col, round(kl, 6) AS kl FROM ({kl_sql(NUM, 20)})",
    "avg_kl_hist": f"SELECT round(avg(kl), 6) AS avg_kl FROM ({kl_sql(NUM, 50)})",
    "corr_frobenius": f"SELECT round(sqrt(2 * list_sum(list_transform(range(1, len(a.v) + 1), lambda i: pow(a.v[i] - b.v[i], 2)))), 6) AS corr_frob FROM ({corr_sql([*NUM, 'l_tax', 'constant'], 'A')}) a, ({corr_sql([*NUM, 'l_tax', 'constant'], 'R')}) b",
    "js_categorical": f"SELECT col, round(js, 6) AS js FROM ({js_sql(O_F, O_O, {'o_orderpriority': 'o_orderpriority', 'half': 'half'})})",
    "js_discrete": f"SELECT col, round(js, 6) AS js FROM ({js_sql(A, B, {'l_linenumber': 'l_linenumber', 'l_quantity': 'round_even(l_quantity, 0)::bigint'})})",
    "composite_score": f"""WITH w AS ({wasserstein_sql(A, B, ['l_extendedprice']).replace('round(sum(coalesce(abs(f - g) * gap, 0)), 6)', 'sum(coalesce(abs(f - g) * gap, 0))')}), j AS ({js_sql(A, B, {'l_linenumber': 'l_linenumber::varchar', 'l_linestatus': 'l_linestatus'})})
        SELECT round(a, 6) AS mean_wd, round(b, 6) AS mean_js, round(a + b, 6) AS composite FROM (SELECT (SELECT avg(wd) FROM w) AS a, (SELECT avg(js) FROM j) AS b)""",
    "sliced_wasserstein": f"SELECT round(avg(w), 6) AS swd FROM ({wasserstein_sql(_proj(0), _proj(1), ['p0', 'p1', 'p2', 'p3']).replace('round(sum(coalesce(abs(f - g) * gap, 0)), 6) AS wd', 'sum(coalesce(abs(f - g) * gap, 0)) AS w')})",
    "column_moments": " UNION ALL ".join(f"SELECT '{c}' AS col, round(avg({c}), 6) AS mean, round(stddev_pop({c}), 6) AS std FROM lineitem" for c in NUM),
    "fold_summary": """WITH f AS (SELECT o_orderstatus, o_totalprice, ntile(5) OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) AS fold FROM orders), m AS (SELECT o_orderstatus, fold, avg(o_totalprice) AS price, count(*)::double AS n FROM f GROUP BY 1, 2)
        SELECT o_orderstatus, round(avg(price), 6) AS price_mean, round(stddev_pop(price), 6) AS price_std, round(avg(n), 6) AS rows_mean, round(stddev_pop(n), 6) AS rows_std FROM m GROUP BY 1""",
    "average_rank": """WITH e AS (SELECT event_type, user_id, round(avg(value), 0) AS score FROM events GROUP BY 1, 2), k AS (SELECT user_id, rank() OVER (PARTITION BY event_type ORDER BY score) + (count(*) OVER (PARTITION BY event_type, score) - 1) / 2.0::double AS rk FROM e)
        SELECT user_id, round(avg(rk), 6) AS avg_rank, count(*) AS n_groups FROM k GROUP BY 1""",
    "r2_delta": """WITH x AS (SELECT l_extendedprice AS y, l_quantity * 1500 AS a, l_quantity * 1400 + 900 AS b FROM lineitem), z AS (SELECT 1 - sum(pow(y - a, 2)) / (var_pop(y) * count(y)) AS ra, 1 - sum(pow(y - b, 2)) / (var_pop(y) * count(y)) AS rb FROM x)
        SELECT round(ra, 6) AS r2_real, round(rb, 6) AS r2_synth, round((rb - ra) / (abs(ra) + 1e-12) * 100, 6) AS delta_r2_percent FROM z""",
    "contingency_counts": f"SELECT bin_l_extendedprice, bin_l_quantity, l_returnflag, count(*) AS n FROM {BINNED} GROUP BY 1, 2, 3",
    "category_universe": "SELECT DISTINCT o_orderpriority FROM orders WHERE o_orderstatus IN ('F', 'P')",
}
