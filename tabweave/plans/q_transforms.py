"""Queries of profiling, transforms and splits, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabweave.functions import scalars
from tabweave.operators import metrics, ranks
from tabweave.operators.datamodule import TabularDataModule
from tabweave.operators.schema import TabularSchema, classify, detect_task, profile
from tabweave.operators.transforms import DropMissingRows, IntegerCode, OneHot, StandardScaler, TransformPipeline, TypeAwareImputer
from tabweave.sources.readers import table

R = 6
NUM = ["l_quantity", "l_extendedprice", "l_discount"]
FLAGS = TabularSchema(categorical=("l_returnflag", "l_linestatus"))


def r(c, name: str):
    return F.round(F.col(c) if isinstance(c, str) else c, R).alias(name)


def _lines(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def _holed(spark, d):
    """lineitem with nulls where the discount is 0 and where the flag is N."""
    return _lines(spark, d).withColumn("l_discount", F.nullif("l_discount", F.lit(0.0))).withColumn("l_returnflag", F.nullif("l_returnflag", F.lit("N")))


def profile_schema(spark: SparkSession, d: str) -> DataFrame:
    cols = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"]
    df = _lines(spark, d).select(*cols)
    stats = profile(df, cols)
    rows = [(c, s["rows"], s["nulls"], s["distinct"], classify(df.schema[c].dataType, s)) for c, s in stats.items()]
    return spark.createDataFrame(rows, "col string, n_rows bigint, n_null bigint, n_distinct_capped bigint, kind string")


PROFILE_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS col, count(*) AS n_rows, count(*) - count({c}) AS n_null, least(count(DISTINCT {c}), 20)::bigint AS n_distinct_capped, {kind} AS kind FROM lineitem"
    for c, kind in (
        ("l_orderkey", "CASE WHEN count(DISTINCT l_orderkey) < 20 THEN 'discrete' ELSE 'continuous' END"),
        ("l_linenumber", "CASE WHEN count(DISTINCT l_linenumber) < 20 THEN 'discrete' ELSE 'continuous' END"),
        ("l_quantity", "CASE WHEN count(DISTINCT l_quantity) < 20 AND bool_and(abs(l_quantity - round_even(l_quantity, 0)) <= 1e-12) THEN 'discrete' ELSE 'continuous' END"),
        ("l_discount", "CASE WHEN count(DISTINCT l_discount) < 20 AND bool_and(abs(l_discount - round_even(l_discount, 0)) <= 1e-12) THEN 'discrete' ELSE 'continuous' END"),
        ("l_returnflag", "'categorical'"),
    )
)


def dropna_rows(spark, d):
    schema = TabularSchema(continuous=("l_discount",), categorical=("l_returnflag",))
    df = _holed(spark, d)
    return DropMissingRows().fit(df, schema).transform(df).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r(F.sum("l_discount"), "discounts"))


def coerce_numeric(spark, d):
    e = table(spark, d, "events")
    return e.select("event_id", scalars.to_number(F.get_json_object("props", "$.k")).alias("k"), scalars.to_number(F.col("event_type")).alias("not_a_number"))


def slugify_names(spark, d):
    return table(spark, d, "part").select("p_partkey", scalars.slugify(F.concat(F.lit(" "), "p_name", F.lit("--"), "p_type")).alias("slug"))


def parse_means(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", r(scalars.first_number(F.concat(F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit(" ± 0.01"))), "mean_value"))


def impute(spark, d):
    schema = TabularSchema(continuous=("l_discount",), categorical=("l_returnflag",))
    df = _holed(spark, d)
    out = TypeAwareImputer().fit(df, schema).transform(df)
    return out.groupBy("l_returnflag", "l_discount").agg(F.count(F.lit(1)).alias("n"))


def impute_mean_constant(spark, d):
    schema = TabularSchema(continuous=("l_discount",), categorical=("l_returnflag",))
    df = _holed(spark, d)
    out = TypeAwareImputer(continuous="mean", categorical="constant").fit(df, schema).transform(df)
    return out.groupBy("l_returnflag", F.round("l_discount", R).alias("l_discount")).agg(F.count(F.lit(1)).alias("n"))


def impute_discrete(spark, d):
    """The discrete mode, and the discrete median rounded half to even."""
    df = table(spark, d, "part").select("p_partkey", F.nullif("p_size", F.lit(7)).alias("p_size"), F.nullif("p_size", F.lit(9)).alias("other"))
    a = TypeAwareImputer(discrete="mode").fit(df, TabularSchema(discrete=("p_size",)))
    b = TypeAwareImputer(discrete="median").fit(df, TabularSchema(discrete=("other",)))
    return b.transform(a.transform(df))


def _scaled(spark, d):
    df = _lines(spark, d)
    s = StandardScaler().fit(df, TabularSchema(continuous=tuple(NUM)))
    return df, s


def standard_scale(spark, d):
    df, s = _scaled(spark, d)
    return s.transform(df).select("l_orderkey", "l_linenumber", *[r(c, c) for c in NUM])


def inverse_scale(spark, d):
    df, s = _scaled(spark, d)
    return s.inverse(s.transform(df)).select("l_orderkey", "l_linenumber", *[r(c, c) for c in NUM])


def one_hot(spark, d):
    df = _lines(spark, d).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    return OneHot().fit(df, FLAGS).transform(df)


def one_hot_inverse(spark, d):
    """Fitted without R, so that R is unknown: all zeros, and null on the way back."""
    df = _lines(spark, d).select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    enc = OneHot().fit(df.filter("l_returnflag <> 'R'"), FLAGS)
    return enc.inverse(enc.transform(df))


def integer_code(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus")
    return IntegerCode().fit(df, TabularSchema(categorical=("o_orderpriority", "o_orderstatus"))).transform(df)


def _coded(spark, d):
    df = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    enc = IntegerCode().fit(df.filter("o_orderpriority <> '1-URGENT'"), TabularSchema(categorical=("o_orderpriority",)))
    return df, enc


def integer_code_unknown(spark, d):
    df, enc = _coded(spark, d)
    return enc.transform(df)


def integer_decode(spark, d):
    df, enc = _coded(spark, d)
    return enc.inverse(enc.transform(df))


def kfold_assign(spark, d):
    return ranks.kfold(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5, 42)


def kfold_sizes(spark, d):
    return ranks.kfold(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 7, 42).groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


def stratified_kfold(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    return ranks.kfold(o, "o_orderkey", 5, 42, "o_orderpriority")


def holdout_split(spark, d):
    return ranks.holdout(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 0.2, 42)


def permutation(spark, d):
    return ranks.permutation_rank(table(spark, d, "customer").select("c_custkey"), "c_custkey", 7, "rank").select("c_custkey", "rank")


def sample_rows(spark, d):
    return ranks.sample_without_replacement(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 500, 42)


def sample_replacement(spark, d):
    return ranks.sample_with_replacement(table(spark, d, "customer").select("c_custkey"), "c_custkey", 300, 42)


def train_only_fit(spark, d):
    """Scaled by the train part of a holdout: both parts' means show that only train rows were used."""
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    m = TabularDataModule(p, TabularSchema(continuous=("p_size", "p_retailprice"), id="p_partkey"), TransformPipeline.dropna_and_scale(), "p_partkey")
    h = m.prepare_holdout(0.2, 42).holdout()
    both = h.train.withColumn("part", F.lit("train")).unionByName(h.val.withColumn("part", F.lit("val")))
    return both.groupBy("part").agg(F.count(F.lit(1)).alias("n"), *[r(F.avg(c), f"mean_{c}") for c in ("p_size", "p_retailprice")])


def train_test_distance(spark, d):
    """Flagship: how far is the held-out fifth of the order lines' parts from the rest, after scaling by the rest."""
    cols = ["p_size", "p_retailprice"]
    p = table(spark, d, "part").select("p_partkey", *cols)
    m = TabularDataModule(p, TabularSchema(continuous=tuple(cols), id="p_partkey"), TransformPipeline.dropna_and_scale(), "p_partkey")
    h = m.prepare_holdout(0.2, 42).holdout()
    return metrics.wasserstein_by_column(h.train, h.val, cols).select("col", r("wd", "wd"))


def task_detect(spark, d):
    p, o = table(spark, d, "part"), table(spark, d, "orders")
    rows = [("p_size", detect_task(p, "p_size")), ("p_retailprice", detect_task(p, "p_retailprice")), ("o_orderstatus", detect_task(o, "o_orderstatus")), ("l_linenumber", detect_task(table(spark, d, "lineitem"), "l_linenumber"))]
    return spark.createDataFrame(rows, "target string, task string")


def snap_support(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", scalars.snap(F.col("p_retailprice"), [900.0, 1000.0, 1250.5, 1500.0, 2000.0]).alias("snapped"))


def nearest_code(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", scalars.clip_to_code(F.col("p_size") / 2 - 3, 10).alias("code"))


def quantile_bins(spark, d):
    out, _ = metrics.quantile_bins(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"])
    return out.select("o_orderkey", "bin_o_totalprice")


HOLED = "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0) AS l_discount, nullif(l_returnflag, 'N') AS l_returnflag FROM lineitem"
SCALED = ", ".join(f"avg({c}) AS m_{c}, greatest(stddev_pop({c}), 1e-12) AS s_{c}" for c in NUM)
PERM = "SELECT *, row_number() OVER (ORDER BY md5('{seed}|' || {id}), {id}) AS rk, count(*) OVER () AS n FROM {t}"

QUERIES = {f.__name__: f for f in (profile_schema, dropna_rows, coerce_numeric, slugify_names, parse_means, impute, impute_mean_constant, impute_discrete, standard_scale, inverse_scale, one_hot, one_hot_inverse, integer_code, integer_code_unknown, integer_decode, kfold_assign, kfold_sizes, stratified_kfold, holdout_split, permutation, sample_rows, sample_replacement, train_only_fit, train_test_distance, task_detect, snap_support, nearest_code, quantile_bins)}

ORACLES = {
    "profile_schema": PROFILE_SQL,
    "dropna_rows": f"SELECT l_returnflag, count(*) AS n, round(sum(l_discount), 6) AS discounts FROM ({HOLED}) WHERE l_discount IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1",
    "coerce_numeric": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS double) AS k, try_cast(event_type AS double) AS not_a_number FROM events",
    "slugify_names": "SELECT p_partkey, CASE WHEN s = '' THEN 'dataset' ELSE s END AS slug FROM (SELECT p_partkey, regexp_replace(regexp_replace(lower(' ' || p_name || '--' || p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS s FROM part)",
    "parse_means": "SELECT p_partkey, round(p_retailprice::decimal(12,2)::double, 6) AS mean_value FROM part",
    "impute": f"""WITH h AS ({HOLED}), f AS (SELECT (SELECT median(l_discount) FROM h) AS md, (SELECT l_returnflag FROM h WHERE l_returnflag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mo)
        SELECT coalesce(l_returnflag, mo) AS l_returnflag, coalesce(l_discount, md) AS l_discount, count(*) AS n FROM h, f GROUP BY 1, 2""",
    "impute_mean_constant": f"""WITH h AS ({HOLED}), f AS (SELECT avg(l_discount) AS m FROM h)
        SELECT coalesce(l_returnflag, '__missing__') AS l_returnflag, round(coalesce(l_discount, m), 6) AS l_discount, count(*) AS n FROM h, f GROUP BY 1, 2""",
    "impute_discrete": """WITH h AS (SELECT p_partkey, nullif(p_size, 7) AS p_size, nullif(p_size, 9) AS other FROM part),
        f AS (SELECT (SELECT p_size FROM h WHERE p_size IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mo, (SELECT round_even(median(other), 0)::int FROM h) AS md)
        SELECT p_partkey, coalesce(p_size, mo) AS p_size, coalesce(other, md) AS other FROM h, f""",
    "standard_scale": f"WITH s AS (SELECT {SCALED} FROM lineitem) SELECT l_orderkey, l_linenumber, " + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in NUM) + " FROM lineitem, s",
    "inverse_scale": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"round({c}::double, 6) AS {c}" for c in NUM) + " FROM lineitem",
    "one_hot": "SELECT l_orderkey, l_linenumber, " + ", ".join(f"CASE WHEN {c} = '{v}' THEN 1.0::double ELSE 0.0::double END AS {c}_{v}" for c, vs in (("l_returnflag", "ANR"), ("l_linestatus", "FO")) for v in vs) + " FROM lineitem",
    "one_hot_inverse": "SELECT l_orderkey, l_linenumber, nullif(l_returnflag, 'R') AS l_returnflag, l_linestatus FROM lineitem",
    "integer_code": "SELECT o_orderkey, (SELECT count(DISTINCT b.o_orderpriority) FROM orders b WHERE b.o_orderpriority < a.o_orderpriority)::int AS o_orderpriority, (SELECT count(DISTINCT b.o_orderstatus) FROM orders b WHERE b.o_orderstatus < a.o_orderstatus)::int AS o_orderstatus FROM orders a",
    "integer_code_unknown": "SELECT o_orderkey, coalesce(code, -1)::int AS o_orderpriority FROM orders LEFT JOIN (SELECT p, row_number() OVER (ORDER BY p) - 1 AS code FROM (SELECT DISTINCT o_orderpriority AS p FROM orders WHERE o_orderpriority <> '1-URGENT')) ON p = o_orderpriority",
    "integer_decode": "SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS o_orderpriority FROM orders",
    "kfold_assign": "SELECT o_orderkey, (ntile(5) OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1)::int AS fold FROM orders",
    "kfold_sizes": "SELECT fold, count(*) AS n FROM (SELECT (ntile(7) OVER (ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1)::int AS fold FROM orders) GROUP BY 1",
    "stratified_kfold": "SELECT o_orderkey, o_orderpriority, ((row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('42|' || o_orderkey), o_orderkey) - 1) % 5)::int AS fold FROM orders",
    "holdout_split": f"SELECT o_orderkey, rk <= least(greatest(round_even(n * 0.2::double, 0), 1), n - 1) AS is_val FROM ({PERM.format(seed=42, id='o_orderkey', t='orders')})",
    "permutation": f"SELECT c_custkey, rk AS rank FROM ({PERM.format(seed=7, id='c_custkey', t='customer')})",
    "sample_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 500",
    "sample_replacement": f"""WITH p AS ({PERM.format(seed=42, id='c_custkey', t='customer')}), d AS (SELECT i AS draw, floor((('0x' || substr(md5('42:draw|' || i), 1, 13))::ubigint + 0.5) / 4503599627370496.0 * (SELECT count(*) FROM customer))::bigint + 1 AS rk FROM range(300) t(i))
        SELECT draw, c_custkey FROM d JOIN p USING (rk)""",
    "train_only_fit": f"""WITH p AS ({PERM.format(seed=42, id='p_partkey', t='part')}), h AS (SELECT *, CASE WHEN rk <= least(greatest(round_even(n * 0.2::double, 0), 1), n - 1) THEN 'val' ELSE 'train' END AS part FROM p),
        s AS (SELECT avg(p_size) AS m1, greatest(stddev_pop(p_size), 1e-12) AS s1, avg(p_retailprice) AS m2, greatest(stddev_pop(p_retailprice), 1e-12) AS s2 FROM h WHERE part = 'train')
        SELECT part, count(*) AS n, round(avg((p_size - m1) / s1), 6) + 0.0 AS mean_p_size, round(avg((p_retailprice - m2) / s2), 6) + 0.0 AS mean_p_retailprice FROM h, s GROUP BY 1""",
    "task_detect": """SELECT 'p_size' AS target, CASE WHEN count(DISTINCT p_size) <= 20 THEN 'classification' ELSE 'regression' END AS task FROM part
        UNION ALL SELECT 'p_retailprice', CASE WHEN count(DISTINCT p_retailprice) <= 20 AND bool_and(p_retailprice = round(p_retailprice)) THEN 'classification' ELSE 'regression' END FROM part
        UNION ALL SELECT 'o_orderstatus', 'classification' UNION ALL SELECT 'l_linenumber', CASE WHEN count(DISTINCT l_linenumber) <= 20 THEN 'classification' ELSE 'regression' END FROM lineitem""",
    "snap_support": "SELECT p_partkey, v AS snapped FROM (SELECT p_partkey, v, row_number() OVER (PARTITION BY p_partkey ORDER BY abs(p_retailprice - v), v) AS k FROM part, (SELECT unnest([900.0::double, 1000.0, 1250.5, 1500.0, 2000.0]) AS v)) WHERE k = 1",
    "nearest_code": "SELECT p_partkey, least(greatest(round_even(p_size / 2 - 3, 0), 0), 9)::int AS code FROM part",
    "quantile_bins": "WITH q AS (SELECT quantile_cont(o_totalprice, [0.2, 0.4, 0.6, 0.8]) AS e FROM orders) SELECT o_orderkey, len(list_filter(e, lambda x: x <= o_totalprice))::int AS bin_o_totalprice FROM orders, q",
}
PART_SPLIT = f"WITH p AS ({PERM.format(seed=42, id='p_partkey', t='part')}), h AS (SELECT *, rk <= least(greatest(round_even(n * 0.2::double, 0), 1), n - 1) AS is_val FROM p)"


def wasserstein_sql(a: str, b: str, cols: list[str]) -> str:
    """(col, wd) of two SELECTs that give the same columns, by a cumulative sum over all values."""
    long = " UNION ALL ".join(f"SELECT '{c}' AS col, {c}::double AS v, {na} AS na, {nb} AS nb FROM ({q})" for c in cols for q, na, nb in ((a, 1, 0), (b, 0, 1)))
    return f"""SELECT col, round(sum(coalesce(abs(f - g) * gap, 0)), 6) AS wd FROM (
        SELECT col, lead(v) OVER w - v AS gap, sum(na) OVER w / sum(na) OVER (PARTITION BY col)::double AS f, sum(nb) OVER w / sum(nb) OVER (PARTITION BY col)::double AS g
        FROM (SELECT col, v, sum(na)::double AS na, sum(nb)::double AS nb FROM ({long}) GROUP BY 1, 2) WINDOW w AS (PARTITION BY col ORDER BY v)) GROUP BY 1"""


_S = "SELECT (p_size - m1) / s1 AS p_size, (p_retailprice - m2) / s2 AS p_retailprice FROM h, s WHERE {}is_val"
ORACLES["train_test_distance"] = PART_SPLIT + ", s AS (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2, stddev_pop(p_retailprice) AS s2 FROM h WHERE NOT is_val) " + wasserstein_sql(_S.format("NOT "), _S.format(""), ["p_size", "p_retailprice"])
