"""Queries of sources, sinks, row helpers, schemas and selection, each with its SQL."""

from __future__ import annotations

from dataclasses import dataclass
from typing import ClassVar

from pyspark.sql import functions as F

from tabweave.functions import scalars
from tabweave.operators import rows as R
from tabweave.operators.datamodule import TabularDataModule
from tabweave.operators.ranks import kfold
from tabweave.operators.schema import TabularSchema, classify, common_numeric, profile, resolve_target
from tabweave.operators.solvers import topological
from tabweave.operators.transforms import DropTypedColumns, OneHot, TransformPipeline, categorical_representation, register_representation, registered
from tabweave.plans import evaluation
from tabweave.plans.q_process import n_sql, u_sql
from tabweave.plans.q_transforms import _lines, r
from tabweave.sources import readers as S
from tabweave.sources.readers import table


def bundle_scan(spark, d):
    """Rows of each table of a bundle, one scan for all."""
    counted = [df.groupBy().agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n")) for n, df in S.read_bundle(spark, d, ["region", "nation", "supplier"]).items()]
    return counted[0].unionByName(counted[1]).unionByName(counted[2])


def bundle_round_trip(spark, d):
    path = S.scratch_path(spark, "bundle")
    S.write_bundle({"supplier": table(spark, d, "supplier")}, path)
    return table(spark, path, "supplier")


def csv_semicolon(spark, d):
    path = S.scratch_path(spark, "csv")
    S.write_csv(table(spark, d, "supplier").withColumn("note", F.lit("a,b")), path, sep=";")
    return S.read_csv(spark, path, numeric=["s_suppkey", "s_nationkey", "s_acctbal"])


def csv_renamed(spark, d):
    path = S.scratch_path(spark, "csv")
    S.write_csv(table(spark, d, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), path)
    return S.read_csv(spark, path, {"c_acctbal": "balance", "c_custkey": "customer"}, numeric=["balance", "c_mktsegment"])


def json_round_trip(spark, d):
    path, o = S.scratch_path(spark, "json"), table(spark, d, "orders").select("o_orderkey", "o_totalprice", F.nullif("o_orderstatus", F.lit("F")).alias("status"))
    S.write_json(o, path)
    return spark.read.schema(o.schema).json(path)


RECORDS = {"tuned": '{"best_params": {"lr": 0.1}, "params": {"lr": 9}}', "plain": '{"params": {"lr": 0.2}}', "flat": '{"lr": 0.3, "note": {"x": 1}}'}


def best_parameters(spark, d):
    return spark.createDataFrame([(n, k, float(v)) for n, text in RECORDS.items() for k, v in S.best_params(text).items()], "record string, parameter string, value double")


def trial_store(spark, d):
    path, trials = S.scratch_path(spark, "trials"), table(spark, d, "part").select(F.col("p_partkey").alias("number"), F.col("p_retailprice").alias("value"))
    for part in (0, 1):
        S.append_trials(trials.filter(F.col("number") % 2 == part), path)
    return spark.read.parquet(path)


def resumed_results(spark, d):
    """Results at a path: none before, all of them after they are written."""
    path = S.scratch_path(spark, "results")
    before = S.existing(spark, path) is None
    table(spark, d, "nation").write.parquet(path)
    return S.existing(spark, path).agg(F.lit(before).alias("none_before"), F.count(F.lit(1)).alias("n"))


def two_moons(spark, d):
    return S.two_moons(spark, 500, 0.2, 42).select("row_id", r("x1", "x1"), r("x2", "x2"), "target")


def housing(spark, d):
    return S.housing(spark, 400, 7).select("row_id", *[r(c, c) for c in S.HOUSING])


def features_with_target(spark, d):
    p = table(spark, d, "part")
    return S.append_features_target(p.select("p_partkey", "p_size", "p_type"), p.select("p_partkey", (F.col("p_size") * 2).alias("p_size"), "p_retailprice"), "p_partkey")


def target_metadata(spark, d):
    o = S.with_table_metadata(table(spark, d, "orders"), "o_totalprice", "regression").filter("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return spark.createDataFrame(list(S.table_metadata(o).items()), "key string, value string")


def strict_numeric(spark, d):
    """Texts that are numbers become numbers, nulls stay; any other text is an error."""
    texts = _lines(spark, d).select("l_orderkey", "l_linenumber", F.nullif(F.col("l_discount").cast("string"), F.lit("0.05")).alias("t"))
    return texts.select("l_orderkey", "l_linenumber", scalars.strict_number(F.col("t")).alias("number"))


def drop_by_type(spark, d):
    return DropTypedColumns().transform(table(spark, d, "orders"))


def drop_by_name(spark, d):
    return DropTypedColumns(cols=["o_orderdate", "o_custkey", "absent"]).transform(table(spark, d, "orders"))


WANTED = [" b", "b ", "c", None]


def target_by_name(spark, d):
    return spark.createDataFrame([(i, resolve_target(["a", "b", " c "], w)) for i, w in enumerate(WANTED)], "nth int, column string")


def nan_filter(spark, d):
    x = _lines(spark, d).select("l_orderkey", "l_linenumber", F.when(F.col("l_discount") == 0, F.lit(float("nan"))).otherwise(F.col("l_discount")).alias("a"), F.nullif("l_tax", F.lit(0.0)).alias("b"))
    return R.require_no_nan(R.without_nan(x))


def repeated_rows(spark, d):
    return R.repeat_rows(table(spark, d, "supplier").select("s_suppkey"), 3)


def column_order(spark, d):
    """Columns of a generated table in the order of the real one, then the rest."""
    cols = R.restore_order(table(spark, d, "part"), ["p_size", "absent", "p_partkey"]).columns
    return spark.createDataFrame(list(enumerate(cols)), "place int, col string")


def shared_numeric(spark, d):
    a, b = table(spark, d, "customer"), table(spark, d, "customer").withColumn("c_acctbal", F.col("c_acctbal").cast("string")).withColumn("c_mktsegment", F.length("c_mktsegment"))
    return spark.createDataFrame([(c,) for c in common_numeric(a, b)], "col string")


def row_blocks(spark, d):
    """Blocks of rows one under the other, as folds are put together again."""
    folds = kfold(table(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 3, 5)
    out = folds.filter("fold = 0")
    for i in (1, 2):
        out = out.unionByName(folds.filter(F.col("fold") == i))
    return out


def top_rows(spark, d):
    return table(spark, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10).select("o_orderkey", "o_totalprice")


def best_trial(spark, d):
    trials = table(spark, d, "part").select(F.col("p_partkey").alias("number"), F.when(F.col("p_size") < 10, F.lit(float("inf"))).otherwise(F.col("p_retailprice")).alias("value"))
    return evaluation.best_trial(trials)


def model_comparison(spark, d):
    """Models ranked by texts of mean and spread; of an R2 the absolute value counts."""
    n = table(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return evaluation.compare_models(n.withColumn("r2_text", F.concat(F.lit("-"), F.col("n").cast("string"), F.lit(" ± 0.5"))), "o_orderstatus", "o_orderpriority", "r2_text").select("o_orderpriority", r("avg_rank", "avg_rank"), "n_groups")


def column_topology(spark, d):
    order = topological(["d", "c", "b", "a", "e"], {"d": ["b", "c"], "c": ["a"], "b": ["a"]})
    return spark.createDataFrame(list(enumerate(order)), "place int, col string")


def _message(f) -> str:
    try:
        f()
    except (ValueError, TypeError, KeyError) as e:
        return str(e).strip("'\"")
    return ""


def schema_checks(spark, d):
    p, s = table(spark, d, "part"), TabularSchema
    cases = {
        "fine": s(("p_retailprice",), ("p_size",), ("p_type",), id="p_partkey"),
        "missing": s(("p_size", "absent"), target="gone"),
        "twice": s(("p_size", "p_size")),
        "two kinds": s(("p_size",), ("p_size",)),
        "target as feature": s(("p_size",), target="p_size"),
        "text as number": s(("p_type",)),
        "one column for both": s(("p_size",), target="p_partkey", id="p_partkey"),
    }
    return spark.createDataFrame([(k, _message(lambda v=v: v.validate(p))) for k, v in cases.items()], "case string, message string")


def schema_inferred(spark, d):
    lines = _lines(spark, d).select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag", "l_tax")
    s = TabularSchema.infer(lines, target="l_tax", id="l_orderkey", categorical=["l_linenumber"])
    kinds = {"continuous": s.continuous, "discrete": s.discrete, "categorical": s.categorical, "target": (s.target,), "id": (s.id,)}
    return spark.createDataFrame([(c, k) for k, cols in kinds.items() for c in cols], "col string, kind string")


def all_null_kinds(spark, d):
    """Columns without any value: integers count as discrete, others as continuous."""
    x = table(spark, d, "region").select(F.lit(None).cast("int").alias("a"), F.lit(None).cast("double").alias("b"), F.lit(None).cast("string").alias("c"))
    stats = profile(x)
    return spark.createDataFrame([(c, stats[c]["nulls"], classify(x.schema[c].dataType, stats[c])) for c in x.columns], "col string, n_null bigint, kind string")


def representation_by_name(spark, d):
    """A representation of categories that is registered under a name of its own, then asked for by it."""
    register_representation("indicator", OneHot)
    o = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return categorical_representation("indicator").fit(o, TabularSchema(categorical=("o_orderstatus",))).transform(o)




@registered
@dataclass
class LosesColumns(DropTypedColumns):
    """A learned step that drops columns; a data module must notice if the target is among them."""

    requires_fit: ClassVar[bool] = True


def fold_checks(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", "p_retailprice")
    s = TabularSchema(("p_retailprice",), target="p_size", id="p_partkey")
    cases = {"fine": TransformPipeline.dropna_and_scale(), "target lost": TransformPipeline([*TransformPipeline.dropna_and_scale().steps, LosesColumns(cols=["p_size"])])}

    def rows(pipe):
        f = TabularDataModule(p, s, pipe, "p_partkey").prepare_kfold(4, 1).fold(2)
        return f.train.count(), f.test.count()

    out = []
    for name, pipe in cases.items():
        try:
            n = rows(pipe)
            out.append((name, *n, ""))
        except ValueError as e:
            out.append((name, -1, -1, str(e)))
    return spark.createDataFrame(out, "case string, n_train bigint, n_test bigint, message string")


_half = "WITH p AS (SELECT p_partkey, (ntile(4) OVER (ORDER BY md5('1|' || p_partkey), p_partkey) - 1) AS fold FROM part) "
_angle = u_sql("moon42", "i")
_house = {c: f"round({lo!r}::double + ({hi - lo!r}::double) * {u_sql(f'house7:{c}', 'i')}, 6) AS {c}" for c, (lo, hi) in S.HOUSING_RANGES.items()}
_plain = {c: f"({lo!r}::double + ({hi - lo!r}::double) * {u_sql(f'house7:{c}', 'i')})" for c, (lo, hi) in S.HOUSING_RANGES.items()}

QUERIES = {f.__name__: f for f in (bundle_scan, bundle_round_trip, csv_semicolon, csv_renamed, json_round_trip, best_parameters, trial_store, resumed_results, two_moons, housing, features_with_target, target_metadata, strict_numeric, drop_by_type, drop_by_name, target_by_name, nan_filter, repeated_rows, column_order, shared_numeric, row_blocks, top_rows, best_trial, model_comparison, column_topology, schema_checks, schema_inferred, all_null_kinds, representation_by_name, fold_checks)}
ORACLES = {
    "bundle_scan": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in ("region", "nation", "supplier")),
    "bundle_round_trip": "SELECT * FROM supplier",
    "csv_semicolon": "SELECT s_suppkey::double AS s_suppkey, s_name, s_nationkey::double AS s_nationkey, s_acctbal, 'a,b' AS note FROM supplier",
    "csv_renamed": "SELECT c_custkey::varchar AS customer, c_acctbal AS balance, NULL::double AS c_mktsegment FROM customer",
    "json_round_trip": "SELECT o_orderkey, o_totalprice, nullif(o_orderstatus, 'F') AS status FROM orders",
    "best_parameters": "SELECT * FROM (VALUES ('tuned', 'lr', 0.1::double), ('plain', 'lr', 0.2::double), ('flat', 'lr', 0.3::double)) t(record, parameter, value)",
    "trial_store": "SELECT p_partkey AS number, p_retailprice AS value FROM part",
    "resumed_results": "SELECT true AS none_before, count(*) AS n FROM nation",
    "two_moons": f"""SELECT i AS row_id, round(CASE WHEN i % 2 = 0 THEN cos({_angle} * pi()) ELSE 1 - cos({_angle} * pi()) END + 0.2::double * {n_sql('m142', 'i')}, 6) AS x1,
        round(CASE WHEN i % 2 = 0 THEN sin({_angle} * pi()) ELSE 0.5::double - sin({_angle} * pi()) END + 0.2::double * {n_sql('m242', 'i')}, 6) AS x2, CASE WHEN i % 2 = 0 THEN '0' ELSE '1' END AS target FROM range(500) t(i)""",
    "housing": "SELECT i AS row_id, " + ", ".join(_house.values()) + f", round(0.45::double * {_plain['med_inc']} + 0.01::double * {_plain['house_age']} - 0.4::double * ({_plain['latitude']} - 35.6::double) * 0.1::double + 0.3::double * {n_sql('house7:noise', 'i')}, 6) AS med_house_val FROM range(400) t(i)",
    "features_with_target": "SELECT p_partkey, p_size, p_type, p_size * 2 AS target__p_size, p_retailprice FROM part",
    "target_metadata": "SELECT * FROM (VALUES ('target', 'o_totalprice'), ('task', 'regression')) t(key, value)",
    "strict_numeric": "SELECT l_orderkey, l_linenumber, nullif(l_discount, 0.05) AS number FROM lineitem",
    "drop_by_type": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    "drop_by_name": "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders",
    "target_by_name": "SELECT * FROM (VALUES (0, 'b'), (1, 'b'), (2, ' c '), (3, ' c ')) t(nth, \"column\")",
    "nan_filter": "SELECT l_orderkey, l_linenumber, l_discount AS a, l_tax AS b FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0",
    "repeated_rows": "SELECT s_suppkey, i::int AS rep FROM supplier, range(3) t(i)",
    "column_order": "SELECT * FROM (VALUES (0, 'p_size'), (1, 'p_partkey'), (2, 'p_name'), (3, 'p_brand'), (4, 'p_type'), (5, 'p_retailprice')) t(place, col)",
    "shared_numeric": "SELECT * FROM (VALUES ('c_custkey'), ('c_nationkey')) t(col)",
    "row_blocks": "SELECT s_suppkey, (ntile(3) OVER (ORDER BY md5('5|' || s_suppkey), s_suppkey) - 1)::int AS fold FROM supplier",
    "top_rows": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10",
    "best_trial": "SELECT p_partkey AS number, p_retailprice AS value FROM part WHERE p_size >= 10 ORDER BY p_retailprice, p_partkey LIMIT 1",
    "model_comparison": """WITH n AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2), k AS (SELECT o_orderpriority, rank() OVER (PARTITION BY o_orderstatus ORDER BY n) + (count(*) OVER (PARTITION BY o_orderstatus, n) - 1) / 2.0::double AS rk FROM n)
        SELECT o_orderpriority, round(avg(rk), 6) AS avg_rank, count(*) AS n_groups FROM k GROUP BY 1""",
    "column_topology": "SELECT * FROM (VALUES (0, 'a'), (1, 'c'), (2, 'b'), (3, 'd'), (4, 'e')) t(place, col)",
    "schema_checks": "SELECT * FROM (VALUES ('fine', ''), ('missing', 'missing columns: [''absent'', ''gone'']'), ('twice', 'a column is listed twice as continuous'), ('two kinds', 'a column has two kinds'), ('target as feature', 'p_size is no feature'), ('text as number', 'p_type is not numeric'), ('one column for both', 'id and target are the same column')) t(\"case\", message)",
    "schema_inferred": "SELECT 'l_orderkey' AS col, 'id' AS kind UNION ALL SELECT 'l_tax', 'target' UNION ALL SELECT 'l_linenumber', 'categorical' UNION ALL SELECT 'l_returnflag', 'categorical' UNION ALL " + " UNION ALL ".join(f"SELECT '{c}', CASE WHEN count(DISTINCT {c}) < 20 AND bool_and(abs({c} - round_even({c}, 0)) <= 1e-12) THEN 'discrete' ELSE 'continuous' END FROM lineitem" for c in ("l_quantity", "l_discount")),
    "all_null_kinds": "SELECT col, (SELECT count(*) FROM region) AS n_null, kind FROM (VALUES ('a', 'discrete'), ('b', 'continuous'), ('c', 'categorical')) t(col, kind)",
    "representation_by_name": "SELECT o_orderkey, " + ", ".join(f"(o_orderstatus = '{v}')::int::double AS o_orderstatus_{v}" for v in "FOP") + " FROM orders",
    "fold_checks": _half + "SELECT 'fine' AS \"case\", count(*) FILTER (fold <> 2) AS n_train, count(*) FILTER (fold = 2) AS n_test, '' AS message FROM p UNION ALL SELECT 'target lost', -1, -1, 'a transform dropped [''p_size'']'",
}
