"""Schema inference, transforms, splits and the data module on hand-made fixtures."""

import math

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tabweave.operators import ranks
from tabweave.operators.datamodule import TabularDataModule
from tabweave.operators.schema import TabularSchema, common_numeric, detect_task, resolve_target
from tabweave.operators.transforms import (
    DropMissingRows,
    DropTypedColumns,
    IntegerCode,
    OneHot,
    StandardScaler,
    TransformPipeline,
    TypeAwareImputer,
    exact_quantiles,
    of_state,
)


@pytest.fixture(scope="module")
def kinds(spark):
    return spark.range(40).select(
        (F.col("id") % 2 == 0).alias("flag"),
        F.concat(F.lit("c"), F.col("id") % 3).alias("text"),
        (F.col("id") % 19).cast("int").alias("i19"),
        (F.col("id") % 20).cast("int").alias("i20"),
        (F.col("id") % 3).cast("double").alias("whole"),
        (F.col("id") / 7).alias("fraction"),
        F.lit(None).cast("int").alias("no_int"),
        F.lit(None).cast("double").alias("no_double"),
        F.current_timestamp().alias("at"),
    )


def test_kinds(kinds):
    s = TabularSchema.infer(kinds.drop("at"))
    assert s.categorical == ("flag", "text") and s.discrete == ("i19", "whole", "no_int") and s.continuous == ("i20", "fraction", "no_double")
    with pytest.raises(TypeError):
        TabularSchema.infer(kinds)
    assert "at" not in DropTypedColumns().transform(kinds).columns
    named = TabularSchema.infer(kinds.drop("at"), target="i19", continuous=["whole"])
    assert named.continuous[0] == "whole" and "i19" not in named.features


def test_validation(kinds):
    for bad in (TabularSchema(continuous=("x",)), TabularSchema(continuous=("i19", "i19")), TabularSchema(continuous=("i19",), discrete=("i19",)), TabularSchema(continuous=("i19",), target="i19"), TabularSchema(target="i19", id="i19"), TabularSchema(continuous=("text",)), TabularSchema(id="no_int")):
        with pytest.raises(ValueError):
            bad.validate(kinds)


def test_names(kinds):
    assert resolve_target(["a", " shares"], "shares") == " shares" and resolve_target(["a", "b"], None) == "b"
    with pytest.raises(KeyError):
        resolve_target(["a"], "b")
    assert common_numeric(kinds, kinds.drop("i19"), exclude=["i20"]) == ["whole", "fraction", "no_int", "no_double"]
    assert detect_task(kinds, "i20") == "classification" and detect_task(kinds, "fraction") == "regression"


@pytest.fixture(scope="module")
def holes(spark):
    nan = float("nan")
    rows = [(1.0, 3, "b", None), (nan, 3, "a", None), (None, None, None, None), (4.0, 2, "b", None), (7.0, 2, "a", None)]
    return spark.createDataFrame(rows, "x double, k int, c string, e string")


def test_imputer(holes):
    s = TabularSchema(continuous=("x",), discrete=("k",), categorical=("c", "e"))
    imp = TypeAwareImputer().fit(holes, s)
    assert imp.fill == {"x": 4.0, "k": 2, "c": "a", "e": "__missing__"}
    assert imp.transform(holes).filter("x is null or isnan(x) or k is null or c is null or e is null").count() == 0
    assert TypeAwareImputer(discrete="mean").fit(holes, s).fill["k"] == 2  # 2.5, half to even
    assert TypeAwareImputer(continuous="constant", constant=9.0).fit(holes, s).fill["x"] == 9.0
    assert DropMissingRows().fit(holes, TabularSchema(continuous=("x",), discrete=("k",))).transform(holes).count() == 3


def test_scaler_floor_and_inverse(spark):
    df = spark.createDataFrame([(5.0, 1.0), (5.0, 2.0), (5.0, 6.0)], "a double, b double")
    sc = StandardScaler().fit(df, TabularSchema(continuous=("a", "b")))
    assert sc.stats["a"] == [5.0, 1e-12]
    back = sc.inverse(sc.transform(df)).collect()
    assert [x for r in back for x in r] == pytest.approx([5.0, 1.0, 5.0, 2.0, 5.0, 6.0])


def test_encoders_unknown(spark):
    s = TabularSchema(categorical=("c",))
    train, test = (spark.createDataFrame(r, "id int, c string") for r in ([(0, "x"), (1, "y")], [(0, "x"), (1, "z"), (2, None)]))
    hot = OneHot().fit(train, s)
    assert [tuple(r) for r in hot.transform(test).collect()] == [(0, 1.0, 0.0), (1, 0.0, 0.0), (2, 0.0, 0.0)]
    assert [r.c for r in hot.inverse(hot.transform(test)).collect()] == ["x", None, None]
    code = IntegerCode().fit(train, s)
    assert [r.c for r in code.transform(test).collect()] == [0, -1, -1]
    assert [r.c for r in code.inverse(code.transform(test)).collect()] == ["x", None, None]
    with pytest.raises(ValueError):
        IntegerCode("raise", code.categories).transform(test)
    many = spark.range(300).select(F.col("id").cast("int"), F.format_string("v%03d", "id").alias("c"))
    wide = IntegerCode().fit(many, s)
    assert wide.transform(many).filter("id <> c").count() == 0 and wide.inverse(wide.transform(many)).exceptAll(many).count() == 0


def test_state_round_trip(spark, holes):
    s = TabularSchema(continuous=("x",), categorical=("c",))
    pipe = TransformPipeline.impute_scale_integer().fit(holes, s)
    again = TransformPipeline.of_state(pipe.state())
    assert sorted(map(str, again.transform(holes).collect())) == sorted(map(str, pipe.transform(holes).collect()))
    with pytest.raises(KeyError):
        of_state({"name": "Nothing", "params": {}})


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60), st.sampled_from([0.0, 0.2, 0.5, 0.9, 1.0]))
def test_exact_quantiles(spark, xs, q):
    import numpy as np

    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert exact_quantiles(df, ["x"], q)["x"] == pytest.approx(float(np.quantile(xs, q)), rel=1e-9, abs=1e-9)


@pytest.mark.parametrize("n,k,sizes", [(13, 5, [2, 2, 3, 3, 3]), (10, 5, [2] * 5), (3, 3, [1, 1, 1])])
def test_fold_sizes(spark, n, k, sizes):
    folds = ranks.kfold(spark.range(n), "id", k, 1).groupBy("fold").count().collect()
    assert sorted(r["count"] for r in folds) == sizes


def test_splits_do_not_depend_on_partitions(spark):
    df = spark.range(500)
    one = {tuple(r) for r in ranks.kfold(df.coalesce(1), "id", 4, 3).collect()}
    assert one == {tuple(r) for r in ranks.kfold(df.repartition(9), "id", 4, 3).collect()}
    with pytest.raises(ValueError):
        ranks.kfold(df, "id", 1, 3)
    with pytest.raises(ValueError):
        ranks.holdout(df, "id", 1.0, 3)
    assert ranks.holdout(spark.range(2), "id", 0.01, 3).filter("is_val").count() == 1
    strat = ranks.kfold(df.withColumn("y", F.col("id") % 3), "id", 5, 3, "y").groupBy("y", "fold").count().agg(F.min("count"), F.max("count")).collect()[0]
    assert strat[1] - strat[0] <= 1


def test_fit_sees_train_rows_only(spark):
    df = spark.range(100).select("id", (F.col("id") * 1.5).alias("x"))
    s = TabularSchema(continuous=("x",), id="id")
    m = lambda d: TabularDataModule(d, s, TransformPipeline.dropna_and_scale(), "id").prepare_kfold(5, 7)
    one = m(df).fold(0)
    test_ids = [r.id for r in one.test.collect()]
    other = m(df.withColumn("x", F.when(F.col("id").isin(test_ids), F.lit(1e9)).otherwise(F.col("x")))).fold(0)
    assert one.transforms.state() == other.transforms.state()
    assert one.train.count() + one.test.count() == 100
    assert math.isclose(one.train.agg(F.avg("x")).collect()[0][0], 0, abs_tol=1e-9)
    with pytest.raises(ValueError):
        TabularDataModule(df.limit(3), s, TransformPipeline.drop_typed(), "id").prepare_kfold(5, 7)
