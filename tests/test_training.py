"""Whole-table training: gradients by differences, the same fit for any partitioning, boosting level by level, and staged bridges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabweave.functions.rand import hashed_normals, normal
from tabweave.operators import boosting, stages, training
from tabweave.operators.fields import MLP, TreeField
from tabweave.operators.process import FullLightPotential
from tabweave.operators.solvers import ImfSolver, IpfSolver, LightObjective, LightSolver, lower_factors


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(3000).select("id", (10 + 3 * normal("x", F.col("id"))).alias("x"), normal("w", F.col("id")).alias("w"))
    df = df.withColumn("y", F.sin("x") * 50 + F.col("w")).withColumn("v", -2 * F.col("w"))
    return df.withColumn("x", F.when(F.col("id") == 17, F.lit(None)).otherwise(F.col("x"))).cache()


def test_sums_in_whole_numbers_have_no_order():
    v = np.random.default_rng(1).normal(size=(500, 7)) * 10.0 ** np.arange(-6, 8, 2)
    a = sum(training.to_whole(r) for r in v)
    b = sum(training.to_whole(r) for r in v[::-1])
    assert (a == b).all() and training.from_whole(a) == pytest.approx(v.sum(0), rel=1e-9, abs=1e-12)
    with pytest.raises(FloatingPointError):
        training.to_whole(np.array([np.nan]))
    with pytest.raises(OverflowError):
        training.to_whole(np.array([1e20]))


def test_training_table_holds_every_row_once(spark, table):
    cols = ["x", "y"]
    stored = training.TrainingTable.build(table, "id", cols, batches=5, least=100, block_rows=64)
    rows = np.concatenate([np.frombuffer(bytes(r.x)).reshape(-1, 2) for r in stored.blocks.collect()])
    real = np.array([[r.x, r.y] for r in table.dropna().select(*cols).collect()])
    assert stored.rows == 2999 and stored.batches == 5
    assert (np.sort(rows, 0) == np.sort(real, 0)).all()
    mean, std = stored.scale()
    assert mean == pytest.approx(real.mean(0), abs=1e-9) and std == pytest.approx(real.std(0), abs=1e-9)
    again = training.TrainingTable.build(table.repartition(7), "id", cols, batches=5, least=100, block_rows=64)
    assert [m.tolist() for m in again.scale()] == [m.tolist() for m in (mean, std)]
    empty = training.TrainingTable.build(table.filter("false"), "id", cols)
    assert empty.rows == 0 and empty.sums(lambda x, rng: [x.sum(0)]) == []
    same = table.limit(1).withColumn("many", F.explode(F.sequence(F.lit(1), F.lit(1000)))).drop("many")
    many = training.TrainingTable.build(same, "id", cols, block_rows=16)  # one row a thousand times: blocks stay bounded
    assert many.rows == 1000 and max(r.n for r in many.blocks.collect()) <= 64
    stored.drop()


def test_network_over_all_rows_is_the_same_for_any_partitioning(spark, table):
    fit = lambda df: training.WholeMLP((16,), epochs=4, batches=10, rate=3e-2).fit(df, "id", ["x", "w"], ["v"])
    a, b = fit(table), fit(table.repartition(6))
    assert all((p == q).all() for p, q in zip(a.net.params(), b.net.params()))
    assert a.losses[-1] < 0.3 * a.losses[0]
    x = np.array([[10.0, 1.0], [10.0, -1.0]])
    assert a.predict(x)[0, 0] < a.predict(x)[1, 0]


def test_rare_value_is_seen(spark):
    """One row in 20,000 moves the fit: no sample would hold it."""
    df = spark.range(20_000).select("id", F.when(F.col("id") == 777, 1000.0).otherwise(0.0).alias("x"), F.when(F.col("id") == 777, 5000.0).otherwise(0.0).alias("y0"))
    model = stages.fit_groups(df.select(F.lit(0).alias("g"), F.col("id").cast("string").alias("id"), F.col("x").alias("x0"), "y0"), [0], "trees", {"trees": 40, "depth": 2, "least": 1, "bins": 8})
    stored = training.TrainingTable.build(df, "id", ["x", "y0"])
    assert stored.scale()[0] == pytest.approx([0.05, 0.25]) and boosting.order_statistics(stored, 1, np.array([0, 19_999])).tolist() == [[0.0, 1000.0]]
    assert model[0].base == pytest.approx([0.25], abs=1e-5)


@pytest.mark.parametrize("full", [False, True])
def test_light_gradients(full):
    rng = np.random.default_rng(2)
    x, x0 = rng.normal(size=(40, 3)), rng.normal(size=(40, 3))
    params = [rng.normal(size=4), rng.normal(size=(4, 3)), rng.normal(size=(4, 3, 3)) * 0.3 if full else rng.normal(size=(4, 3)) * 0.3]
    own = LightObjective(0.4)
    loss = lambda p: (own.full if full else own.diagonal)(p, x0, x)[0]
    grads = (own.full if full else own.diagonal)(params, x0, x)[1]
    for i, p in enumerate(params):
        for at in np.ndindex(p.shape):
            up, down = [q.copy() for q in params], [q.copy() for q in params]
            up[i][at] += 1e-5
            down[i][at] -= 1e-5
            assert grads[i][at] == pytest.approx((loss(up) - loss(down)) / 2e-5, rel=2e-4, abs=2e-4)


def test_full_covariance_keeps_a_correlation(spark):
    df = spark.range(4000).withColumn("x", normal("fx", F.col("id"))).withColumn("y", 0.9 * F.col("x") + 0.43 * normal("fy", F.col("id")))
    model = LightSolver(["x", "y"], components=2, covariance="full", eps=0.5).fit(df, "id")
    for solver in (model, LightSolver(["x", "y"], covariance="full", eps=0.5, state=model.state, sde_steps=40)):
        z = solver.generate(np.arange(3000), 1)
        assert np.corrcoef(z.T)[0, 1] > 0.8 and np.abs(z.std(0) - 1).max() < 0.25 and np.abs(z.mean(0)).max() < 0.2
    low = lower_factors(model.state[2])
    s = low @ np.swapaxes(low, 1, 2)
    potential = FullLightPotential(tuple(model.state[0]), tuple(map(tuple, model.state[1])), tuple(tuple(map(tuple, m)) for m in s), 0.5)
    got = df.limit(5).select("x", "y", potential.log_c([F.col("x"), F.col("y")]).alias("c"), potential.log_v([F.col("x"), F.col("y")]).alias("v")).collect()
    for r in got:
        x = np.array([r.x, r.y])
        c = [a + (x @ m @ x + 2 * q @ x) / (2 * 0.5) for a, q, m in zip(model.state[0], model.state[1], s)]
        v = [a - 0.5 * (x - q) @ np.linalg.inv(0.5 * m) @ (x - q) - 0.5 * np.linalg.slogdet(2 * np.pi * 0.5 * m)[1] for a, q, m in zip(model.state[0], model.state[1], s)]
        assert r.c == pytest.approx(np.logaddexp.reduce(c), rel=1e-9) and r.v == pytest.approx(np.logaddexp.reduce(v), rel=1e-9)


# boosting


def strip(tree):
    return "leaf" if not isinstance(tree, list) else (tree[0], tree[1], strip(tree[2]), strip(tree[3]))


def test_order_statistics(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([-0.0, 0.0, 3.5, -7.25, 1e-300, -1e300, 2.0, 2.0, 2.0, 1e300])], "id int, x double")
    stored = training.TrainingTable.build(df, "id", ["x"])
    assert boosting.order_statistics(stored, 1, np.arange(10))[0].tolist() == sorted([0.0, 0.0, 3.5, -7.25, 1e-300, -1e300, 2.0, 2.0, 2.0, 1e300])


def test_boosting_over_the_cluster_grows_the_trees_of_one_task(spark, table):
    xs, ys = ["x", "w"], ["y", "v"]
    m = np.array([list(r) for r in table.dropna().select(*xs, *ys).collect()])
    plain = TreeField(trees=4, depth=3).fit(m[:, :2], m[:, 2:])
    here = boosting.WholeTrees(trees=4, depth=3).fit(table, "id", xs, ys)
    jobs = boosting.WholeTrees(trees=4, depth=3, memory=0, settle=2).fit(table.repartition(5), "id", xs, ys)
    rows = boosting.WholeTrees(trees=4, depth=3).fit_rows(m[:, :2], m[:, 2:])
    assert all((a == b).all() for a, b in zip(here.cuts, plain.cuts))
    assert here.model == jobs.model == rows.model and jobs.jobs == 4 * 4 and here.jobs == 0
    assert [[strip(t) for t in own] for own in here.model] == [[strip(t) for t in own] for own in plain.model]
    assert here.predict(m[:, :2]) == pytest.approx(plain.predict(m[:, :2]), abs=1e-3)
    assert boosting.WholeTrees().fit(table.filter("false"), "id", xs, ys).predict(np.zeros((2, 2))).tolist() == [[0, 0], [0, 0]]
    with pytest.raises(ValueError):
        boosting.WholeTrees(bins=300).fit(table, "id", xs, ys)


# staged bridges


def test_groups_of_every_kind(spark):
    df = spark.range(3000).select((F.col("id") % 3).cast("int").alias("g"), F.col("id").cast("string").alias("id"), normal("gx", F.col("id")).alias("x0"))
    df = df.withColumn("y0", F.col("x0") * (F.col("g") + 1) + F.col("g")).withColumn("y1", -F.col("x0"))
    at = np.array([[-1.0], [0.5]])
    for kind, params, near in (("linear", {}, 1e-6), ("ridge", {"features": 8}, 0.1), ("trees", {"trees": 60}, 0.4), ("mlp", {"epochs": 4, "batches": 5, "hidden": (16,)}, 0.5)):
        for memory in (stages.MEMORY, 0) if kind == "trees" else (stages.MEMORY,):
            fields = stages.fit_groups(df, [0, 1, 2], kind, params if memory else {"trees": 5, "depth": 2, "memory": 0}, memory)
            if memory:
                for g, own in fields.items():
                    assert own.predict(at) == pytest.approx(np.stack([at[:, 0] * (g + 1) + g, -at[:, 0]], 1), abs=near), kind
    with pytest.raises(ValueError):
        stages.fit_groups(df, [0], "none", {})


def test_imf_is_the_same_for_any_partitioning(spark, table):
    fit = lambda df: ImfSolver(["x", "w"], params={"trees": 3}, steps=4).fit(df, "id").generate(np.arange(50), 2)
    assert (fit(table) == fit(table.repartition(9))).all()
    with pytest.raises(ValueError):
        ImfSolver(["x"], "linear", "continuous")


def test_hashed_normals():
    z = hashed_normals(np.arange(20_000), 3, 1, (4, 2))
    assert z.shape == (20_000, 4, 2) and abs(z.mean()) < 0.02 and abs(z.std() - 1) < 0.02
    assert np.abs(np.corrcoef(z.reshape(-1, 8).T) - np.eye(8)).max() < 0.05
    assert (hashed_normals(np.array([7]), 3, 1, (4, 2))[0] == z[7]).all() and (hashed_normals(np.array([7]), 3, 2, (4, 2))[0] != z[7]).any()


def test_trees_of_cells_are_the_trees_of_their_rows():
    rng = np.random.default_rng(4)
    x, y = np.round(rng.normal(size=(4000, 2)), 1), rng.normal(size=(4000, 2))
    y[:, 0] += np.sin(3 * x[:, 0])
    rows = boosting.WholeTrees(trees=5, depth=3).fit_rows(x, y)
    cells, place = np.unique(rows._codes(x), axis=0, return_inverse=True)
    res = np.rint((y - rows.base) / rows.unit * boosting.STEPS).astype(np.int64)
    sums = np.stack([np.bincount(place.ravel(), weights=r).astype(np.int64) for r in res.T], 1)
    own = boosting.WholeTrees(trees=5, depth=3, cuts=rows.cuts, base=rows.base, unit=rows.unit)
    own.fit_cells(cells.astype(np.uint8), np.bincount(place.ravel()), sums)
    assert len(cells) < 3000 and own.model == rows.model
    plain = own.predict(x)
    own.tabulate()
    assert (own.predict(x) == plain).all() and (plain == rows.predict(x)).all()


def test_grid_of_cuts():
    from tabweave.operators import bridge_fits as B

    x = np.concatenate([s * np.random.default_rng(5).lognormal(0, 2, 2000) for s in (-1, 1)] + [np.array([0.0, 1.0, -1.0, 2.0**-20, 1e-30, 4095.9])])
    place = B.on_grid(x)
    low = B.grid_value(place)
    assert (low <= x).all() and (np.diff(place[np.argsort(x)]) >= 0).all()
    away = (np.abs(x) > 2.0**-19) & (np.abs(x) < 4000)
    assert (np.abs(x - low)[away] <= np.abs(x[away]) / 128).all() and B.on_grid(np.array([1e9, -1e9])).tolist() == [B.GRID - 1, 0]


@pytest.mark.parametrize("make", [
    lambda: ImfSolver(["x", "w"], "mlp", "discrete", steps=3, params={"epochs": 1, "hidden": (8,)}),
    lambda: ImfSolver(["x", "w"], "trees", "discrete", "featurewise", steps=3, tuples_per_row=2, params={"trees": 3}),
    lambda: IpfSolver(["x", "w"], "mlp", "continuous", params={"epochs": 1, "hidden": (8,)}),
    lambda: IpfSolver(["x", "w"], "trees", "continuous", params={"trees": 3}),
])
def test_bridges_store_no_training_rows(spark, table, monkeypatch, make):
    """What is stored is the rows and, beside them, the walked side of the coupling: no row at each step."""
    import tabweave.operators.solvers as S
    import tabweave.operators.training as T

    counts, write = [], S.stored
    monkeypatch.setattr(S, "stored", lambda df, name: counts.append(df.count()) or write(df, name))
    build = T.TrainingTable.build.__func__
    monkeypatch.setattr(T.TrainingTable, "build", classmethod(lambda cls, df, *a, **k: counts.append(df.count()) or build(cls, df, *a, **k)))
    df = table.select("id", "x", "w")
    a = make().fit(df, "id").generate(np.arange(40), 2)
    assert counts and max(counts) <= df.count()
    b = make().fit(df.repartition(7), "id").generate(np.arange(40), 2)
    assert (a == b).all() and np.isfinite(a).all()


def test_networks_take_their_steps_side_by_side():
    """A block's moves are those of its own steps of `small` rows, one network after the other, whatever blocks are beside it."""
    rng = np.random.default_rng(6)
    sizes, blocks = (50, 3, 0, 131), []
    for n in sizes:
        blocks.append(np.column_stack([rng.integers(0, 2, n).astype(float), rng.normal(size=(n, 5))]))
    params = [w for g in range(2) for w in MLP([3, 8, 8, 2], g).params()]
    own = stages.LocalSteps(2, 3, rng.normal(size=(2, 5)), 1 + rng.uniform(size=(2, 5)), np.array([0.4, 0.6]), 0.1)
    some = [(x, np.random.default_rng(i)) for i, x in enumerate(blocks)]
    beside = own.many(params, some)
    for i, x in enumerate(blocks):
        loss, moved = own(params, x, np.random.default_rng(i))
        assert loss == beside[i][0] and all((a == b).all() for a, b in zip(moved, beside[i][1]))
        draw, total = np.random.default_rng(i), 0.0
        for g in np.unique(x[:, 0]).astype(int):
            z = (x[x[:, 0] == g, 1:] - own.mean[g]) / own.std[g]
            z, w = z[draw.permutation(len(z))], [p.copy() for p in params[6 * g : 6 * g + 6]]
            for lo in range(0, len(z), own.small):
                net, part = MLP.of(w), z[lo : lo + own.small]
                out, kept = net.forward(part[:, :3])
                off = out - part[:, 3:]
                total += (off * off).mean(1).sum()
                grads = net.backward(kept, 2 * off / off.size)
                for p, d in zip(w, grads):
                    p -= own.rate * min(1.0, 1 / np.sqrt(sum((e * e).sum() for e in grads))) * d
            for k, p in enumerate(w):
                assert moved[6 * g + k] == pytest.approx((params[6 * g + k] - p) * len(z) / own.share[g], abs=1e-9)
        assert loss == pytest.approx(total)


def test_tables_of_cells_and_their_sums():
    """A table of all cells takes no walk down any tree, and sums of cells read them once for many rows."""
    from tabweave.operators import bridge_fits as B

    rng = np.random.default_rng(7)
    x = np.column_stack([rng.normal(size=2000), rng.integers(0, 4, 2000), rng.normal(size=2000)])
    own = boosting.WholeTrees(trees=6, depth=4).fit_rows(x, np.column_stack([np.sin(2 * x[:, 0]) * x[:, 1], x[:, 2]]))
    at = np.concatenate([x, rng.normal(size=(500, 3)) * 5])
    walked, walk = own.predict(at), own._value
    own._value = lambda *a: pytest.fail("walked")
    own.tabulate()
    assert own.answers.shape == (own.cells(), 2) and (own.predict(at) == walked).all()
    own._value = walk
    cells = B._Cells(1000, 2)
    parts = [(rng.integers(0, 1000, n), rng.integers(-(2**30), 2**30, (n, 2)).astype(float)) for n in (10, 700, 400, 3, 0)]
    seen = []
    for place, res in parts:
        cells.add(place, res)
        seen.append(cells.rows)
    assert seen == [10, 710, 0, 3, 3]
    place, res = np.concatenate([p for p, _ in parts]), np.concatenate([r for _, r in parts])
    for got, weights in zip(cells.all(), (None, *res.T)):
        assert (got == np.bincount(place, weights, 1000)).all()


def test_trees_of_few_cells_take_one_aggregate(spark, table):
    here = boosting.WholeTrees(trees=6, depth=3).fit(table, "id", ["x"], ["y"])
    cells = boosting.WholeTrees(trees=6, depth=3, memory=0).fit(table, "id", ["x"], ["y"])
    rows = table.dropna().select("x", "y").toPandas().to_numpy()
    straight = boosting.WholeTrees(trees=6, depth=3)
    straight.cuts, straight.base, straight.unit = here.cuts, here.base, here.unit
    res = np.rint((rows[:, 1:] - here.base) / here.unit * boosting.STEPS).astype(np.int64)
    assert cells.jobs == 0 and cells.model == here.model == straight._fit_here(straight._codes(rows[:, :1]).astype(np.uint8), res)


def test_local_descent_holds_weights_in_one_array_of_single_precision():
    seen = []
    net = MLP([3, 8, 2], 1)

    def make(x, rng, progress):
        seen.append(len(x))
        return x, (x[:, :2] * 2,)

    def gradient(out, extra):
        assert out.dtype == np.float32 and len(out) == len(extra[0])
        return 2 * (out - extra[0]) / out.size

    x = np.random.default_rng(0).normal(size=(1000, 3))
    before = [p.copy() for p in net.params()]
    out = training.LocalDescent(MLP, net.params(), make, gradient, 1e-2, 64, 0.0)(x, np.random.default_rng(1))
    assert seen == [1000] and [a.shape for a in out[1:]] == [p.shape for p in before]
    assert all((p == q).all() for p, q in zip(before, net.params()))
    error = lambda params: ((MLP.of(params).forward(x)[0] - 2 * x[:, :2]) ** 2).mean()
    assert error([p + m / len(x) for p, m in zip(before, out[1:])]) < 0.8 * error(before)


def test_stored_rows_do_not_carry_their_ids_through_the_shuffle(spark, table, monkeypatch):
    plans = []
    kind = type(table)
    sort = kind.sortWithinPartitions
    monkeypatch.setattr(kind, "sortWithinPartitions", lambda df, *cols: plans.append(df.columns) or sort(df, *cols))
    training.TrainingTable.build(table, "id", ["x", "y"]).drop()
    assert plans and "id" not in plans[0]


def test_large_tables_have_larger_blocks_and_steps_for_local_descent(spark, table, monkeypatch):
    stored = training.TrainingTable.build(table, "id", ["x", "y"], batches=1, block_rows=8, most_block_rows=32)  # 2,999 rows are 64 blocks of 32
    rows = np.concatenate([np.frombuffer(bytes(r.x)).reshape(-1, 2) for r in stored.blocks.collect()])
    real = np.array([[r.x, r.y] for r in table.dropna().select("x", "y").collect()])
    assert stored.block_rows == 32 and (np.sort(rows, 0) == np.sort(real, 0)).all()
    assert training.TrainingTable.build(table, "id", ["x", "y"], batches=2, block_rows=8, most_block_rows=32).block_rows == 16
    assert training.TrainingTable.build(table, "id", ["x", "y"], batches=1, block_rows=8).block_rows == 8

    build, seen = training.TrainingTable.build.__func__, []
    large = lambda cls, *a, most_block_rows=0: build(cls, *a, least=1000, block_rows=2048)
    monkeypatch.setattr(training.TrainingTable, "build", classmethod(large))
    kind = training.LocalDescent
    monkeypatch.setattr(training, "LocalDescent", lambda *a: seen.append(a[5]) or kind(*a))
    make = lambda x, rng, progress: (x[:, :1], x[:, 1:])
    gradient = lambda out, y: 2 * (out - y) / out.size
    assert training.descend(table, "id", ["w", "v"], MLP([1, 4, 1]), make, gradient, 20, small=64) == 3000
    assert seen == [128] * 2  # a round of 16 steps over each of two minibatches is more than 20 steps


def test_the_way_back_takes_no_exponentials_and_agrees_with_differences(monkeypatch):
    rng = np.random.default_rng(3)
    net, x, y = MLP([3, 5, 4, 2], 2), rng.normal(size=(9, 3)), rng.normal(size=(9, 2))
    x[0] = 1e4  # sigmoids of 0 and 1
    loss = lambda: float(((net.forward(x)[0] - y) ** 2)[1:].sum())
    out, kept = net.forward(x)
    assert np.isfinite(out).all()
    g = 2 * (out - y)
    g[0] = 0
    with monkeypatch.context() as m:
        m.setattr(np, "exp", None)
        grads = net.backward(kept, g)
    for p, d in zip(net.params(), grads):
        for at in np.ndindex(p.shape):
            was, p[at] = p[at], p[at] + 1e-6
            up, p[at] = loss(), was - 1e-6
            down, p[at] = loss(), was
            assert d[at] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-6)
    again = net.forward(x)[1]
    assert all((a == b).all() for a, b in zip(net.backward(again, g), grads))


def test_stored_rows_are_shuffled_without_what_their_hash_gives_and_keep_their_order(spark, table, monkeypatch):
    kind, seen = type(table), []
    deal = kind.repartition
    monkeypatch.setattr(kind, "repartition", lambda df, *a: seen.append(df.columns) or deal(df, *a))
    stored = training.TrainingTable.build(table, "id", ["x", "y"], batches=5, least=100, block_rows=64)
    assert seen == [["h", "c0", "c1"]]
    h = F.xxhash64(F.col("id").cast("string"), "x", "y")
    rows = sorted((r.h % 47 % 5, r.h % 47, r.h, r.x, r.y) for r in table.dropna(subset=["x", "y"]).select(h.alias("h"), "x", "y").collect())
    got = {(r.batch, r.block): np.frombuffer(bytes(r.x)).reshape(-1, 2).tolist() for r in stored.blocks.collect()}
    assert len(got) == 47 and all(xy == [[x, y] for b, k, _, x, y in rows if (b, k) == key] for key, xy in got.items())


def test_partial_sums_of_many_files_meet_in_groups(spark, table, monkeypatch):
    """Beyond MOST_PARTIALS files partial sums are added in tasks before the driver gets them: the same sums, of all blocks and of a minibatch."""
    stored = training.TrainingTable.build(table, "id", ["x", "y"], batches=5, least=100, block_rows=64)
    found = lambda: [np.concatenate([s.ravel() for s in stored.sums(training._Powers(np.ones(2)), batch=b)]).tolist() for b in (None, 2)]
    few = found()
    monkeypatch.setattr(training, "MOST_PARTIALS", 2)
    stored.files = 3
    assert found() == few
    stored.drop()


def test_bridge_networks_learn_and_answer_in_single_precision(spark, table, monkeypatch):
    """Steps of bridge fits are of single precision, near those of double, whatever blocks are beside; a fitted network answers likewise."""
    rng = np.random.default_rng(8)
    blocks = [(np.column_stack([rng.integers(0, 2, n).astype(float), rng.normal(size=(n, 5))]), n) for n in (50, 3, 0, 131)]
    params = [w for g in range(2) for w in MLP([3, 8, 8, 2], g).params()]
    made = lambda single: stages.LocalSteps(2, 3, np.zeros((2, 5)), np.ones((2, 5)), np.array([0.4, 0.6]), 0.1, 16, single)
    again = lambda: [(x, np.random.default_rng(i)) for x, i in blocks]
    one, two = made(True).many(params, again()), made(False).many(params, again())
    for (x, i), (loss, moved), (wanted, exact) in zip(blocks, one, two):
        alone = made(True)(params, x, np.random.default_rng(i))
        assert loss == alone[0] == pytest.approx(wanted, rel=1e-4) and all((a == b).all() for a, b in zip(moved, alone[1]))
        assert all(a == pytest.approx(b, abs=1e-3) for a, b in zip(moved, exact)) and all(a.dtype == float for a in moved)
    net = stages.GroupNet(MLP([3, 8, 2], 1), np.full(5, 1e6), np.full(5, 2.0), 3)
    x = 1e6 + rng.normal(size=(2500, 3))
    assert net.predict(x) == pytest.approx(net.net.forward((x - 1e6) / 2)[0] * 2 + 1e6, abs=1e-4)
    kinds, forward = set(), stages._forward
    monkeypatch.setattr(stages, "_forward", lambda p, x: kinds.add(x.dtype.name) or forward(p, x))
    from tabweave.operators import bridge_fits

    stored = bridge_fits.blocks_of(table.select(bridge_fits.key_of("id").alias("key"), F.col("w").alias("a0")), ["a0"], 1, 1, 2)
    rows = lambda key, a, w, m: iter([(0, a, 2 * a)])
    work = bridge_fits._OnBlocks(rows, 0, [0], 1, (0,), training.Step(stages.LocalSteps(1, 1, np.zeros((1, 2)), np.ones((1, 2)), np.ones(1), 0.1, 16, True), MLP([1, 4, 1]).params()))
    first = stored.blocks.select("block", "part", "x").first()
    work.many([(first.block, first.part, bytes(first.x))])
    assert kinds == {"float32"}
    fitted = bridge_fits.fit_networks(stored, 1, [(1, 1)], [0], rows, {"epochs": 3, "batches": 2, "hidden": (8,)}, 8.0, 1)
    assert fitted[0, 0].predict(np.array([[-1.0], [1.0]])) == pytest.approx(np.array([[-2.0], [2.0]]), abs=0.8)
    stored.drop()
