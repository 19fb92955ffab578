"""Training over partitions: many problems at once, rows put to rest, validation and estimators beyond one task, linear searches."""

import numpy as np
import pyarrow as pa
import pytest
from hyperplane.functions import kernels as K
from hyperplane.operators import decomposition, estimator, linear, smo, validation
from hyperplane.operators.decomposition import NotConverged, train, train_many
from hyperplane.operators.estimator import KernelSVC, summary
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 4))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] ** 2 - 0.3 + rng.normal(0, 0.4, 400) > 0, 1, -1)
    rows = [(i, a.tolist(), int(b), int(i * 7 % 3), int(np.digitize(a[0], [-0.4, 0.4])), 1.0 + i % 2) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "id long, x array<double>, y int, fold int, label int, w double").repartition(3).cache(), x, y


def test_rows_at_rest_change_nothing(data, monkeypatch):
    """The optimum of the whole problem, gradients of all rows at the end, and fewer kernel values on the way."""
    monkeypatch.setattr(decomposition, "SHRINK_EVERY", 2)
    df, x, y = data
    best = smo.solve(x, y, K.RBF, 2.0, eps=1e-5)
    found = {shrink: train(df, K.RBF, 2.0, working=40, shrink=shrink) for shrink in (True, False)}
    for f in found.values():
        assert f.gap < smo.EPS and f.objective == pytest.approx(best.objective, rel=1e-5) and f.rho == pytest.approx(best.rho, abs=5e-3)
        t = f.state.orderBy("id").toPandas()
        assert np.allclose(t.g, y * (K.RBF.block(x, x) @ (t.alpha * y)) - 1, atol=1e-9) and abs(t.alpha @ y) < 1e-9
    assert found[True].rested > 50 and found[False].rested == 0
    assert found[True].cells < 0.85 * found[False].cells


@pytest.mark.parametrize("bytes_", [64 << 20, 40_000])
def test_many_problems(data, monkeypatch, bytes_):
    """Kernels, C and held-out rows of their own, each as if trained alone; also where problems have to take turns."""
    monkeypatch.setattr(decomposition, "BROADCAST_BYTES", bytes_)
    df, x, y = data
    fold = np.arange(400) * 7 % 3
    problems = [(K.Kernel("rbf", g), c, t) for g, c in ((0.1, 0.5), (0.5, 8.0)) for t in range(3)]
    sides = F.array(*[F.when(F.col("fold") == t, 0).otherwise(F.col("y")) for _, _, t in problems])
    found = train_many(df.withColumn("y", sides), [k for k, _, _ in problems], [c for _, c, _ in problems], working=150)
    t = found.state.orderBy("id").toPandas()
    f, alpha = np.array(t.f.tolist()), np.array(t.alpha.tolist())
    for p, (kernel, c, test) in enumerate(problems):
        mine = fold != test
        want = smo.solve(x[mine], y[mine], kernel, c)
        assert found.objective[p] == pytest.approx(want.objective, rel=1e-4) and found.gap[p] < smo.EPS
        assert (alpha[~mine, p] == 0).all() and (alpha[:, p] <= c).all()
        assert np.allclose(f[:, p] - found.rho[p], smo.decide(x, x[mine], want.alpha * y[mine], kernel, want.rho), atol=0.01)


@pytest.mark.parametrize("pairs", ["first", "random", "platt"])
def test_pairing_rules(data, pairs):
    df, x, y = data
    best = smo.solve(x, y, K.RBF, 1.0, eps=1e-5)
    found = train(df, K.RBF, 1.0, working=200, pairs=pairs)
    assert found.gap < smo.EPS and found.objective == pytest.approx(best.objective, abs=1e-2)


def test_weights_and_edges(spark, data):
    df, x, y = data
    best = smo.solve(x, y, K.LINEAR, 0.5, eps=1e-5, weights=1.0 + np.arange(400) % 2)
    assert train(df.withColumnRenamed("w", "weight"), K.LINEAR, 0.5, working=100).objective == pytest.approx(best.objective, rel=1e-3)
    assert train(df.where("y = 1"), K.RBF, 1.0).rounds == 0
    none = train(df.limit(0), K.RBF, 1.0)
    assert none.objective == 0 and none.state.count() == 0
    with pytest.raises(NotConverged):
        train(df, K.RBF, 2.0, working=32, max_rounds=2)


def test_validation_beyond_one_task(spark, data, monkeypatch):
    """Both sides of the switch count the same, up to rows on the edge; the plan has no group that holds the table."""
    df, _, _ = data
    parameters = validation.grid(spark, [0.5, 4.0], [0.1, 0.5])
    near = {(r.c, r.gamma): (r.correct, r.n) for r in validation.cross_validate(df, parameters, "rbf", 3).collect()}
    monkeypatch.setattr(estimator, "ONE_TASK_ROWS", 10)
    far = validation.cross_validate(df, parameters, "rbf", 3)
    assert "FlatMapGroups" not in far._jdf.queryExecution().executedPlan().toString()
    got = {(r.c, r.gamma): (r.correct, r.n) for r in far.collect()}
    assert got.keys() == near.keys() and all(abs(got[k][0] - near[k][0]) <= 1 and got[k][1] == near[k][1] == 400 for k in near)


def test_estimator_beyond_one_task(spark, data, monkeypatch):
    df, _, _ = data
    rows = df.select("id", "x", "label")
    near = KernelSVC(K.RBF, 1.0, class_weights={0: 2.0}).fit(rows)
    want = {r.id: r.pred for r in near.predict(rows).collect()}
    monkeypatch.setattr(estimator, "ONE_TASK_ROWS", 10)
    far = KernelSVC(K.RBF, 1.0, class_weights={0: 2.0}).fit(rows)
    got = {r.id: r.pred for r in far.predict(rows).collect()}
    assert sum(got[i] != want[i] for i in want) <= 2 and far.model.columns == near.model.columns
    a, b = ({r.problem: r.objective for r in summary(m.model).collect()} for m in (near, far))
    assert all(a[k] == pytest.approx(b[k], rel=1e-3) for k in (0, 1, 2))
    single = KernelSVC(K.RBF, 1.0)
    single.model = estimator.train_apart(rows.where("label = 1"), [1], K.RBF, 1.0)
    assert single.model.first().sv_id is None


@pytest.mark.parametrize("sparse", [False, True])
def test_linear_search_in_shared_passes(spark, data, sparse):
    """Every (C, fold) column as a fit of its own gives."""
    df, x, y = data
    fold = np.arange(400) * 7 % 3
    rows = df.withColumn("x", F.transform("x", lambda v, i: F.struct((i + 1).alias("idx"), v.alias("val")))) if sparse else df
    for c, correct, n in linear.cross_validated(rows, 4, [2.0**-5, 1.0, 2.0**15], 3):
        right = 0
        for t in range(3):
            mine = fold != t
            w = np.zeros(4)
            for _ in range(100):  # plain Newton steps
                active = y[mine] * (x[mine] @ w) < 1
                z = x[mine][active]
                w = np.linalg.solve(np.eye(4) + 2 * c * z.T @ z, 2 * c * z.T @ y[mine][active])
            right += int(((x[~mine] @ w > 0) == (y[~mine] > 0)).sum())
        assert n == 400 and abs(correct - right) <= 1


def test_linear_passes_form_no_kernel_values(spark, data, monkeypatch):
    """Decision values under the linear kernel move by the weighted sum of the rows that moved."""
    df, x, y = data
    best = smo.solve(x, y, K.LINEAR, 0.5, eps=1e-5)
    problems = decomposition._Problems([K.LINEAR], [0.5], "second", 1e-3)
    step = np.random.default_rng(1).normal(size=30)
    change = decomposition._Change(np.arange(30), x[:30], np.arange(30), np.zeros(30, np.int64), np.full(30, 0.5), step)
    names = ["id", "x", "alpha", "f"]
    batch = pa.RecordBatch.from_pydict({"id": np.arange(len(x)), "x": pa.array(list(x)), "alpha": pa.array([[0.0]] * len(x)), "f": pa.array([[1.0]] * len(x))})
    with monkeypatch.context() as m:
        m.setattr(K.Kernel, "block", lambda *a: pytest.fail("kernel values were formed"))
        (out,) = problems.moved(change, names)(iter([batch]))
    np.testing.assert_allclose(out.column("f").flatten().to_numpy(), 1 + x @ (x[:30].T @ step))
    assert (out.column("alpha").flatten().to_numpy() == np.where(np.arange(len(x)) < 30, 0.5, 0)).all()
    assert train(df, K.LINEAR, 0.5, working=100).objective == pytest.approx(best.objective, rel=1e-3)


def test_passes_stay_in_tiles(data, monkeypatch):
    """Blocks of kernel values are no larger than a core's cache holds, and order of the entries does not matter."""
    _, x, _ = data
    problems = decomposition._Problems([K.RBF, K.RBF], [1.0, 1.0], "second", 1e-3)
    rng = np.random.default_rng(2)
    at, p, step = rng.integers(0, len(x), 900), rng.integers(0, 2, 900), rng.normal(size=900)
    change = decomposition._Change(np.arange(len(x)), x, at, p, np.zeros(900), step)
    batch = pa.RecordBatch.from_pydict({"id": np.arange(len(x)), "x": pa.array(list(x)), "alpha": pa.array([[0.0, 0.0]] * len(x)), "f": pa.array([[0.0, 0.0]] * len(x))})
    want = np.zeros((len(x), 2))
    np.add.at(want, (at, p), step)
    want, sizes = K.RBF.block(x, x) @ want, []
    monkeypatch.setattr(decomposition, "TILE", (64, 128))
    monkeypatch.setattr(K.Kernel, "block", lambda self, a, b, squares=None, was=K.Kernel.block: sizes.append((len(a), len(b))) or was(self, a, b, squares))
    (out,) = problems.moved(change, ["id", "f"], alphas=False)(iter([batch]))
    np.testing.assert_allclose(np.array(out.column("f").to_pylist()), want, atol=1e-9)
    assert max(sizes) == (64, 128)
