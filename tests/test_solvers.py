"""Solvers by what their optimum must meet, estimators, folds, grids, and block joins."""

import numpy as np
import pytest
from hyperplane.functions import kernels as K
from hyperplane.operators import gram, linear, smo, validation
from hyperplane.operators import solver_steps as S
from hyperplane.operators.estimator import KernelSVC, summary, train_problems
from pyspark.sql import functions as F


def toy(n=80, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] ** 2 - 0.3 + rng.normal(0, 0.2, n) > 0, 1, -1)
    return x, y


@pytest.mark.parametrize("kernel", [K.LINEAR, K.RBF, K.Kernel("poly", 0.5, 2, 1)])
@pytest.mark.parametrize("pairs", ["second", "first", "random"])
def test_smo_optimum(kernel, pairs):
    x, y = toy()
    s = smo.solve(x, y, kernel, 2.0, pairs, seed=3)
    assert s.gap < smo.EPS and (s.alpha >= 0).all() and (s.alpha <= 2).all() and abs(s.alpha @ y) < 1e-9
    q = kernel.block(x, x) * np.outer(y, y)
    assert np.allclose(s.gradient, q @ s.alpha - 1, atol=1e-8)
    assert s.objective == pytest.approx(smo.solve(x, y, kernel, 2.0, "second", "last").objective, abs=1e-2)
    f = smo.decide(x, x, s.alpha * y, kernel, s.rho)
    primal = s.alpha @ q @ s.alpha / 2 + 2 * np.maximum(0, 1 - y * f).sum()
    assert -1e-9 <= primal + s.objective < 0.02 * primal


def test_smo_edges(monkeypatch):
    two = smo.solve(np.array([[1.0], [-1.0]]), np.array([1, -1]), K.LINEAR, 1000)
    assert np.allclose(two.alpha, 0.5) and two.rho == pytest.approx(0) and two.objective == pytest.approx(-0.5)
    one = smo.solve(np.ones((3, 2)), np.ones(3), K.RBF, 1)
    assert (one.alpha == 0).all() and np.isfinite(one.rho)
    assert smo.solve(np.zeros((0, 2)), np.zeros(0), K.RBF, 1).iterations == 0
    x, y = toy(40)
    whole = smo.solve(x, y, K.RBF, 1)
    monkeypatch.setattr(smo, "WHOLE", 5)
    monkeypatch.setattr(smo, "CACHED_BYTES", 0)
    assert np.allclose(whole.alpha, smo.solve(x, y, K.RBF, 1).alpha)


@pytest.fixture(scope="module")
def problem(spark):
    x, y = toy(120)
    return spark.createDataFrame([(i, a.tolist(), int(b), (i * 7 % 11) / 10) for i, (a, b) in enumerate(zip(x, y))], "id long, x array<double>, y int, alpha double").cache()


@pytest.mark.parametrize("fit", [linear.fit_squared_hinge, linear.fit_barzilai_borwein])
def test_linear(problem, fit):
    m = fit(problem, 3, 0.7)
    assert m.gradient_norm < 1e-2 and -1e-6 <= m.duality_gap < 1e-2 * m.objective
    x, y = toy(120)
    slack = np.maximum(0, 1 - y * (x @ m.w))
    assert m.objective == pytest.approx(m.w @ m.w / 2 + 0.7 * (slack**2).sum())


def test_blocks_agree_with_broadcast(problem, monkeypatch):
    """The grid of cells gives what the broadcast gives."""
    results = lambda: {r.id: (round(r.row_sum, 9), round(r.largest, 9)) for r in gram.row_sums(problem, K.RBF).collect()}
    want = results()
    near = lambda: sorted((r.id, r.rank, r.other) for r in gram.most_similar(problem, K.RBF, 3).collect())
    nearest = near()
    monkeypatch.setattr(gram, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(gram, "BLOCK_ROWS", 20)
    assert gram._lines(120, 120) == (3, 3)
    assert results() == want and near() == nearest
    plan = gram.row_sums(problem, K.RBF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Cartesian", "NestedLoop", "RoundRobin", "SinglePartition")) and "CoGroup" in plan


def test_cells_of_unequal_sides(spark, problem, monkeypatch):
    """Few rows against many, none on one side, and cells that meet nothing."""
    few = problem.where("id < 7")
    want = {r.id: r.s for r in gram.against(few, problem, K.RBF, ["y"], {"s": ("sum", lambda k, a, b: k @ b["y"])}).collect()}
    monkeypatch.setattr(gram, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(gram, "BLOCK_ROWS", 10)
    got = {r.id: r.s for r in gram.against(few, problem, K.RBF, ["y"], {"s": ("sum", lambda k, a, b: k @ b["y"])}).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)
    assert gram.against(problem.limit(0), problem, K.RBF, [], {"s": ("max", lambda k, a, b: k.max(1))}).count() == 0


def test_rows_moved_grow_by_less_than_pairs():
    """Copies of rows that the grid sends: the power of 1.5 until cells are full, from where on a task's memory sets their number."""
    moved = {n: n * sum(gram._lines(n, n)) for n in (10**5, 10**6, 10**7)}
    assert moved[10**6] / moved[10**5] < 10**1.55 and moved[10**7] / moved[10**6] < 10**1.55
    lines, columns = gram._lines(10**9, 10**5)
    assert 10**9 / lines <= gram.CELL_ROWS and columns == 49


def test_state_steps(problem):
    state = S.dual_gradient(problem, K.RBF).cache()
    x, y = toy(120)
    a = np.array([(i * 7 % 11) / 10 for i in range(120)])
    g = y * (K.RBF.block(x, x) @ (a * y)) - 1
    assert np.allclose([r.g for r in state.orderBy("id").collect()], g)
    pair = S.working_pair(state, 1.0, "first").first()
    up = ((y == 1) & (a < 1)) | ((y == -1) & (a > 0))
    assert pair.i == np.where(up, -y * g, -np.inf).argmax() and pair.m == pytest.approx(np.where(up, -y * g, -np.inf).max())
    one_side = state.where("y = 1").withColumn("alpha", F.lit(0.0))
    assert S.working_pair(one_side, 1.0).first().j is None and S.rho(one_side, 1.0).first().rho is not None


def test_kernel_svc(spark, problem, tmp_path):
    labelled = problem.withColumn("label", F.when(F.col("y") > 0, 7).otherwise(3))
    svc = KernelSVC(K.RBF, 5.0).fit(labelled)
    got = validation.accuracy(svc.predict(labelled).join(labelled.select("id", "label"), "id"), "label").first()
    assert got.accuracy > 0.9
    assert summary(svc.model).first().gap < 1e-3
    svc.save(f"{tmp_path}/m")
    again = KernelSVC(K.RBF, 5.0).load(spark.read.parquet(f"{tmp_path}/m"))
    assert sorted(again.predict(labelled).collect()) == sorted(svc.predict(labelled).collect())
    three = problem.withColumn("label", (F.col("id") % 3).cast("int"))
    assert set(r.pred for r in KernelSVC(K.RBF, 50.0).fit(three).predict(three).collect()) <= {0, 1, 2}
    single = train_problems(problem.where("y = 1").withColumn("problem", F.lit(0).cast("long")), K.RBF, 1.0)
    assert single.first().sv_id is None


def test_folds_and_grid(spark, problem):
    folds = validation.stratified_folds(problem, 5)
    n = {(r.y, r.fold): r["count"] for r in folds.groupBy("y", "fold").count().collect()}
    assert len(n) == 10 and all(max(v for (y, _), v in n.items() if y == s) - min(v for (y, _), v in n.items() if y == s) <= 1 for s in (1, -1))
    assert validation.power_range(-1, 3, 2.0, 2) == [0.5, 2.0, 8.0] and len(validation.power_range(*validation.GRID_C)) == 11
    found = validation.cross_validate(folds, validation.grid(spark, [0.5, 4.0], [0.1, 1.0]), "rbf", 5)
    assert found.count() == 4 and all(r.n == 120 for r in found.collect()) and validation.best(found).first().accuracy > 0.75


def test_searches_cover_the_grid(spark, monkeypatch):
    """Both searches try every C, and the RBF one every gamma, of the reference's grid."""
    from hyperplane.plans import catalogue

    tried = {}

    def note(df, parameters, kernel, k):
        tried[kernel] = sorted((r.c, r.gamma) for r in parameters.collect())
        return spark.createDataFrame([(1.0, 1.0, 1, 1, 1.0)], "c double, gamma double, correct long, n long, accuracy double")

    monkeypatch.setattr(validation, "cross_validate", note)
    monkeypatch.setattr(validation, "cross_validate_linear", lambda df, c, k, dim: note(df, validation.grid(spark, c, [1.0]), "linear", k))
    for name in ("grid_rbf", "grid_linear"):
        catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    every_c, every_gamma = validation.power_range(*validation.GRID_C), validation.power_range(*validation.GRID_GAMMA)
    assert tried["rbf"] == sorted((c, g) for c in every_c for g in every_gamma) and [c for c, _ in tried["linear"]] == every_c
