"""Solutions for ascending C, each from the one before."""

from __future__ import annotations

import numpy as np
import pytest

from hyperplane.functions.kernels import Kernel
from hyperplane.operators import smo


def noisy(n: int = 600, dim: int = 16, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True), np.where(x[:, 0] + rng.normal(size=n) > 0, 1.0, -1.0)


@pytest.mark.parametrize(("gamma", "apart", "double"), [(0.05, 0, 5500), (0.05, 4000, 5500), (0.5, 4000, 5500), (2.0, 0, 20)])
def test_path_gives_the_solutions_of_each_c(gamma, apart, double, monkeypatch):
    monkeypatch.setattr(smo, "LEAP_AFTER", 200)
    monkeypatch.setattr(smo, "MOST_APART", apart)
    monkeypatch.setattr(smo, "MOST_LEAP", double)
    x, y = noisy()
    kernel, cs = Kernel("rbf", gamma), [0.03125, 0.5, 8.0, 128.0, 2048.0]
    for c, found in zip(cs, smo.path(x, y, kernel, cs), strict=True):
        plain = smo.solve(x, y, kernel, c, eps=1e-4, max_iter=3_000_000)
        assert found.gap < smo.EPS
        assert found.objective == pytest.approx(plain.objective, rel=1e-4)
        assert found.alpha.min() >= 0 and found.alpha.max() <= c and abs(found.alpha @ y) < 1e-6 * c
        k = kernel.block(x, x)
        assert np.abs(y * (k @ (found.alpha * y)) - 1 - found.gradient).max() < 1e-6 * max(1.0, c)


def test_greater_c_takes_no_steps_where_no_row_is_at_it(monkeypatch):
    solved, solve = [], smo.solve
    monkeypatch.setattr(smo, "solve", lambda *a, **k: solved.append(a[3]) or solve(*a, **k))
    x, y = noisy(200)
    found = list(smo.path(x, y, Kernel("rbf", 8.0), [2.0, 8.0, 32.0, 128.0]))
    assert set(solved) == {2.0} and found[3].alpha.max() < 2.0
    np.testing.assert_array_equal(found[0].alpha, found[3].alpha)


def test_a_step_over_all_free_rows_ends_what_single_steps_leave():
    x, y = noisy(1000)
    kernel = Kernel("rbf", 0.5)
    rows = smo.Rows(x, kernel)
    rough = smo.solve(x, y, kernel, 8.0, eps=0.05, rows=rows)
    found = smo.leap(y, 8.0, rough.alpha, rows)
    g = y * (rows.whole @ (found * y)) - 1
    assert smo._gap(y, np.full(1000, 8.0), found, g) < smo.EPS


def test_one_class_and_no_rows():
    x, y = noisy(20)
    assert [s.alpha.sum() for s in smo.path(x, np.ones(20), Kernel("rbf"), [1.0, 2.0])] == [0, 0]
    assert [len(s.alpha) for s in smo.path(x[:0], y[:0], Kernel("rbf"), [1.0, 2.0])] == [0, 0]


@pytest.mark.parametrize(("n", "kind", "off"), [(5, float, 1e-10), (256, float, 1e-9), (700, float, 1e-8), (512, np.float32, 1e-3)])
def test_factor_in_panels(n, kind, off):
    rng = np.random.default_rng(n)
    m = rng.normal(size=(n, n))
    a, b = m @ m.T / n + np.eye(n), rng.normal(size=(n, 2))
    np.testing.assert_allclose(smo.substituted(smo.factor(a.astype(kind)), b.astype(kind)), np.linalg.solve(a, b), atol=off)


def test_start_of_products_sends_out_no_rows(spark, monkeypatch):
    from pyspark.sql import functions as F

    from hyperplane.operators import decomposition as D

    x, y = noisy(900, 5)
    df = spark.createDataFrame([(7 * i, [float(v) for v in r], int(s)) for i, (r, s) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, y int")
    rows = df.select("id", "x", F.array("y", -F.col("y"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("y"))).alias("y"))
    monkeypatch.setattr(D, "START_ROWS", 300)
    sent, of = [], D._Change.of.__func__
    monkeypatch.setattr(D._Change, "of", classmethod(lambda cls, t, vectors=None: sent.append((t.num_rows, vectors)) or of(cls, t, vectors)))
    for kernel in (Kernel("linear"), Kernel("rbf")):
        sent.clear()
        found = D.train_many(rows, [kernel] * 3, [1.0, 0.5, 2.0])
        # Only the start gives vectors apart, once for all problems.
        assert [v.num_rows for _, v in sent if v is not None] == ([] if kernel.name == "linear" else [900])
        for p, (c, use) in enumerate([(1.0, slice(None)), (0.5, slice(None)), (2.0, slice(1, None, 2))]):
            sign = -1 if p == 1 else 1
            assert found.objective[p] == pytest.approx(smo.solve(x[use], sign * y[use], kernel, c).objective, rel=1e-3)
        got = found.state.orderBy("id").toPandas()
        alpha, sides, f = (np.array(got[k].tolist(), float) for k in ("alpha", "y", "f"))
        np.testing.assert_allclose(f, kernel.block(x, x) @ (alpha * sides), atol=1e-8)


def test_a_model_is_trained_once(spark):
    from hyperplane.operators.estimator import KernelSVC

    x, y = noisy(60, 4)
    df = spark.createDataFrame([(i, [float(v) for v in r], int(s)) for i, (r, s) in enumerate(zip(x, y, strict=True))], "id long, x array<double>, label int")
    fits = spark.sparkContext.accumulator(0)

    def counted(*a, **k):
        fits.add(1)
        return smo.solve(*a, **k)

    model = KernelSVC(Kernel("rbf"), 1.0, solver=counted).fit(df)
    assert model.predict(df).count() == 60 and model.model.count() > 0
    assert fits.value == 1
