"""Dual coordinate descent over partitions: its certificate, the box, weights, and the optimum of other solvers."""

import numpy as np
import pytest
from hyperplane.operators import linear
from hyperplane.operators.decomposition import NotConverged
from hyperplane.operators.dual_coordinate import fit_dual
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 6)) * (rng.random((300, 6)) < 0.6)
    x[7] = 0
    y = np.where(x[:, 0] - x[:, 1] + rng.normal(0, 0.5, 300) > 0, 1, -1)
    rows = [(i, a.tolist(), int(b), 2.0 if b > 0 else 0.5 if i % 5 else 0.0) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, y int, w double").repartition(3).cache()
    return df, x, y, np.array([r[3] for r in rows])


def sparse(df):
    pairs = F.transform("x", lambda v, i: F.struct((i + 1).alias("idx"), v.alias("val")))
    return df.withColumn("x", F.filter(pairs, lambda e: e["val"] != 0))


@pytest.mark.parametrize(("loss", "weighted"), [("l2", False), ("l1", True)])
def test_optimum(data, loss, weighted):
    df, x, y, weight = data
    rows = df.withColumnRenamed("w", "weight") if weighted else df
    r = weight if weighted else np.ones(300)
    m = fit_dual(rows, 6, 0.1, loss)
    t = m.alphas.orderBy("id").toPandas()
    a = t.alpha.to_numpy()
    assert len(a) == 300 and (a >= 0).all() and (loss == "l2" or (a <= 0.1 * r + 1e-12).all()) and (a[r == 0] == 0).all()
    assert np.allclose(m.w, (a * y) @ x, atol=1e-9)
    slack = np.maximum(0, 1 - y * (x @ m.w))
    assert m.objective == pytest.approx(m.w @ m.w / 2 + 0.1 * (r * slack ** (1 if loss == "l1" else 2)).sum())
    assert -1e-9 <= m.gap <= 1e-3 * m.objective
    other = linear.fit_squared_hinge(rows, 6, 0.1) if loss == "l2" else linear.fit_hinge(rows, 6, 0.1)
    assert m.objective == pytest.approx(other.objective, rel=2e-3)
    if loss == "l2" and not weighted:
        packed = fit_dual(sparse(df.withColumn("weight", F.lit(1.0))), 6, 0.1)
        assert packed.objective == pytest.approx(m.objective, rel=1e-3)


def test_edges(spark, data):
    df, _, _, _ = data
    none = fit_dual(df.limit(0), 6)
    assert (none.w == 0).all() and none.rounds == 0
    assert fit_dual(df, 9, 0.1, tol=0.5).w.shape == (9,) and fit_dual(df, 2, 0.1, tol=0.5).w.shape == (2,)
    with pytest.raises(NotConverged):
        fit_dual(df, 6, 100.0, tol=1e-9, max_rounds=1)
    with pytest.raises(ValueError):
        fit_dual(df, 6, loss="l3")
