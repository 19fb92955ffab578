"""Vector functions and kernels: hand-computed values, agreement of backends, and properties."""

import duckdb
import numpy as np
import pytest
from hyperplane.functions import kernels as K
from hyperplane.functions import vectors as V
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

X, Z = [1.0, 2.0, 0.0], [0.0, 1.0, 3.0]


@pytest.fixture(scope="module")
def pair(spark):
    return spark.createDataFrame([(1, X, Z)], "id long, x array<double>, z array<double>")


def value(df, e):
    return df.select(e.alias("v")).first().v


def test_hand_computed(pair):
    x, z = F.col("x"), F.col("z")
    assert value(pair, V.dot(x, z)) == 2 and value(pair, V.self_dot(x)) == 5 and value(pair, V.self_dot(z)) == 10
    assert value(pair, V.lp_norm(x, 1)) == 3 and value(pair, V.lp_norm(x, 2)) == pytest.approx(5**0.5)
    assert value(pair, V.subtract(x, z)) == [1, 1, -3] and value(pair, V.nnz(x)) == 2
    assert value(pair, V.preview(x)) == "3:1/1.0000 2/2.0000"
    for kernel, want in ((K.RBF, np.exp(-5.5)), (K.Kernel("poly", 1.0, 2, 1), 9), (K.CHI2, -7 / 6), (K.NCHI2, 2 / 3), (K.EXPCHI2, np.exp(-13 / 6))):
        assert value(pair, kernel.expr(x, z)) == pytest.approx(want)
        assert kernel.block(np.array([X]), np.array([Z]))[0, 0] == pytest.approx(want)
        assert duckdb.sql(f"select {kernel.sql(str(X) + '::double[]', str(Z) + '::double[]')}").fetchall()[0][0] == pytest.approx(want)


vectors = st.lists(st.lists(st.floats(0, 1, width=32), min_size=4, max_size=4), min_size=2, max_size=8).map(np.array)


@given(vectors)
def test_properties(x):
    for kernel in K.ALL:
        k = kernel.block(x, x)
        assert np.allclose(k, k.T)
    for kernel in (K.LINEAR, K.RBF, K.NCHI2, K.EXPCHI2):
        assert np.linalg.eigvalsh(kernel.block(x, x)).min() > -1e-8
    distance = 2 * (1 - K.CHI2.block(x, x))
    s = x.sum(1)
    assert np.allclose(distance, s[:, None] + s[None, :] - 4 * K.NCHI2.block(x, x), atol=1e-9)


def test_edges(spark):
    df = spark.createDataFrame([([], []), ([0.0, 0.0], [0.0, 0.0]), ([0.0, 1.0], [0.0, 0.0])], "x array<double>, z array<double>")
    rows = df.select(*[k.expr(F.col("x"), F.col("z")).alias(k.name) for k in K.ALL]).collect()
    assert rows[0].rbf == 1 and rows[1].expchi2 == 1 and rows[1].chi2 == 1 and rows[2].chi2 == 0.5
    assert df.select(V.normalized(F.col("x")).alias("x")).collect()[1].x == [0.0, 0.0]
    assert df.select(V.normalized(F.col("x"), 3).alias("x")).collect()[2].x == [0.0, 1.0]


def test_matrix_kernels(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 4.0]], [[1.0, 1.0], [1.0, 2.0]]), ([[1.0]], [[1.0, 2.0]])], "a array<array<double>>, b array<array<double>>")
    assert [r.v for r in df.select(K.frobenius(F.col("a"), F.col("b")).alias("v")).collect()] == [14.0, None]
    cov = np.array([[2.0, 0.5], [0.5, 1.0]])
    x, z = np.array([[1.0, 2.0]]), np.array([[3.0, 1.0]])
    assert (K.premultiplied(x, np.linalg.inv(cov)) @ z.T)[0, 0] == pytest.approx((x @ np.linalg.inv(cov) @ z.T)[0, 0])


def test_long_form_round_trip(spark):
    df = spark.createDataFrame([(1, X), (2, Z)], "id long, x array<double>")
    assert {r.id: r.x for r in V.densified(V.to_long(df), 3).collect()} == {1: X, 2: Z}
