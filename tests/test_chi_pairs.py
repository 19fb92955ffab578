"""Largest values and sums of chi-square kernels over all pairs, against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from hyperplane.functions import kernels as K
from hyperplane.operators import chi_pairs, gram


def table(spark, x):
    return spark.createDataFrame([(3 * i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>")


def bars(n, seed=7):
    """Histograms: single ones, near copies, exact copies of one row, zeros and values down to 1e-12."""
    rng = np.random.default_rng(seed)
    x = np.exp(rng.normal(0, 2, (n, 6))) * (rng.random((n, 6)) < 0.8) + 1e-12
    x[n // 2 :: 4] = x[: len(x[n // 2 :: 4])] * (1 + rng.normal(0, 1e-3, (len(x[n // 2 :: 4]), 6)))
    x[5::9] = x[5]
    return x / x.sum(1, keepdims=True)


def brute(x, kernel):
    k = kernel.block(x, x)
    sums = k.sum(1)
    np.fill_diagonal(k, -np.inf)
    return sums, k.max(1)


@pytest.mark.parametrize("kernel", [K.CHI2, K.NCHI2, K.EXPCHI2])
@pytest.mark.parametrize("scaled", [False, True])
def test_largest_values_take_few_pairs(spark, kernel, scaled, monkeypatch):
    x = bars(1300)
    if scaled:
        # Rows of any sums, one of them empty.
        x = x * np.exp(np.random.default_rng(1).normal(0, 1, (1300, 1)))
        x[11] = 0
    monkeypatch.setattr(chi_pairs, "LINE_ROWS", 200)
    df = table(spark, x)
    got = {r.id: r.largest for r in chi_pairs.largest(df, kernel, chi_pairs.features(df, kernel)).collect()}
    np.testing.assert_allclose([got[3 * i] for i in range(1300)], brute(x, kernel)[1], rtol=1e-12, atol=1e-14)


@pytest.mark.parametrize("kernel", [K.CHI2, K.NCHI2])
def test_row_sums_of_chi_square_form_no_blocks(spark, kernel, monkeypatch):
    x = bars(300)
    with monkeypatch.context() as m:
        m.setattr(gram, "against", lambda *a, **k: pytest.fail("blocks of kernel values were formed"))
        got = {r.id: r for r in gram.row_sums(table(spark, x), kernel).collect()}
    sums, most = brute(x, kernel)
    np.testing.assert_allclose([got[3 * i].row_sum for i in range(300)], sums, rtol=1e-12)
    np.testing.assert_allclose([got[3 * i].largest for i in range(300)], most, rtol=1e-12)
    one = gram.row_sums(table(spark, x[:1]), kernel).collect()
    assert len(one) == 1 and one[0].largest is None
    assert gram.row_sums(table(spark, x[:1]).limit(0), kernel).count() == 0


def test_values_without_bounds_go_by_blocks(spark):
    """Negative values, values that are no numbers and tables of zeros have no bounds."""
    for x in ([[1.0, -0.5], [0.2, 0.3]], [[1.0, float("nan")], [0.2, 0.3]], [[0.0, 0.0]] * 2, [[1e-200, 1.0], [1e200, 1.0]]):
        assert chi_pairs.features(table(spark, np.array(x)), K.EXPCHI2) is None
    assert {r.largest for r in gram.row_sums(table(spark, np.zeros((2, 2))), K.NCHI2).collect()} == {0.0}
    assert {r.largest for r in gram.row_sums(table(spark, np.array([[1.0, -0.5], [0.2, 0.3]])), K.EXPCHI2).collect()} == {float(K.EXPCHI2.block(np.array([[1.0, -0.5]]), np.array([[0.2, 0.3]]))[0, 0])}


def test_copies_are_not_taken_pair_by_pair(monkeypatch):
    """A row that has the greatest value there can be looks no further."""
    x = np.tile(bars(6)[:2], (1500, 1))
    taken = []
    monkeypatch.setattr(chi_pairs, "common_of_pairs", lambda x, z, i, j, was=chi_pairs.common_of_pairs: taken.append(len(i)) or was(x, z, i, j))
    monkeypatch.setattr(chi_pairs, "NOTED", 1000)
    shape = chi_pairs.Features(*chi_pairs.fitted(np.array([-8, -4, -1]), np.array([1, 1, 1])), len(x), 1.0)
    side = chi_pairs._Side(pa.table({"id": pa.array(np.arange(len(x))), "x": pa.array(list(x))}), shape, True)
    for a, b in chi_pairs.blocks(len(x), None):
        bound = side.left[a] @ side.right[b].T
        if a == b:
            np.fill_diagonal(bound, -np.inf)
        side.take(a, side, b, bound, bound.max(1).astype(np.float64))
    side.settle(side)
    np.testing.assert_allclose(side.best, 0, atol=1e-14)
    assert sum(taken) < len(x) ** 2 / 8


def test_sums_of_exponential_chi_square_take_few_values(spark, monkeypatch):
    """All pairs but those far from the mean are sums of features and of small remainders; blocks of kernel values are not formed."""
    x = np.random.default_rng(3).dirichlet(np.full(24, 0.8), 1300)
    x[600::7] = x[: len(x[600::7])] * (1 + np.random.default_rng(4).normal(0, 1e-3, (len(x[600::7]), 24)))
    x[5::50] = x[5]
    x /= x.sum(1, keepdims=True)
    monkeypatch.setattr(chi_pairs, "LEAST_SUM_ROWS", 1000)
    monkeypatch.setattr(chi_pairs, "LINE_ROWS", 200)
    # Sums of one half with gamma 0.9: other gammas and row sums than of histograms.
    for kernel, scale in ((K.EXPCHI2, 1.0), (K.Kernel("expchi2", 0.9), 0.5 * np.linspace(0.5, 1, 1300)[:, None])):
        some = x * scale
        with monkeypatch.context() as m:
            m.setattr(gram, "against", lambda *a, **k: pytest.fail("blocks of kernel values were formed"))
            got = {r.id: r for r in gram.row_sums(table(spark, some), kernel).collect()}
        sums, most = brute(some, kernel)
        assert len(got) == 1300
        np.testing.assert_allclose([got[3 * i].row_sum for i in range(1300)], sums, rtol=0, atol=1e-7)
        np.testing.assert_allclose([got[3 * i].largest for i in range(1300)], most, rtol=1e-12)


def test_wide_exponents_go_by_blocks(spark):
    df = table(spark, bars(40) * 100)
    shape = chi_pairs.features(df, K.EXPCHI2)
    assert not chi_pairs.sums_apply(K.EXPCHI2, chi_pairs.Features(shape.nodes, shape.turn, 1 << 20, shape.largest_sum))
    assert chi_pairs.sums_apply(K.EXPCHI2, chi_pairs.Features(shape.nodes, shape.turn, 1 << 20, 1.0))
    assert not chi_pairs.sums_apply(K.EXPCHI2, chi_pairs.Features(shape.nodes, shape.turn, 500, 1.0))
    assert not chi_pairs.sums_apply(K.EXPCHI2, chi_pairs.Features(shape.nodes, shape.turn, 1 << 20, 1.0, 1000))
    assert shape.width == 6


def test_norms_of_empty_zero_and_missing_vectors(spark):
    from pyspark.sql import functions as F

    from hyperplane.functions.vectors import histogram, normalized

    df = spark.createDataFrame([(0, [3.0, -4.0]), (1, [0.0, 0.0]), (2, []), (3, None)], "id long, x array<double>")
    got = {r.id: (r.a, r.b) for r in df.select("id", histogram(F.col("x")).alias("a"), normalized(F.col("x"), 2).alias("b")).collect()}
    assert got == {0: ([3 / 7, 4 / 7], [0.6, -0.8]), 1: ([0.0, 0.0], [0.0, 0.0]), 2: ([], []), 3: (None, None)}


def test_scores_of_exponential_chi_square_are_split(spark, monkeypatch):
    x = bars(900)
    rng = np.random.default_rng(2)
    alpha, y = rng.integers(0, 3, 900) / 2, rng.choice([-1, 1], 900)
    df = spark.createDataFrame([(3 * i, [float(v) for v in r], int(y[i]), float(alpha[i])) for i, r in enumerate(x)], "id long, x array<double>, y int, alpha double")
    monkeypatch.setattr(chi_pairs, "LEAST_SUM_ROWS", 100)
    monkeypatch.setattr(chi_pairs, "LINE_ROWS", 200)
    plain = K.EXPCHI2.block(x, x) @ (alpha * y)
    with monkeypatch.context() as m:
        m.setattr(gram, "against", lambda *a, **k: pytest.fail("blocks of kernel values were formed"))
        got = {r.id: r for r in gram.scores(df, df.where("alpha > 0"), K.EXPCHI2, 0.25).collect()}
    np.testing.assert_allclose([got[3 * i].score for i in range(900)], plain - 0.25, atol=1e-6)
    assert [got[3 * i].pred for i in range(900)] == np.where(plain < 0.25, -1, 1).tolist()
    # Support rows that are few, others, or there twice go by blocks.
    from pyspark.sql import functions as F

    for support in (df.where("id < 30"), df.withColumn("id", F.col("id") + 1), df.unionByName(df)):
        rows = support.collect()
        z, w = np.array([r.x for r in rows]), np.array([r.alpha * r.y for r in rows])
        got = {r.id: r.score for r in gram.scores(df, support, K.EXPCHI2).collect()}
        np.testing.assert_allclose([got[3 * i] for i in range(900)], K.EXPCHI2.block(x, z) @ w, atol=1e-10)
