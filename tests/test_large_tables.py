"""Operators whose time or memory grew with the square of the table, at small size against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperplane.functions import kernels as K
from hyperplane.functions.sparse import SparseRows
from hyperplane.operators import additive, decomposition, gram, ranking, smo


@pytest.fixture(scope="module")
def bars(spark):
    """(id, x, y, alpha): histograms with zeros, an empty one, and values from 1e-12 to 1e6."""
    rng = np.random.default_rng(3)
    x = np.exp(rng.normal(0, 6, (60, 5))) * (rng.random((60, 5)) < 0.7)
    x[7] = 0
    return x, spark.createDataFrame([(i, [float(v) for v in r], 1 if i % 3 else -1, (i % 5) / 4) for i, r in enumerate(x)], "id long, x array<double>, y int, alpha double")


@pytest.mark.parametrize("kernel", [K.CHI2, K.NCHI2])
def test_chi_square_sums_form_no_pairs(bars, kernel, monkeypatch):
    x, df = bars
    w = np.array([(i % 5) / 4 * (1 if i % 3 else -1) for i in range(60)])
    want = kernel.block(x, x) @ w
    monkeypatch.setattr(gram, "against", lambda *a, **k: pytest.fail("pairs were formed"))
    got = {r.id: r.score for r in gram.scores(df, df.where("alpha > 0"), kernel).collect()}
    # Errors are of the size of the sum's last places.
    size = np.abs(kernel.block(x, x)) @ np.abs(w) + x.sum() + 1
    assert max(abs(got[i] - want[i]) / size[i] for i in range(60)) < 1e-13


def test_chi_square_row_sums_of_extreme_values(spark):
    df = spark.createDataFrame([(0, [0.0, 5e-324]), (1, [1e-300, 1.0]), (2, [0.0, 0.0])], "id long, x array<double>")
    x = np.array([[0.0, 5e-324], [1e-300, 1.0], [0.0, 0.0]])
    got = {r.id: r.total for r in additive.sums(df, df, K.NCHI2).collect()}
    np.testing.assert_allclose([got[i] for i in range(3)], K.NCHI2.block(x, x).sum(1), rtol=1e-13, atol=1e-300)
    assert additive.sums(df.limit(0), df, K.NCHI2).count() == 0
    assert [r.total for r in additive.sums(df, df.limit(0), K.CHI2).collect()] == [0.0] * 3


@pytest.mark.parametrize("kernel", K.ALL)
def test_blocks_do_not_change_with_their_steps(bars, kernel):
    """Blocks work in place; zeros and values of all sizes against the plain formula."""
    x = np.minimum(bars[0], 10)
    u, v = x[:, None], x[None]
    with np.errstate(invalid="ignore"):
        ratio = np.where(u + v == 0, 0, u * v / (u + v)).sum(2)
    distance, p = u.sum(2) + v.sum(2) - 4 * ratio, (u * v).sum(2)
    want = {"linear": p, "poly": (kernel.gamma * p + kernel.coef) ** kernel.degree, "rbf": np.exp(-kernel.gamma * ((u - v) ** 2).sum(2)), "chi2": 1 - 0.5 * distance, "nchi2": ratio, "expchi2": np.exp(-kernel.gamma * distance)}
    before = x.copy()
    np.testing.assert_allclose(kernel.block(x, x), want[kernel.name], rtol=1e-9, atol=1e-9)
    assert (x == before).all()


def test_pair_sums_without_pairs(spark, monkeypatch):
    rows = [(5, 2, 1.5), (1, 0, -2.0), (9, None, 4.0), (3, 2, None), (4, 1, 0.25), (12, 0, 7.0), (2, 1, 3.0)]
    df = spark.createDataFrame(rows, "id long, rank int, value double")
    slow = ranking.difference_pairs(df.withColumn("x", F.array("value")))
    want = sorted(tuple(r) for r in slow.groupBy("i").agg(F.count(F.lit(1)), F.sum("y"), F.round(F.sum(F.col("x")[0]), 9)).collect())
    labels = {}
    for i, a, _ in rows:
        for j, b, _ in rows:
            if j < i and a is not None and b is not None:
                n = labels.setdefault(a, [0, 0])
                n[a < b] += 1
    monkeypatch.setattr(ranking, "difference_pairs", lambda *a: pytest.fail("pairs were formed"))
    assert sorted(tuple(r) for r in ranking.pair_sums(df).select("i", "n", "balance", F.round("first", 9)).collect()) == want
    assert {r.rank: [r.n_pos, r.n_neg] for r in ranking.pair_labels(df.select("id", "rank")).collect()} == labels
    assert ranking.pair_labels(df.limit(0).select("id", "rank")).count() == 0


def test_upper_stats_and_most_similar_with_ties(spark):
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(700, 3)), 1)
    df = spark.createDataFrame([(i * 9 % 700, [float(v) for v in x[i * 9 % 700]]) for i in range(700)], "id long, x array<double>")
    k = K.LINEAR.block(x, x)
    up = k[np.triu_indices(700, 1)]
    r = gram.upper_stats(df, K.LINEAR).first()
    assert (r.n, round(r.total, 6), r.low, r.high) == (len(up), round(up.sum(), 6), up.min(), up.max())
    np.fill_diagonal(k, -np.inf)
    want = {(i, n + 1, int(o)) for i in range(700) for n, o in enumerate(np.lexsort((np.arange(700), -np.round(k[i], 9)))[:4])}
    assert {(r.id, r.rank, r.other) for r in gram.most_similar(df, K.LINEAR, 4).collect()} == want


def test_working_sets_grow_with_the_table(spark, monkeypatch):
    rng = np.random.default_rng(2)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(size=3)], 1 if rng.random() < 0.5 else -1) for i in range(400)], "id long, x array<double>, y int")
    few = decomposition.train(df, K.RBF, 1.0, working=20)
    monkeypatch.setattr(decomposition, "LEAST_WORKING", 20)
    monkeypatch.setattr(decomposition, "WORKING_SHARE", 2)
    many = decomposition.train(df, K.RBF, 1.0)
    assert many.rounds < few.rounds / 2
    assert abs(many.objective - few.objective) < 1e-2


def test_kernel_rows_are_built_in_blocks(monkeypatch):
    x = np.random.default_rng(1).normal(size=(300, 4))
    monkeypatch.setattr(smo, "BLOCK_ROWS", 64)
    np.testing.assert_array_equal(smo.Rows(x, K.LINEAR).whole, K.LINEAR.block(x, x))
    largest = []
    monkeypatch.setattr(K.Kernel, "block", lambda self, a, b, squares=None, was=K.Kernel.block: largest.append(len(a)) or was(self, a, b, squares))
    smo.Rows(x, K.RBF)
    assert max(largest) == 64


def test_blocks_give_a_start(spark, monkeypatch):
    """A start from blocks ends at the same optimum, weights and rows that a problem leaves out included."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(size=3)], [1 if rng.random() < 0.5 else -1, 0 if i % 4 == 0 else (1 if i % 3 else -1)], 1.0 + i % 2) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, x array<double>, y array<int>, weight double")
    plain = decomposition.train_many(df, [K.RBF, K.LINEAR], [1.0, 0.1])
    monkeypatch.setattr(decomposition, "START_ROWS", 60)
    monkeypatch.setattr(decomposition, "BROADCAST_BYTES", 1 << 15)
    begun = decomposition.train_many(df, [K.RBF, K.LINEAR], [1.0, 0.1])
    np.testing.assert_allclose(begun.objective, plain.objective, atol=2e-2)
    assert (begun.gap < 1e-3).all()
    for r in begun.state.collect():
        box = np.array([1.0, 0.1]) * r.weight
        assert (np.array(r.alpha) >= 0).all() and (np.array(r.alpha) <= box + 1e-12).all()
        assert r.y[1] != 0 or r.alpha[1] == 0
    balance = np.sum([np.array(r.alpha) * np.array(r.y) for r in begun.state.collect()], 0)
    np.testing.assert_allclose(balance, 0, atol=1e-9)


def test_platt_looks_for_partners_in_one_kernel_row(monkeypatch):
    """A row that no partner lets move takes its own kernel row, not one of each partner."""
    x = np.random.default_rng(6).normal(size=(60, 3))
    asked = []
    monkeypatch.setattr(smo.Rows, "__getitem__", lambda self, i, was=smo.Rows.__getitem__: asked.append(i) or was(self, i))
    assert (smo.solve_platt(x, np.ones(60), K.RBF, 1.0).alpha == 0).all()
    assert len(asked) <= 5 * 60


def test_sparse_chi_square_of_few_features_forms_no_entry_pairs(monkeypatch):
    """Rows of few features go through dense blocks; rare features among many do not."""
    rng = np.random.default_rng(8)

    def rows(x):
        return SparseRows(np.concatenate(([0], np.cumsum((x != 0).sum(1)))), np.nonzero(x)[1] + 1, x[x != 0])

    x = rng.integers(0, 4, (40, 5)) / 10
    for kernel in (K.CHI2, K.NCHI2, K.EXPCHI2):
        want = kernel.block(x, x[:30])
        with monkeypatch.context() as m:
            m.setattr(SparseRows, "common", lambda *a: pytest.fail("pairs of entries were formed"))
            np.testing.assert_allclose(kernel.block(rows(x), rows(x[:30])), want, rtol=1e-12, atol=1e-12)
    rare = np.zeros((40, 500))
    rare[np.arange(40), rng.integers(0, 500, 40)] = 1.0
    assert rows(rare).dense_common(rows(rare)) is None and rows(x[:0]).dense_common(rows(x)) is None
    np.testing.assert_allclose(K.NCHI2.block(rows(rare), rows(rare)), K.NCHI2.block(rare, rare))
