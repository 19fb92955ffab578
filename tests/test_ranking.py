"""The loss over all pairs, its gradient and curvature, and the ranker, against pairs that are formed."""

import numpy as np
import pytest
from hyperplane.operators import linear, ranking
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 3))
    x[5] = x[6] = x[7]
    rank = np.digitize(x[:, 0] - x[:, 1] + rng.normal(0, 0.3, 90), [-0.5, 0.5])
    ids = rng.permutation(900)[:90]
    rows = [(int(i), v.tolist(), int(r)) for i, v, r in zip(ids, x, rank)]
    return spark.createDataFrame(rows, "id long, x array<double>, rank int").repartition(4).cache(), rows


def brute(rows, w, c):
    order = sorted(rows, key=lambda r: (r[2], r[0]))
    x = np.array([r[1] for r in order])
    a, b = np.tril_indices(len(x), -1)
    d = x[a] - x[b]
    h = np.maximum(0, 1 - d @ w)
    z = d[h > 0]
    return w @ w / 2 + c * (h**2).sum(), w - 2 * c * h @ d, np.eye(len(w)) + 2 * c * z.T @ z


@pytest.mark.parametrize("block", [128, 16, 5])
def test_loss_of_all_pairs(spark, data, block):
    """With all pairs in one block, and with one to five levels above the blocks, sorted over ranges."""
    df, rows = data
    loss = ranking.PairLoss(df, 3, 0.7, block)
    assert loss.levels == {128: 0, 16: 3, 5: 5}[block]
    for w in (np.zeros(3), np.array([0.8, -0.5, 0.1])):
        got, want = loss.at(w, True), brute(rows, w, 0.7)
        assert got[0] == pytest.approx(want[0]) and np.allclose(got[1], want[1]) and (not w.any() or np.allclose(got[2], want[2]))
    assert np.allclose(loss.at(w)[1], brute(rows, w, 0.7)[1])
    loss.done()


def test_ranker_equals_one_trained_on_pairs(data):
    df, _ = data
    pairs = linear.fit_squared_hinge(ranking.difference_pairs(df).select("x", "y"), 3, 0.5)
    found = ranking.fit_ranker(df, 3, 0.5)
    assert np.allclose(found.w, pairs.w, atol=1e-4) and found.objective == pytest.approx(pairs.objective, rel=1e-6)


def test_sparse_rows_and_edges(spark, data):
    df, rows = data
    packed = df.withColumn("x", F.transform("x", lambda v, i: F.struct((i + 1).alias("idx"), v.alias("val"))))
    more = packed.unionByName(packed.limit(3).withColumn("rank", F.lit(None).cast("int")).withColumn("id", F.col("id") + 5000))
    loss = ranking.PairLoss(more, 3, 1.0, 64)
    w = np.array([0.3, 0.2, -0.9])
    assert np.allclose(loss.at(w)[1], brute(rows, w, 1.0)[1])
    none = ranking.fit_ranker(df.limit(0), 3)
    assert (none.w == 0).all() and none.objective == 0
