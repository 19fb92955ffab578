"""Linear training over a million features: sums leave partitions by ranges and are added up before they reach the driver."""

import numpy as np
import pytest
from hyperplane.operators import linear

DIM = 1_000_000


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(2)
    at = np.unique(rng.integers(1, DIM + 1, 40))
    rows = []
    for i in range(200):
        use = np.sort(rng.choice(at, 6, replace=False))
        val = rng.normal(size=6)
        rows.append((i, [(int(k), float(v)) for k, v in zip(use, val)], 1 if val[use.searchsorted(use[0])] + val[1] > 0 else -1))
    return spark.createDataFrame(rows, "id long, x array<struct<idx:int,val:double>>, y int").repartition(6).cache(), rows, at


def test_fit_of_a_million_features(data):
    df, rows, at = data
    place = {int(k): n for n, k in enumerate(at)}
    x = np.zeros((200, len(at)))
    for i, pairs, _ in rows:
        for k, v in pairs:
            x[i, place[k]] = v
    y = np.array([r[2] for r in rows])
    w = np.zeros(len(at))
    for _ in range(60):
        z = x[y * (x @ w) < 1]
        t = y[y * (x @ w) < 1]
        w = np.linalg.solve(np.eye(len(at)) + 0.2 * z.T @ z, 0.2 * z.T @ t)
    found = linear.fit_conjugate_gradient(df, DIM, 0.1)
    assert found.w.shape == (DIM,) and np.allclose(found.w[at - 1], w, atol=1e-3) and np.count_nonzero(found.w) <= len(at)


@pytest.mark.parametrize("size", [1, 40, 1 << 16, (1 << 16) + 1, 300_001])
def test_sums_by_ranges(spark, size):
    """Of one and of several ranges, with ranges that no row touches."""
    df = spark.createDataFrame([([float(k)],) for k in range(50)], "x array<double>").repartition(7)

    def f(x):
        out = np.zeros(size)
        out[size // 2] = x.sum()
        return out

    got = linear._summed(df, f, size)
    assert got[size // 2] == 1225 and np.count_nonzero(got) == 1
    assert (linear._summed(df.limit(0), f, size) == 0).all()
