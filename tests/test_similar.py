"""Exact nearest rows by the inverted index, against all pairs, and how many pairs its bounds leave."""

import numpy as np
import pytest
from hyperplane.operators import similar
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data(spark):
    """Many rare features and a few that most rows have with small values."""
    rng = np.random.default_rng(5)
    x = np.zeros((150, 400))
    for i in range(150):
        x[i, rng.choice(395, 6, replace=False) // rng.integers(1, 30)] = rng.integers(1, 9, 6)
        x[i, 395 + rng.choice(5, 4, replace=False)] = 0.5
    x[7] = x[8]
    x[9] = 0
    rows = [(i, [(int(j) + 1, float(v[j])) for j in np.flatnonzero(v)]) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x array<struct<idx:int,val:double>>").repartition(4).cache(), x


def brute(x, n):
    k = x @ x.T
    out = []
    for i in range(len(x)):
        near = sorted((-round(k[i, j], 9), j) for j in range(len(x)) if j != i and k[i, j] > 0)[:n]
        out += [(i, j, -v, r + 1) for r, (v, j) in enumerate(near)]
    return out


@pytest.mark.parametrize("n", [1, 3, 200])
def test_nearest_rows(data, n):
    df, x = data
    got = sorted((r.id, r["rank"], r.other, round(r.k, 9)) for r in similar.topn_sparse(df, n).select("id", "other", "k", "rank").collect())
    assert got == sorted((i, r, j, v) for i, j, v, r in brute(x, n))


def test_bounds_leave_few_pairs(data):
    df, x = data
    index = similar._bounded(df)
    sharing = int(((x @ x.T > 0).sum() - (x.any(1)).sum()))
    left = similar._candidates(index, 2).count()
    assert left < 0.5 * sharing and left < 0.5 * 150 * 149


def test_other_forms_and_edges(spark, data):
    df, x = data
    mapped = df.withColumn("x", F.map_from_entries("x"))
    a, b = (sorted(map(tuple, similar.topn_sparse(d, 2).select("id", "rank", "other").collect())) for d in (df, mapped))
    assert a == b
    assert similar.topn_sparse(df.limit(0), 2).count() == 0
    with pytest.raises(Exception, match="below 0"):
        similar.topn_sparse(spark.createDataFrame([(1, [(1, -1.0)])], "id long, x array<struct<idx:int,val:double>>"), 2).count()


@pytest.mark.parametrize(("cut", "short"), [(False, 0), (True, 0), (True, 200)])
def test_turns_and_cut_lists(data, cut, short, monkeypatch):
    """Turns hold a share of the pairs each; lists that are cut, and short ones without bounds, give the same sums."""
    df, x = data
    monkeypatch.setattr(similar, "SHORT_LIST", short)
    if short:
        monkeypatch.setattr(similar, "_candidates", lambda *a: pytest.fail("bounds were taken"))
    monkeypatch.setattr(similar, "TURN_PAIRS", 1)
    monkeypatch.setattr(similar, "TURN_SHARE", 8)
    monkeypatch.setattr(similar, "LIST_ROWS", 32 if cut else 1 << 14)
    lists = similar._Lists.of(similar._bounded(df))
    assert lists.turns > 2 and lists.pairs <= lists.turns * 8 * lists.entries and lists.chunks == (4 if cut else 1)
    assert lists.table.agg(F.max(F.size("others"))).first()[0] <= (64 if cut else 150)
    got = sorted((r.id, r["rank"], r.other, round(r.k, 9)) for r in similar.topn_sparse(df, 3).select("id", "other", "k", "rank").collect())
    assert got == sorted((i, r, j, v) for i, j, v, r in brute(x, 3))
