"""Kernels and steps on sparse columns: arrays of (idx, val) and maps, against dense ones."""

import numpy as np
import pytest
from hyperplane.functions import kernels as K
from hyperplane.functions import vectors as V
from hyperplane.operators import gram
from hyperplane.operators import solver_steps as S
from hyperplane.operators.estimator import primal_scores
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.random((40, 7)) * (rng.random((40, 7)) < 0.4), 3)
    x[3] = 0
    rows = [(i, v.tolist(), 1 if i % 3 else -1, (i % 5) / 4) for i, v in enumerate(x)]
    dense = spark.createDataFrame(rows, "id long, x array<double>, y int, alpha double").cache()
    pairs = F.filter(F.transform("x", lambda v, i: F.struct((i + 1).alias("idx"), v.alias("val"))), lambda e: e["val"] != 0)
    # Entries stand in no order.
    packed = dense.withColumn("x", F.reverse(pairs))
    return dense, packed, packed.withColumn("x", F.map_from_entries("x"))


def table(df):
    return {tuple(r)[:-1]: r[-1] for r in df.collect()}


@pytest.mark.parametrize("kernel", K.ALL, ids=lambda k: k.name)
def test_columns_of_both_kinds(data, kernel):
    dense, packed, mapped = data
    want = table(gram.diagonal(dense, kernel))
    for df in (packed, mapped):
        got = table(gram.diagonal(df, kernel))
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    ids = dense.where("id in (3, 8)").select("id")
    want = table(gram.q_rows(dense, ids, kernel))
    got = table(gram.q_rows(mapped, ids, kernel))
    assert len(want) == 80 and all(got[k] == pytest.approx(want[k]) for k in want)


def test_steps(data):
    dense, packed, mapped = data
    state = S.dual_gradient(dense, K.RBF)
    want = S.second_order_pair(state, 1.0, K.RBF).first()
    for df in (packed, mapped):
        got = S.second_order_pair(S.dual_gradient(df, K.RBF), 1.0, K.RBF).first()
        assert (got.i, got.j) == (want.i, want.j) and got.gain == pytest.approx(want.gain)
        a, b = (table(S.linear_gradient(d, 0.5).select("id", "g")) for d in (df, dense))
        assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in b)
        assert S.linear_objective(df, 0.5).first()[0] == pytest.approx(S.linear_objective(dense, 0.5).first()[0])
        w = S.weight_vector(S.weights_of(dense))
        a, b = table(primal_scores(df, w)), table(primal_scores(dense, w))
        assert all(a[k] == pytest.approx(b[k]) for k in b)


def test_sparse_edges(spark, data):
    _, packed, _ = data
    with pytest.raises(ValueError):
        gram.diagonal(packed, K.Mahalanobis(((1.0,),))).count()
    none = V.common(F.array().cast("array<struct<idx:int,val:double>>"), F.array().cast("array<struct<idx:int,val:double>>"), lambda u, v: u * v)
    assert spark.range(1).select(none).first()[0] == 0.0
    big = spark.createDataFrame([(1, [(2**31 - 1, 2.0), (5, 1.0)], [(5, 3.0), (2**31 - 1, 0.5)])], "id long, x array<struct<idx:int,val:double>>, z array<struct<idx:int,val:double>>")
    assert big.select(K.LINEAR.expr(F.col("x"), F.col("z"), True)).first()[0] == 4.0
