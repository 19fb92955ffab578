"""Covariances and the kernel they give, and rows that are matrices."""

import numpy as np
import pytest
from hyperplane.functions import kernels as K
from hyperplane.operators import covariance, decomposition, gram, linear
from hyperplane.operators.estimator import KernelSVC, summary
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(90, 4)) @ rng.normal(size=(4, 4)) + 5
    x[:, 3] = 2.0
    y = np.where(x[:, 0] - x[:, 1] + rng.normal(0, 1, 90) > 0, 1, -1)
    return spark.createDataFrame([(i, v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))], "id long, x array<double>, y int").repartition(3).cache(), x, y


def packed(df):
    return df.withColumn("x", F.transform("x", lambda v, i: F.struct((i + 1).alias("idx"), v.alias("val"))))


def test_covariance(spark, data):
    df, x, _ = data
    for rows in (df, packed(df), df.unionByName(df.limit(1).withColumn("x", F.lit(None).cast("array<double>")))):
        mean, cov = covariance.covariance(rows, 4, 0.5)
        assert np.allclose(mean, x.mean(0)) and np.allclose(cov, np.cov(x.T) + 0.5 * np.eye(4))
    assert np.allclose(covariance.covariance(df.limit(0), 4, 1.0)[1], np.eye(4)) and covariance.covariance(df, 2)[1].shape == (2, 2)
    with pytest.raises(ValueError):
        covariance.covariance(df, covariance.MOST + 1)


def test_fitted_kernel_and_whitening(data):
    """A constant feature is kept in bounds by the ridge; linear training on whitened rows is training with the kernel."""
    df, x, y = data
    kernel = covariance.fitted(df, 4, 0.1)
    assert np.allclose(np.array(kernel.inverse), np.linalg.inv(np.cov(x.T) + 0.1 * np.eye(4)))
    for rows in (df, packed(df)):
        white = covariance.whitened(rows, kernel)
        assert white.columns == df.columns
        z = np.array([r.x for r in white.orderBy("id").collect()])
        assert np.allclose(z @ z.T, kernel.block(x, x))
    a = decomposition.train(df, kernel, 0.5).objective
    b = decomposition.train(covariance.whitened(df, kernel), K.LINEAR, 0.5).objective
    assert a == pytest.approx(b, rel=1e-3)
    assert linear.fit_squared_hinge(covariance.whitened(df, kernel), 4, 0.5).gradient_norm < 1e-3


def test_matrices(spark, data):
    df, x, _ = data
    rows = df.select("id", F.array(F.slice("x", 1, 2), F.slice("x", 3, 2)).alias("x"), F.col("y").alias("label"))
    flat = rows.withColumn("x", F.flatten("x"))
    a, b = KernelSVC(K.Frobenius(), 0.3).fit(rows), KernelSVC(K.LINEAR, 0.3).fit(flat)
    assert summary(a.model).first().objective == pytest.approx(summary(b.model).first().objective)
    assert sorted(a.predict(rows).collect()) == sorted(b.predict(flat).collect())
    far = decomposition.train(rows.withColumnRenamed("label", "y"), K.Frobenius(), 0.3, working=30)
    assert far.objective == pytest.approx(summary(b.model).first().objective, rel=1e-3)
    got = {(r.i, r.id): r.q for r in gram.q_rows(rows.withColumnRenamed("label", "y"), rows.where("id = 3").select("id"), K.Frobenius()).collect()}
    assert got[3, 5] == pytest.approx(float(x[3] @ x[5]) * (1 if rows.where("id in (3, 5)").select("label").distinct().count() == 1 else -1))
    ragged = rows.unionByName(spark.createDataFrame([(1000, [[1.0], [2.0, 3.0, 4.0]], 1)], "id long, x array<array<double>>, label int"))
    with pytest.raises(Exception, match="one shape"):
        KernelSVC(K.Frobenius(), 0.3).fit(ragged).model.count()
