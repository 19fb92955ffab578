"""Kernels in Spark's SQL against their columns."""

import pytest
from hyperplane.functions import kernels as K
from hyperplane.functions.sql_functions import register
from pyspark.sql import functions as F


def test_kernels_in_sql(spark):
    df = spark.createDataFrame([(1, [0.5, 0.0, 2.0], [1.0, 0.0, 0.25]), (2, [0.0], [0.0]), (3, [], [])], "id long, x array<double>, z array<double>")
    df.createOrReplaceTempView("pairs")
    names = register(spark)
    got = spark.sql(f"SELECT id, {', '.join(f'{n}(x, z) AS {n}' for n in names)} FROM pairs")
    want = df.select("id", *(k.expr(F.col("x"), F.col("z")).alias(f"kernel_{k.name}") for k in K.ALL))
    for a, b in zip(got.orderBy("id").collect(), want.orderBy("id").collect(), strict=True):
        assert tuple(a) == pytest.approx(tuple(b))
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_kernels_of_ones_own_name(spark):
    assert register(spark, {"near": K.Kernel("rbf", 3.0)}) == ["near"]
    assert spark.sql("SELECT near(array(1D), array(1D)), near(array(1D), array(2D)), near(NULL, array(1D))").first()[:] == (1.0, pytest.approx(2.718281828459045**-3), None)
