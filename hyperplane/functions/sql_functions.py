"""Kernels as functions of Spark SQL: temporary SQL functions, which the optimizer inlines, so they stay in the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .kernels import ALL, Kernel


def body(kernel: Kernel, x: str = "x", z: str = "z") -> str:
    """The kernel of two array expressions in Spark's SQL."""

    def over(term: str) -> str:
        return f"aggregate(zip_with({x}, {z}, (u, v) -> {term}), 0D, (a, v) -> a + v)"

    def ratio(term: str) -> str:
        return over(f"CASE WHEN u + v = 0 THEN 0D ELSE {term} / (u + v) END")

    def square(side: str) -> str:
        return f"aggregate({side}, 0D, (a, v) -> a + v * v)"

    products = over("u * v")
    if kernel.name == "linear":
        return products
    if kernel.name == "rbf":
        # greatest() passes over nulls.
        return f"IF({x} IS NULL OR {z} IS NULL, NULL, exp(-{kernel.gamma}D * greatest(0D, {square(x)} + {square(z)} - 2 * {products})))"
    if kernel.name == "poly":
        return f"pow({kernel.gamma}D * {products} + {kernel.coef}D, {kernel.degree}D)"
    if kernel.name == "nchi2":
        return ratio("u * v")
    distance = ratio("(u - v) * (u - v)")
    return f"1 - 0.5D * {distance}" if kernel.name == "chi2" else f"exp(-{kernel.gamma}D * {distance})"


def register(spark: SparkSession, kernels: dict[str, Kernel] | None = None) -> list[str]:
    """Registers kernels of two arrays of doubles under names, by default ``kernel_<name>`` of each one; returns the names.

    Null vectors give null.
    """
    kernels = {f"kernel_{k.name}": k for k in ALL} if kernels is None else kernels
    for name, kernel in kernels.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x ARRAY<DOUBLE>, z ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body(kernel)}")
    return list(kernels)
