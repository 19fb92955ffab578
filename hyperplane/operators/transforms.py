"""Transforms of the vector column: each takes and returns (id, x, ...), and leaves its input as it is."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import normalized


def lp_norm(df: DataFrame, p: float = 2) -> DataFrame:
    return df.withColumn("x", normalized(F.col("x"), p))


def identity(df: DataFrame) -> DataFrame:
    return df


def min_max(df: DataFrame) -> DataFrame:
    """Every feature scaled to 0 to 1; a constant one becomes 0.  Extremes, two per feature, are broadcast."""
    ends = df.select(F.posexplode("x").alias("pos", "v")).groupBy("pos").agg(F.min("v").alias("low"), F.max("v").alias("high"))
    one = ends.agg(F.array_sort(F.collect_list(F.struct("pos", "low", "high"))).alias("ends"))
    scaled = F.zip_with("x", "ends", lambda v, e: F.when(e["high"] == e["low"], F.lit(0.0)).otherwise((v - e["low"]) / (e["high"] - e["low"])))
    return df.join(F.broadcast(one)).withColumn("x", scaled).drop("ends")
