"""Ranks and running sums over ranges of rows, so that neither a table nor a large group is ordered in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import stored


#: Columns that ranks and running sums put beside those of the rows for a while.
RESERVED = ("_part", "_before", "_n")


def _ranged(df: DataFrame, by: list) -> DataFrame:
    """df with ``_part``, the number of its range in the order of ``by``; a table, as ranges that are computed again may differ."""
    if clash := set(RESERVED) & set(df.columns):
        raise ValueError(f"columns {sorted(clash)} have names that are used here; rename them")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(parts, *by).withColumn("_part", F.spark_partition_id()), "ranges")


def ranked(df: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """df with ``name``, the place of each row from 0 within its group in the order of ``order``."""
    ranged = _ranged(df, [*group, *order])
    within = F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order)) - 1
    counts = ranged.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"))
    # Of each group: one row per range that it reaches into.
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", *group, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranged.withColumn(name, within).join(offsets, ["_part", *group]).withColumn(name, (F.col(name) + F.col("_before")).cast("long")).drop("_part", "_before")


def running(df: DataFrame, key: str, sums: dict[str, str], exact: bool = True) -> DataFrame:
    """df with, for each (value, name) of ``sums``, the sum of the value over rows with smaller keys, as a long, or as a double if not
    ``exact``; keys differ."""
    ranged = _ranged(df, [key])
    totals = ranged.groupBy("_part").agg(*(F.sum(v).alias(f"_{n}") for v, n in sums.items()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per range.
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in sums.values()))
    w = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    inside = ranged.select("*", *(F.coalesce(F.sum(v).over(w), F.lit(0)).alias(n) for v, n in sums.items()))
    out = inside.join(F.broadcast(offsets), "_part")
    return out.select(*df.columns, *((F.col(n) + F.col(f"_{n}")).cast("long" if exact else "double").alias(n) for n in sums.values()))
