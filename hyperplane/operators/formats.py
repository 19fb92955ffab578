"""Sparse-matrix encodings of the long form (id from 0, idx from 1, val): positions as window queries.

Row ranks come from counts per row, so a running sum is taken over one row per
matrix row or column, never over entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranks import ranked, running


def row_lengths(long: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, nnz) of every row id in ``rows``."""
    return rows.select("id").join(long.groupBy("id").agg(F.count(F.lit(1)).alias("nnz")), "id", "left").select("id", F.coalesce("nnz", F.lit(0)).alias("nnz"))


def csr_offsets(long: DataFrame, rows: DataFrame) -> DataFrame:
    """(id, nnz, start): entries before each row."""
    return running(row_lengths(long, rows), "id", {"nnz": "start"})


def csc_offsets(long: DataFrame, dim: int) -> DataFrame:
    """(idx, nnz, start) of columns 1 to dim, empty ones included."""
    columns = long.sparkSession.range(1, dim + 1).select(F.col("id").cast("int").alias("idx"))
    counts = columns.join(long.groupBy("idx").agg(F.count(F.lit(1)).alias("nnz")), "idx", "left").select("idx", F.coalesce("nnz", F.lit(0)).alias("nnz"))
    return running(counts, "idx", {"nnz": "start"})


def csr_entries(long: DataFrame) -> DataFrame:
    """(pos, id, idx, val) in row order: the values and indices of the compressed rows."""
    return ranked(long.select("id", "idx", "val"), [], ["id", "idx"], "pos").select("pos", "id", "idx", "val")


def csc_entries(long: DataFrame, dim: int) -> DataFrame:
    """(pos, idx, id, val) in column order, of columns 1 to dim."""
    return ranked(long.select("id", "idx", "val").where(F.col("idx").between(1, dim)), [], ["idx", "id"], "pos").select("pos", "idx", "id", "val")


def _slots(long: DataFrame) -> DataFrame:
    """Entries with their place j within the row."""
    return long.withColumn("j", F.row_number().over(Window.partitionBy("id").orderBy("idx")) - 1)


def ellpack(long: DataFrame, n_rows: int) -> DataFrame:
    """(id, idx, val, pos): padded columns of all rows, pos = j n + id."""
    return _slots(long).select("id", "idx", "val", (F.col("j").cast("long") * n_rows + F.col("id")).alias("pos"))


def ellpack_aligned(lengths: DataFrame, align: int) -> DataFrame:
    """(id, units): row lengths in units of ``align``; the width is the longest row rounded up."""
    return lengths.select("id", F.ceil(F.col("nnz") / align).cast("long").alias("units"))


def ertilp(long: DataFrame, n_rows: int, threads: int) -> DataFrame:
    """(id, idx, val, pos) with ``threads`` entries of a row side by side: pos = (j / T) n T + id T + j mod T."""
    j = F.col("j").cast("long")
    pos = F.floor(j / threads) * n_rows * threads + F.col("id") * threads + j % threads
    return _slots(long).select("id", "idx", "val", pos.cast("long").alias("pos"))


def slice_starts(lengths: DataFrame, slice_rows: int, threads: int, prefetch: int = 1, unit: int = 64) -> DataFrame:
    """(slice, width, start) of sliced encodings: each slice is as wide as its longest row (in units of threads * prefetch), its rows aligned to ``unit``."""
    step = threads * prefetch
    align = -(-slice_rows * threads // unit) * unit
    widths = lengths.groupBy(F.floor(F.col("id") / slice_rows).cast("long").alias("slice")).agg(F.max(F.ceil(F.col("nnz") / step)).cast("long").alias("units"))
    sized = widths.select("slice", (F.col("units") * prefetch).alias("width"), (F.col("units") * prefetch * align).alias("cells"))
    return running(sized, "slice", {"cells": "start"}).drop("cells")


def sliced(long: DataFrame, lengths: DataFrame, slice_rows: int, threads: int, prefetch: int = 1, unit: int = 64) -> DataFrame:
    """(id, idx, val, pos) of a sliced encoding: start + (j / T) align + (id mod slice) T + j mod T."""
    align = -(-slice_rows * threads // unit) * unit
    starts = slice_starts(lengths, slice_rows, threads, prefetch, unit).select("slice", "start")
    j = F.col("j").cast("long")
    pos = F.col("start") + F.floor(j / threads) * align + (F.col("id") % slice_rows) * threads + j % threads
    return _slots(long).withColumn("slice", F.floor(F.col("id") / slice_rows).cast("long")).join(starts, "slice").select("id", "idx", "val", pos.cast("long").alias("pos"))
