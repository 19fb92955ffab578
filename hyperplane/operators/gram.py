"""Kernel-matrix operators: sums and extremes over all pairs of two tables, in NumPy blocks.

Vectors are arrays of doubles, or sparse: arrays of structs (idx, val) or maps
from index to value.  Kernel values are taken in blocks of ``TILE``.  Up to
``BROADCAST_BYTES`` the right side is sent to the workers, and each partition of
the left side meets it without a shuffle.  Beyond, both sides meet in a grid of
cells: a row of the left side is sent along one line of cells and a row of the
right side down one column, which is the square root of the number of cells, and
each cell is a task that holds its share of both sides.  The number of cells grows
with the rows, so what is moved grows with their power of 1.5, until cells hold
``CELL_ROWS`` of a side; beyond, more cells keep a task's memory bounded.  Partial
results are combined by id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Kernel
from ..functions.sparse import SparseRows, matrix
from ..functions.vectors import entries, is_sparse, width
from . import additive, chi_pairs

BLOCK_ROWS = 2048
#: Rows and columns of the blocks of kernel values: dense ones stay in a core's cache.
TILE, SPARSE_TILE = (256, 512), (1024, 512)
#: Rows of a side in one cell, at most on average.
CELL_ROWS = 1 << 18
BROADCAST_BYTES = 64 << 20


def fetched(df: DataFrame, columns: list[str]) -> dict[str, np.ndarray] | None:
    """Columns of a table of bounded size on the driver, sorted by id; None if it is larger than BROADCAST_BYTES."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.greatest(width(df), F.lit(0))).alias("d")).first()
    if not row.n or (2 * row.d + row.n * len(columns)) * 8 > BROADCAST_BYTES:
        return None if row.n else {c: np.zeros((0, 0)) if c == "x" else np.zeros(0) for c in ["id", *columns]}
    t = df.select("id", *columns).toArrow().sort_by("id")
    return {c: matrix(t.column(c)) if c == "x" else t.column(c).to_numpy() for c in ["id", *columns]}


def against(left: DataFrame, right: DataFrame, kernel: Kernel, extra: list[str], results: dict[str, tuple[str, Callable]], left_extra: list[str] | None = None) -> DataFrame:
    """One row per row of ``left`` (id, x, left_extra): results over all rows of ``right`` (id, x, extra).

    ``results`` maps a name to (how partial results combine: sum, min or max; f),
    f(k, left, right) giving a partial vector from a block of kernel values and
    the columns of its rows and columns; or to ("dot", f), f(right) giving the
    weights of a sum of kernel values: all such sums are one product a block.
    """
    left_extra = left_extra or []
    names = list(results)
    schema = "id long, " + ", ".join(f"{n} double" for n in names)

    dots = [n for n, (how, _) in results.items() if how == "dot"]
    joined = {n: "sum" if how == "dot" else how for n, (how, _) in results.items()}
    least = {"sum": 0.0, "min": np.inf, "max": -np.inf}

    def partial(mine: dict[str, np.ndarray], theirs: dict[str, np.ndarray]) -> list[np.ndarray]:
        out = {n: np.full(len(mine["id"]), least[how]) for n, how in joined.items()}
        lines, columns = SPARSE_TILE if isinstance(mine["x"], SparseRows) else TILE
        for b in range(0, len(theirs["id"]), columns):
            part = {c: v[b : b + columns] for c, v in theirs.items()}
            weights = np.stack([np.asarray(results[n][1](part), np.float64) for n in dots], 1) if dots else None
            for a in range(0, len(mine["id"]), lines):
                some = {c: v[a : a + lines] for c, v in mine.items()}
                k = kernel.block(some["x"], part["x"])
                got = dict(zip(dots, (k @ weights).T, strict=True)) if dots else {}
                for n, how in joined.items():
                    value, at = got[n] if n in got else np.asarray(results[n][1](k, some, part), np.float64), slice(a, a + lines)
                    out[n][at] = out[n][at] + value if how == "sum" else (np.minimum if how == "min" else np.maximum)(out[n][at], value)
        return list(out.values())

    def columns_of(batch: pa.RecordBatch | pa.Table, extras: list[str]) -> dict[str, np.ndarray]:
        return {"id": batch.column("id").to_numpy(), "x": matrix(batch.column("x"))} | {c: batch.column(c).to_numpy(zero_copy_only=False) for c in extras}

    theirs = fetched(right, ["x", *extra])
    if theirs is not None:
        shared = left.sparkSession.sparkContext.broadcast(theirs)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    mine = columns_of(batch.slice(at, BLOCK_ROWS), left_extra)
                    yield pa.RecordBatch.from_arrays([pa.array(mine["id"]), *map(pa.array, partial(mine, shared.value))], ["id", *names])

        return left.select("id", "x", *left_extra).mapInArrow(run, schema)

    def cell(mine: pa.Table, other: pa.Table) -> pa.Table:
        # A side without rows comes without columns too.
        theirs, out = columns_of(other, extra) if other.num_rows else {"id": np.zeros(0)}, []
        for at in range(0, mine.num_rows, BLOCK_ROWS):
            some = columns_of(mine.slice(at, BLOCK_ROWS).combine_chunks(), left_extra)
            out.append(pa.table([pa.array(some["id"]), *map(pa.array, partial(some, theirs))], ["id", *names]))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64() if c == "id" else pa.float64()) for c in ["id", *names]})

    parts = _in_cells(left.select("id", "x", *left_extra), right.select("id", "x", *extra), cell, schema)
    return parts.groupBy("id").agg(*(getattr(F, how)(n).alias(n) for n, how in joined.items()))


def _lines(n: int, m: int) -> tuple[int, int]:
    """Lines and columns of the grid in which n rows meet m."""
    side = int(np.ceil(np.sqrt(max(n, m) / BLOCK_ROWS)))
    return tuple(max(1, -(-k // CELL_ROWS), min(side, -(-k // BLOCK_ROWS))) for k in (n, m))


def _in_cells(left: DataFrame, right: DataFrame, f: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """f of each cell's rows of both sides (id, ...)."""
    lines, columns = _lines(left.count(), right.count())
    line, column = F.pmod(F.xxhash64("id"), F.lit(lines)).cast("int"), F.pmod(F.xxhash64("id"), F.lit(columns)).cast("int")
    a = left.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(columns - 1)), lambda k: line * columns + k)))
    b = right.withColumn("cell", F.explode(F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), lambda k: k * columns + column)))
    # Both sides can come from one table; names of their own keep them apart.
    b = b.withColumnsRenamed({c: f"other_{c}" for c in b.columns})
    plain = lambda z: z.rename_columns([c.removeprefix("other_") for c in z.column_names])
    return a.groupBy("cell").cogroup(b.groupBy("other_cell")).applyInArrow(lambda x, z: f(x, plain(z)), schema)


def _without_own(k: np.ndarray, a: dict[str, np.ndarray], b: dict[str, np.ndarray], value: float) -> np.ndarray:
    """The block with ``value`` where a row meets its own id."""
    order = np.argsort(b["id"], kind="stable")
    first, last = (np.searchsorted(b["id"][order], a["id"], side) for side in ("left", "right"))
    for row in np.flatnonzero(first < last):
        k[row, order[first[row] : last[row]]] = value
    return k


def row_sums(df: DataFrame, kernel: Kernel) -> DataFrame:
    """Of each row: the sum of its kernel row, and the largest value against another row (null with no other)."""
    largest = {"largest": ("max", lambda k, a, b: _without_own(k, a, b, -np.inf).max(1))}
    shape = chi_pairs.features(df, kernel)
    if additive.applies(df, kernel):
        most = chi_pairs.largest(df, kernel, shape) if shape else against(df, df, kernel, [], largest)
        out = most.join(additive.sums(df, df, kernel).withColumnRenamed("total", "row_sum"), "id")
    elif chi_pairs.sums_apply(kernel, shape):
        out = chi_pairs.largest(df, kernel, shape).join(chi_pairs.sums(df, kernel, shape), "id")
    else:
        # The sum is taken before own values are marked in the block.
        out = against(df, df, kernel, [], {"row_sum": ("sum", lambda k, a, b: k.sum(1))} | largest)
    out = out.select("id", "row_sum", "largest")
    return out.withColumn("largest", F.when(F.col("largest") > float("-inf"), F.col("largest")))


def q_rows(df: DataFrame, ids: DataFrame, kernel: Kernel) -> DataFrame:
    """(i, id, q) with q = y_i y K(x_i, x) of the rows i in ``ids`` against every row: a broadcast join, one side a few rows."""
    df, sparse = entries(df), is_sparse(df)
    few = df.join(F.broadcast(ids), "id", "left_semi").select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("y").alias("yi"))
    return df.join(F.broadcast(few)).select("i", "id", (F.col("yi") * F.col("y") * kernel.expr(F.col("xi"), F.col("x"), sparse)).alias("q"))


def diagonal(df: DataFrame, kernel: Kernel) -> DataFrame:
    return entries(df).select("id", kernel.expr(F.col("x"), F.col("x"), is_sparse(df)).alias("k"))


def upper_stats(df: DataFrame, kernel: Kernel) -> DataFrame:
    """Count, sum, least and greatest kernel value over pairs i < j: half of what all ordered pairs of different ids give."""
    own = lambda value: lambda k, a, b: _without_own(k, a, b, value)
    # In this order: each marks the places of own values anew.
    out = against(df, df, kernel, [], {
        "total": ("sum", lambda k, a, b: own(0.0)(k, a, b).sum(1)), "low": ("min", lambda k, a, b: own(np.inf)(k, a, b).min(1)), "high": ("max", lambda k, a, b: own(-np.inf)(k, a, b).max(1)),
    })
    found = out.agg(F.sum("total").alias("total"), F.min("low").alias("low"), F.max("high").alias("high"))
    # Pairs by counts of ids, of which few are more than one row's.
    same = df.groupBy("id").agg(F.count(F.lit(1)).alias("c")).agg(F.sum("c").alias("rows"), F.sum(F.col("c") * F.col("c")).alias("own"))
    n = ((F.col("rows") * F.col("rows") - F.col("own")) / 2).cast("long")
    return found.join(F.broadcast(same)).select(F.when(F.col("rows").isNotNull(), n).alias("n"), F.when(F.col("rows").isNotNull(), F.col("total") / 2).alias("total"), "low", "high")


def scores(rows: DataFrame, support: DataFrame, kernel: Kernel, rho: float = 0.0) -> DataFrame:
    """(id, score, pred): sum of alpha y K over support rows (id, x, y, alpha), less rho; a score of zero counts as +1."""
    weight = F.col("alpha") * F.col("y")
    if additive.applies(rows, kernel) and additive.applies(support, kernel):
        out = additive.sums(rows, support.withColumn("w", weight), kernel, "w").withColumnRenamed("total", "score")
    elif isinstance(kernel, Kernel) and kernel.name == "expchi2" and chi_pairs.sums_apply(kernel, shape := chi_pairs.features(rows, kernel)) and (
        whole := chi_pairs.as_weights(rows, support.select("id", "x", weight.alias("weight")), shape.rows)
    ) is not None:
        out = chi_pairs.sums(whole, kernel, shape).withColumnRenamed("row_sum", "score")
    else:
        out = against(rows, support, kernel, ["y", "alpha"], {"score": ("dot", lambda b: b["alpha"] * b["y"])})
    score = F.col("score") - rho
    return out.select("id", score.alias("score"), F.when(score < 0, -1).otherwise(1).alias("pred"))


def most_similar(df: DataFrame, kernel: Kernel, n: int) -> DataFrame:
    """(id, rank, other, k): the n other rows with the greatest kernel value, ties by smaller id; n kept per row and cell, then per row."""
    theirs = fetched(df, ["x"])

    names = ["id", "other", "k"]

    def top(mine_id: np.ndarray, mine_x: np.ndarray | SparseRows, ids: np.ndarray, x: np.ndarray | SparseRows) -> pa.Table:
        """The best of all given rows: blocks hand on what is among the n best so far, ties at the last place included."""
        lines, columns = SPARSE_TILE if isinstance(mine_x, SparseRows) else TILE
        found = []
        for a in range(0, len(mine_id), lines):
            mine = {"id": mine_id[a : a + lines]}
            floor, rows, others, values = np.full(len(mine["id"]), -np.inf), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
            for b in range(0, len(ids), columns):
                theirs = {"id": ids[b : b + columns]}
                k = _without_own(kernel.block(mine_x[a : a + lines], x[b : b + columns]), mine, theirs, -np.inf)
                # A value that rounds below the n-th of those before, or of its own block, can't be among the best.
                least = np.maximum(floor, np.partition(k, k.shape[1] - n, 1)[:, k.shape[1] - n]) if k.shape[1] >= n and np.isinf(floor).any() else floor
                row, column = np.nonzero(k > (least - 1e-9)[:, None])
                value = k[row, column]
                row, other, value = np.concatenate([rows, row]), np.concatenate([others, theirs["id"][column]]), np.concatenate([values, value])
                row, other, value = row[value > -np.inf], other[value > -np.inf], value[value > -np.inf]
                order = np.lexsort((other, -np.round(value, 9), row))
                row, other, value = row[order], other[order], value[order]
                keep = np.arange(len(row)) - np.searchsorted(row, row) < n
                rows, others, values = row[keep], other[keep], value[keep]
                last = np.searchsorted(rows, np.arange(len(floor)), "right") - 1
                full = np.bincount(rows, minlength=len(floor)) == n
                floor[full] = np.round(values[last[full]], 9)
            found.append(pa.RecordBatch.from_arrays([pa.array(mine["id"][rows]), pa.array(others), pa.array(values)], names))
        return pa.Table.from_batches(found, pa.schema([("id", pa.int64()), ("other", pa.int64()), ("k", pa.float64())])).combine_chunks()

    if theirs is None:
        # In cells, as in ``against``: each gives n rows per row, and the best of all are taken after.
        def cell(mine: pa.Table, other: pa.Table) -> pa.Table:
            if not mine.num_rows or not other.num_rows:
                return pa.table({c: pa.array([], pa.float64() if c == "k" else pa.int64()) for c in names})
            return top(mine.column("id").to_numpy(), matrix(mine.column("x")), other.column("id").to_numpy(), matrix(other.column("x")))

        rows = df.select("id", "x")
        return topn(_in_cells(rows, rows, cell, "id long, other long, k double"), "id", n)
    shared = df.sparkSession.sparkContext.broadcast(theirs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            if batch.num_rows:
                yield from top(batch.column(0).to_numpy(), matrix(batch.column(1)), t["id"], t["x"]).to_batches()

    return topn(df.select("id", "x").mapInArrow(run, "id long, other long, k double"), "id", n)


def topn(df: DataFrame, key: str, n: int, value: str = "k", tie: str = "other") -> DataFrame:
    """The n rows of each key with the greatest value, ties by smaller ``tie``, with their rank."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(F.desc(F.round(value, 9)), tie)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
