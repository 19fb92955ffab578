"""Sums of chi-square kernels over all rows of a table, in time that is linear in both tables.

u v / (u + v) is added over features, so the weighted sum over all rows of a table
is, for each feature, one function of the value u alone.  In the logarithm of u it
is smooth on the whole line, whatever the rows: its nearest poles lie pi off the
real axis.  Over two octaves, ``NODES`` Chebyshev points therefore give it to the
last places of a double: one pass over the rows sums it at the points of all
octaves that occur, another takes each value from its own octaves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Kernel
from ..functions.sparse import matrix
from ..functions.vectors import is_sparse

#: Octaves of a cell and points in it: the error falls by 9 with each point, to 1e-19 of the largest value.
OCTAVES, NODES = 2, 20
#: Values of a feature by points that are summed at a time.
TILE = 1 << 15


def applies(df: DataFrame, kernel: object) -> bool:
    """Whether sums of the kernel over rows like these go feature by feature."""
    kind = df.schema["x"].dataType.simpleString()
    return isinstance(kernel, Kernel) and kernel.name in ("chi2", "nchi2") and not is_sparse(df) and kind == "array<double>"


def _cells(x: np.ndarray) -> np.ndarray:
    """The cell of each value; where the value is 0 the cell has no meaning."""
    return np.frexp(x)[1] // OCTAVES


def _points(cell: int) -> np.ndarray:
    """Chebyshev points of a cell, between 2**(cell * OCTAVES - 1) and OCTAVES octaves more."""
    at = np.cos(np.pi * (np.arange(NODES) + 0.5) / NODES)
    return np.exp2(cell * OCTAVES - 1 + OCTAVES * (at + 1) / 2)


def _checked(x: np.ndarray) -> np.ndarray:
    if x.min(initial=0) < 0:
        raise ValueError("chi-square kernels are for values of 0 or more")
    return x


def sums(left: DataFrame, right: DataFrame, kernel: Kernel, weight: str | None = None) -> DataFrame:
    """(id, total): of each row of ``left`` (id, x), the sum over ``right`` (x, and the column ``weight``) of weight times the kernel.

    Only what each feature sums to at its points is on the driver and the workers:
    features times occurring octaves, whatever the rows.
    """

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(0, np.int64)
        for batch in batches:
            x = _checked(matrix(batch.column(0)))
            k, cell = np.nonzero(x)[1], _cells(x)[x != 0]
            found = np.union1d(found, k * (1 << 16) + cell + (1 << 15))
        yield pa.RecordBatch.from_arrays([pa.array(found)], ["at"])

    known = np.array(sorted(r.at for r in left.select("x").mapInArrow(seen, "at long").distinct().collect()), np.int64)
    feature, cell = known >> 16, (known & 0xFFFF) - (1 << 15)
    first = np.flatnonzero(np.diff(feature, prepend=-1))
    spans = [(int(feature[a]), a, b) for a, b in zip(first, [*first[1:], len(known)][: len(first)], strict=True)]
    points = np.concatenate([_points(int(c)) for c in cell]) if len(known) else np.zeros(0)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # At the end: the weights, and the weighted sums of values.
        out = np.zeros(len(points) + 2)
        for batch in batches:
            x = _checked(matrix(batch.column(0)))
            w = batch.column(1).to_numpy(zero_copy_only=False).astype(np.float64) if weight else np.ones(len(x))
            out[-2:] += w.sum(), float(w @ x.sum(1)) if len(x) else 0.0
            for k, a, b in spans if len(x) else ():
                t = points[a * NODES : b * NODES]
                use = np.flatnonzero(x[:, k])
                v, weigh = x[use, k], w[use]
                step = max(1, TILE // len(t))
                for r in range(0, len(v), step):
                    total = v[r : r + step, None] + t
                    np.divide(v[r : r + step, None], total, out=total)
                    out[a * NODES : b * NODES] += weigh[r : r + step] @ total
        out[:-2] *= points
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(out))), pa.array(out)], ["at", "value"])

    columns = ["x", *([weight] if weight else [])]
    table = right.select(*columns).mapInArrow(summed, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    values = np.zeros(len(points) + 2)
    values[table.column("at").to_numpy()] = table.column("value").to_numpy()
    weights, weighted = values[-2:]
    # Coefficients of Chebyshev polynomials, by cell.
    turn = np.cos(np.pi * np.outer(np.arange(NODES), np.arange(NODES) + 0.5) / NODES) * np.where(np.arange(NODES) == 0, 1, 2)[:, None] / NODES
    shared = left.sparkSession.sparkContext.broadcast((known, values[:-2].reshape(-1, NODES) @ turn.T))

    def taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, curves = shared.value
        for batch in batches:
            x = _checked(matrix(batch.column(1)))
            out = np.zeros(len(x))
            for k in range(x.shape[1]):
                use = np.flatnonzero(x[:, k])
                u = x[use, k]
                own = _cells(u)
                c = curves[np.searchsorted(places, k * (1 << 16) + own + (1 << 15))]
                at = 2 * (np.log2(u) - (own * OCTAVES - 1)) / OCTAVES - 1
                one, two = np.zeros(len(u)), np.zeros(len(u))
                for n in range(NODES - 1, 0, -1):
                    one, two = c[:, n] + 2 * at * one - two, one
                out[use] += c[:, 0] + at * one - two
            if kernel.name == "chi2":
                # 1 - distance / 2, the distance being u + v - 4 u v / (u + v).
                own = x.sum(1) if len(x) else np.zeros(0)
                out = weights - 0.5 * (weights * own + weighted) + 2 * out
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], ["id", "total"])

    return left.select("id", "x").mapInArrow(taken, "id long, total double")
