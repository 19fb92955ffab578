"""Covariance of a table's vectors, the Mahalanobis kernel that it gives, and whitening.

Sums are taken partition by partition, first of the rows and then of products of
centred ones, so that only two vectors and a matrix as wide as the features reach
the driver; ``MOST`` bounds that width.  Rows are dense or sparse.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Mahalanobis
from ..functions.sparse import SparseRows, matrix
from .linear import _summed

#: Features up to which a covariance is held (8 bytes a pair).
MOST = 4096


def _rows(x: np.ndarray | SparseRows, dim: int) -> np.ndarray:
    if isinstance(x, SparseRows):
        return x.dense(dim)
    return x[:, :dim] if x.shape[1] >= dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def covariance(df: DataFrame, dim: int, ridge: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """(mean, sample covariance with ``ridge`` on its diagonal) of df (x); features beyond ``dim`` are dropped.

    Null vectors count as none.  With fewer than two rows the covariance is the ridge alone.
    """
    if dim > MOST:
        raise ValueError(f"a covariance of {dim} features is not held; {MOST} are the most")
    rows = df.where("x is not null").select("x")
    total = _summed(rows, lambda x: np.append(_rows(x, dim).sum(0), len(x)), dim + 1)
    n = int(total[-1])
    mean = total[:dim] / max(n, 1)

    def products(x: np.ndarray | SparseRows) -> np.ndarray:
        d = _rows(x, dim) - mean
        return (d.T @ d).ravel()

    second = _summed(rows, products, dim * dim).reshape(dim, dim) if n > 1 else np.zeros((dim, dim))
    return mean, second / max(n - 1, 1) + ridge * np.eye(dim)


def fitted(df: DataFrame, dim: int, ridge: float = 1e-6) -> Mahalanobis:
    """The kernel x' M z with M the inverse of the table's covariance; ``ridge`` keeps constant features from ruling it."""
    inverse = np.linalg.inv(covariance(df, dim, ridge)[1])
    return Mahalanobis(tuple(map(tuple, (inverse + inverse.T) / 2)))


def whitened(df: DataFrame, kernel: Mahalanobis) -> DataFrame:
    """df with x as dense vectors whose linear kernel is ``kernel`` of the rows before, so that linear solvers train with it.

    By Cholesky's method M = L L', and x becomes L' x.
    """
    root = np.linalg.cholesky(np.array(kernel.inverse))
    names, at, dim = df.columns, df.columns.index("x"), len(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            x = _rows(matrix(columns[at]), dim) @ root if batch.num_rows else np.zeros((0, dim))
            columns[at] = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(run, df.withColumn("x", F.lit(None).cast("array<double>")).schema)
