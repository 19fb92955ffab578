"""Blocks of sparse vectors: rows of (index from 1, value), and what kernels and linear solvers take from them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pairs of entries that are multiplied at a time.
PAIRS = 1 << 19
#: Common columns up to which products go through dense blocks.
DENSE_COLUMNS = 4096
#: Cells of a dense block that cost about what one pair of entries does.
DENSE_CELLS = 16


def _summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(at, values, n).astype(np.float64, copy=False)


@dataclass
class SparseRows:
    """Row i has the entries ptr[i] to ptr[i + 1]; indices of a row differ."""

    ptr: np.ndarray
    idx: np.ndarray
    val: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> SparseRows:
        """From arrays of structs (idx, val) or maps from index to value; a null row is empty, and so are null values."""
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        rows = column.to_numpy(zero_copy_only=False) if not len(column) else None
        if rows is not None:
            return cls(np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0))
        valid = np.asarray(column.is_valid())
        start = np.asarray(column.offsets)[:-1].astype(np.int64)
        size = np.where(valid, np.diff(np.asarray(column.offsets)), 0)
        idx, val = (column.keys, column.items) if pa.types.is_map(column.type) else (column.values.field("idx"), column.values.field("val"))
        ptr = np.concatenate(([0], np.cumsum(size)))
        at = np.repeat(start - ptr[:-1], size) + np.arange(ptr[-1])
        idx, val = idx.to_numpy(zero_copy_only=False)[at].astype(np.int64), val.to_numpy(zero_copy_only=False)[at].astype(np.float64)
        return cls(ptr, idx, np.nan_to_num(val, nan=0.0))

    def __len__(self) -> int:
        return len(self.ptr) - 1

    def __getitem__(self, rows: slice | np.ndarray) -> SparseRows:
        """The rows of a slice, a mask, or a list of places."""
        at = np.arange(len(self))[rows]
        size = np.diff(self.ptr)[at]
        ptr = np.concatenate(([0], np.cumsum(size)))
        entry = np.repeat(self.ptr[at] - ptr[:-1], size) + np.arange(ptr[-1])
        return SparseRows(ptr, self.idx[entry], self.val[entry])

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self)), np.diff(self.ptr))

    def sums(self) -> np.ndarray:
        return _summed(self.row, self.val, len(self))

    def squares(self) -> np.ndarray:
        return _summed(self.row, self.val**2, len(self))

    def times(self, w: np.ndarray) -> np.ndarray:
        """Products with a vector, or with the columns of a matrix, by feature; features beyond it are dropped."""
        use = self.idx <= len(w)
        row, at, val = self.row[use], self.idx[use] - 1, self.val[use]
        if w.ndim == 1:
            return _summed(row, val * w[at], len(self))
        return np.stack([_summed(row, val * w[at, k], len(self)) for k in range(w.shape[1])], 1)

    def weighted(self, v: np.ndarray, dim: int) -> np.ndarray:
        """Sum of the rows times v, or times each column of v, as dense vectors by feature."""
        use = self.idx <= dim
        row, at, val = self.row[use], self.idx[use] - 1, self.val[use]
        if v.ndim == 1:
            return _summed(at, val * v[row], dim)
        return np.stack([_summed(at, val * v[row, k], dim) for k in range(v.shape[1])], 1)

    def dense(self, dim: int) -> np.ndarray:
        out = np.zeros((len(self), dim))
        use = self.idx <= dim
        out[self.row[use], self.idx[use] - 1] = self.val[use]
        return out

    def common(self, other: SparseRows, f: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """Sums of f(u, v), by default of u v, over the features that a row of each side has."""
        n, m = len(self), len(other)
        both = np.intersect1d(self.idx, other.idx)
        mine, theirs = (self._by_column(both), other._by_column(both))
        if f is None and len(both) <= DENSE_COLUMNS:
            x, z = np.zeros((n, len(both))), np.zeros((m, len(both)))
            x[mine[0], mine[1]], z[theirs[0], theirs[1]] = mine[2], theirs[2]
            return x @ z.T
        out = np.zeros(n * m)
        count = np.bincount(theirs[1], minlength=len(both))
        first = np.cumsum(count) - count
        # Each entry of mine meets every entry of its column on the other side.
        times = count[mine[1]]
        total = np.concatenate(([0], np.cumsum(times)))
        a = 0
        while a < len(times):
            b = max(a + 1, int(np.searchsorted(total, total[a] + max(PAIRS, n * m), "right")) - 1)
            left = np.repeat(np.arange(a, b), times[a:b])
            right = first[mine[1][left]] + np.arange(len(left)) - np.repeat(total[a:b] - total[a], times[a:b])
            u, v = mine[2][left], theirs[2][right]
            out += np.bincount(mine[0][left] * m + theirs[0][right], u * v if f is None else f(u, v), n * m)
            a = b
        return out.reshape(n, m)

    def dense_common(self, other: SparseRows) -> tuple[np.ndarray, np.ndarray] | None:
        """Both sides as dense rows of the features that both have, where that costs less than the pairs of their entries."""
        both = np.intersect1d(self.idx, other.idx)
        if not 0 < len(both) <= DENSE_COLUMNS:
            return None
        mine, theirs = self._by_column(both), other._by_column(both)
        pairs = np.bincount(mine[1], minlength=len(both)) @ np.bincount(theirs[1], minlength=len(both))
        if len(self) * len(other) * len(both) > DENSE_CELLS * pairs:
            return None
        x, z = np.zeros((len(self), len(both))), np.zeros((len(other), len(both)))
        x[mine[0], mine[1]], z[theirs[0], theirs[1]] = mine[2], theirs[2]
        return x, z

    def _by_column(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, number of the column, value) of the entries in ``columns``, column by column."""
        at = np.searchsorted(columns, self.idx)
        at[at == len(columns)] = 0
        use = np.flatnonzero(columns[at] == self.idx) if len(columns) else np.zeros(0, np.int64)
        use = use[np.argsort(at[use], kind="stable")]
        return self.row[use], at[use], self.val[use]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray | SparseRows:
    """Rows of a column of vectors: arrays of doubles of equal lengths, sparse rows of (idx, val) structs or maps, or matrices
    (arrays of arrays of doubles) of one shape, row by row."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if pa.types.is_list(getattr(column.type, "value_type", pa.null())):
        return _matrices(column)
    if pa.types.is_map(column.type) or pa.types.is_struct(getattr(column.type, "value_type", pa.null())):
        return SparseRows.of(column)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _matrices(column: pa.Array) -> np.ndarray:
    if not len(column):
        return np.zeros((0, 0))
    lines = column.flatten()
    # Lengths of a null matrix or line are null, which no shape has.
    heights, widths = pc.list_value_length(column), pc.list_value_length(lines)
    shapes = {*pc.unique(heights).to_pylist()}, {*pc.unique(widths).to_pylist()}
    if any(len(s) > 1 or None in s for s in shapes):
        raise ValueError(f"matrices of one shape are asked for, with no null among them; these have {sorted(shapes[0], key=str)} lines of {sorted(shapes[1], key=str)} values")
    return lines.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def stacked(parts: list) -> np.ndarray | SparseRows:
    """Blocks of rows below each other."""
    if not isinstance(parts[0], SparseRows):
        return np.concatenate(parts)
    ptr = np.concatenate([[0], *[p.ptr[1:] + o for p, o in zip(parts, np.cumsum([0, *[p.ptr[-1] for p in parts[:-1]]]), strict=True)]])
    return SparseRows(ptr, np.concatenate([p.idx for p in parts]), np.concatenate([p.val for p in parts]))
