"""Largest chi-square kernel values and sums of exponential ones: every pair is met as a product of short vectors, few by themselves.

u v / (u + v) is a positive kernel of two numbers.  On some values (``nodes``) it
gives functions of u whose products are its projection, so what a projection to
a few of them leaves out is positive too, and by Cauchy-Schwarz at most the root of
what it leaves out of both rows' own values, which each row knows.  A product of
matrices thus bounds all pairs of a block; pairs whose bound reaches a row's best
are taken exactly.  Both orders of a pair are one: cells of the grid above its
diagonal serve the rows of both their sides.

Sums of exp(-gamma distance) are split.  With y = 4 gamma times the pair's common
part less both rows' means, the kernel is a factor of each row times exp(y), and
the sums of 1 + y + y**2 / 2 need no pairs: the second is ``additive``'s, the third a
quadratic form in the features.  What is left is about y**3 / 6, so small that
products in single precision give it to the last places of the sum; pairs beyond
``FAR``, as rows and their copies are, are taken exactly.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import TINY, Kernel
from ..functions.sparse import matrix
from ..functions.vectors import is_sparse
from ..sources.tables import stored
from . import additive

#: Values at which the kernel is taken, and the part of the greatest value that they go down to.
NODES, LEAST = 48, 1e-8
#: Functions of each feature that bound a pair.
BOUND_RANK = 2
#: Functions of each feature in the quadratic form of sums, and in the products of pairs; pairs with a greater y are taken exactly.
FORM_RANK, SUM_RANK, FAR = 20, 12, 0.125
#: Tables of fewer rows go by blocks of plain values, to their last place.
LEAST_SUM_ROWS = 1 << 14
#: Part of the rows that have weights, at least, for weighted sums to be split.
LEAST_PART = 8
#: Features of rows whose sums are split, at most: the quadratic form has FORM_RANK times as many lines and columns.
MOST_WIDTH = 128
#: Rows and columns of a block of bounds, pairs that are taken exactly at a time, and noted ones that are.
BLOCK, PAIRS, NOTED = 512, 1 << 11, 1 << 18
#: Rows of a line of the grid: so many lines as the square root of the table's part of the first, each of the second at most.
LINE_ROWS, MOST_LINE_ROWS = 2048, 1 << 16
#: Counted bins to an octave, and the bin that stands for values that no bound holds for.
BINS, OTHER = 4, 1 << 20


@dataclass(frozen=True)
class Features:
    """Functions of a value whose products give u v / (u + v), the weightiest first: ``turn`` times its kernel with ``nodes``."""

    nodes: np.ndarray
    turn: np.ndarray
    rows: int
    largest_sum: float
    width: int = 1

    def of(self, x: np.ndarray, rank: int) -> np.ndarray:
        """The first ``rank`` functions of each value of each row, side by side."""
        out = np.empty((len(x), x.shape[1], rank))
        for k in range(x.shape[1]):
            u = x[:, k, None]
            out[:, k] = (u * (self.nodes / (u + self.nodes))) @ self.turn[:, :rank]
        return out.reshape(len(x), -1)


def features(df: DataFrame, kernel: object) -> Features | None:
    """Functions that fit the values of a table (id, x), from their counts by quarters of octaves; None if its pairs have no bounds."""
    if not isinstance(kernel, Kernel) or not kernel.histogram or is_sparse(df) or df.schema["x"].dataType.simpleString() != "array<double>":
        return None

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0))
            if not x.size:
                continue
            # A comparison with NaN is false.
            fits = np.isfinite(x).all() and x.min() >= 0 and x.max() < 1e100
            bins, n = np.unique(np.floor(np.log2(x[x > 0]) * BINS), return_counts=True) if fits else (np.array([OTHER]), np.array([1]))
            # The last line is of the rows.
            bins, n = np.append(bins, -OTHER).astype(np.int64), np.append(n, len(x))
            yield pa.RecordBatch.from_arrays([pa.array(bins), pa.array(n), pa.array(np.full(len(n), x.sum(1).max())), pa.array(np.full(len(n), x.shape[1]))], ["at", "n", "largest", "width"])

    found = df.select("x").mapInArrow(seen, "at long, n long, largest double, width long").groupBy("at").agg(F.sum("n").alias("n"), F.max("largest").alias("largest"), F.max("width").alias("width")).toArrow().sort_by("at")
    at, n = found.column("at").to_numpy(), found.column("n").to_numpy()
    # Below, products of values could be lost.
    if len(at) < 2 or at[-1] == OTHER or at[-1] < -300 * BINS:
        return None
    return Features(*fitted(at[1:], n[1:]), int(n[0]), *(pc.max(found.column(c)).as_py() for c in ("largest", "width")))


def fitted(at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes and turn for n values in each bin."""
    top = np.exp2((at[-1] + 1) / BINS)
    nodes = np.geomspace(top * LEAST, top, NODES)
    length, axis = np.linalg.eigh(nodes[:, None] * (nodes / (nodes[:, None] + nodes)))
    keep = length > length[-1] * 1e-15
    whole = axis[:, keep] / np.sqrt(length[keep])
    u = np.exp2((at[:, None] + 0.5) / BINS)
    seen_at = (u * (nodes / (u + nodes))) @ whole
    return nodes, whole @ np.linalg.eigh((seen_at * n[:, None]).T @ seen_at)[1][:, ::-1]


def in_triangle(df: DataFrame, rows: int, f: Callable[[pa.Table, pa.Table | None], pa.Table], schema: str) -> DataFrame:
    """f of the rows of each two lines of a grid, and of each line with None: every two rows of df meet once."""
    lines = max(1, int(np.ceil(np.sqrt(rows / LINE_ROWS))), -(-rows // MOST_LINE_ROWS))
    line = F.pmod(F.xxhash64("id"), F.lit(lines)).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.lit(lines - 1)), lambda k: F.least(F.col("line"), k) * lines + F.greatest(F.col("line"), k))

    def cell(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        one, other = divmod(key[0].as_py(), lines)
        mine, plain = table.column("line").to_numpy(), table.drop_columns(["line", "cell"])
        if one == other:
            return f(plain.combine_chunks(), None)
        return f(*(plain.take(pa.array(np.flatnonzero(mine == k))).combine_chunks() for k in (one, other)))

    # A number of partitions of their own, as cells are long tasks of few bytes.
    return df.withColumn("line", line).withColumn("cell", F.explode(cells)).repartition(2 * lines * (lines + 1), "cell").groupBy("cell").applyInArrow(cell, schema)


def blocks(n: int, m: int | None) -> Iterator[tuple[slice, slice]]:
    """Blocks of n rows against m others, or of n rows among themselves: those above the diagonal, and on it."""
    for a in range(0, n, BLOCK):
        for b in range(a if m is None else 0, n if m is None else m, BLOCK):
            yield slice(a, min(a + BLOCK, n)), slice(b, min(b + BLOCK, n if m is None else m))


def common_of_pairs(x: np.ndarray, z: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sum over features of u v / (u + v) of rows i of x and rows j of z, pair by pair."""
    out = np.empty(len(i))
    for a in range(0, len(i), PAIRS):
        u, v = x[i[a : a + PAIRS]], z[j[a : a + PAIRS]]
        out[a : a + PAIRS] = (u * v / (u + v + TINY)).sum(1)
    return out


class _Side:
    """Rows of a cell, with what is known of the largest value of each: in units of u v / (u + v), less the rows' own parts."""

    def __init__(self, table: pa.Table, shape: Features, shifted: bool):
        self.id, self.x = table.column("id").to_numpy(), matrix(table.column("x"))
        n = len(self.id)
        self.sums = self.x.sum(1)
        self.shift = self.sums / 4 if shifted else np.zeros(n)
        f, square = np.empty((n, self.x.shape[1] * BOUND_RANK), np.float32), np.empty(n)
        for a in range(0, n, BLOCK):
            part = f[a : a + BLOCK] = shape.of(self.x[a : a + BLOCK], BOUND_RANK)
            square[a : a + BLOCK] = (part * part).sum(1)
        # What single precision can lose grows with the length of a product.
        lost = (f.shape[1] + 8) * 2.0**-22 * (square + 1 + self.shift**2)
        self.error = np.sqrt(np.maximum(self.sums / 2 - square, 0) + lost)
        e, shift, one = (v.astype(np.float32)[:, None] for v in (self.error, -self.shift, np.ones(n)))
        self.left, self.right = np.hstack([f, e, shift, one]), np.hstack([f, e, one, shift])
        self.low, self.best, self.pending, self.waiting = np.full(n, -np.inf), np.full(n, -np.inf), [], 0

    def take(self, at: slice, other: _Side, theirs: slice, bound: np.ndarray, top: np.ndarray) -> None:
        """Notes the pairs of a block of bounds (own rows by those of ``other``) that may be a row's largest; ``top`` is the block's by row."""
        low = self.low[at] = np.maximum(self.low[at], top - 2 * self.error[at] * other.error[theirs].max())
        rows = np.flatnonzero((top >= low) & (top > -np.inf))
        if not len(rows):
            return
        some = bound[rows]
        i, j = np.nonzero(some >= np.maximum(low[rows], np.finfo(np.float32).min)[:, None])
        self.pending.append((rows[i] + at.start, j + theirs.start, some[i, j]))
        self.waiting += len(i)
        if self.waiting > NOTED:
            self.settle(other)

    def settle(self, other: _Side) -> None:
        """Takes the noted pairs exactly."""
        if self.pending:
            i, j, bound = (np.concatenate(c) for c in zip(*self.pending, strict=True))
            keep = bound >= self.low[i]
            i, j = i[keep], j[keep]
            np.maximum.at(self.best, i, common_of_pairs(self.x, other.x, i, j) - self.shift[i] - other.shift[j])
            self.pending, self.waiting = [], 0
        self.low = np.maximum(self.low, self.best)
        # No value is above su sv / (su + sv): rows that have it, as copies do, look no further.
        s, t = self.sums, other.sums.max(initial=0)
        most = np.zeros(len(s)) if self.shift.any() else s * (t / (s + t + TINY))
        self.low[self.best >= most - 1e-14 * s] = np.inf


def largest(df: DataFrame, kernel: Kernel, shape: Features) -> DataFrame:
    """(id, largest): of each row of df (id, x) the largest kernel value against a row of another id, -inf with none."""
    from .gram import _without_own

    names, shifted = ["id", "largest"], kernel.name != "nchi2"

    def cell(one: pa.Table, other: pa.Table | None) -> pa.Table:
        if not one.num_rows or (other is not None and not other.num_rows):
            return pa.table({"id": pa.array([], pa.int64()), "largest": pa.array([], pa.float64())})
        own = other is None
        x = _Side(one, shape, shifted)
        z = x if own else _Side(other, shape, shifted)
        for a, b in blocks(len(x.id), None if own else len(z.id)):
            bound = x.left[a] @ z.right[b].T
            if own:
                bound = _without_own(bound, {"id": x.id[a]}, {"id": z.id[b]}, -np.inf)
            x.take(a, z, b, bound, bound.max(1).astype(np.float64))
            if not own or a != b:
                z.take(b, x, a, bound.T, bound.max(0).astype(np.float64))
        x.settle(z)
        if not own:
            z.settle(x)
        sides = [x] if own else [x, z]
        best = np.concatenate([s.best for s in sides])
        if kernel.name != "nchi2":
            best = 1 + 2 * best if kernel.name == "chi2" else np.where(best > -np.inf, np.exp(4 * kernel.gamma * best), -np.inf)
        return pa.table([pa.array(np.concatenate([s.id for s in sides])), pa.array(best)], names)

    return in_triangle(df.select("id", "x"), shape.rows, cell, "id long, largest double").groupBy("id").agg(F.max("largest").alias("largest"))


def sums_apply(kernel: Kernel, shape: Features | None) -> bool:
    """Whether sums of the exponential kernel over a table of this shape are split; y is below 1 then."""
    return shape is not None and kernel.name == "expchi2" and shape.rows >= LEAST_SUM_ROWS and shape.width <= MOST_WIDTH and 0 < 2 * kernel.gamma * shape.largest_sum <= 1 + 1e-9


def as_weights(rows: DataFrame, support: DataFrame, n: int) -> DataFrame | None:
    """The n rows (id, x) with ``weight``: that of the support row (id, x, weight) of the id, else 0; None if support rows are not among the
    rows, each once, or so few that plain values take less time."""
    if (size := support.count()) * LEAST_PART < n:
        return None
    given = support.select("id", F.col("x").alias("z"), "weight")
    out = stored(rows.select("id", "x").join(given, "id", "left").select("id", "x", F.when(F.col("z").isNull(), 0.0).otherwise(F.col("weight")).alias("weight"), F.col("z").isNotNull().alias("met"), F.coalesce(F.col("x") == F.col("z"), F.lit(True)).alias("same")), "chi-weights")
    seen = out.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("met"), 1)).alias("met"), F.min("same").alias("same"))
    found = seen.agg(F.max("n").alias("n"), F.sum("met").alias("met"), F.min("same").alias("same")).first()
    return out.select("id", "x", "weight") if found.n == 1 and found.same and found.met == size else None


def _added(df: DataFrame, f: Callable[[np.ndarray, np.ndarray], np.ndarray], lines: int) -> np.ndarray:
    """The sum over batches of rows x, with their weights, of f(x, weight), a matrix of so many lines whatever the rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            for a in range(0, batch.num_rows, LINE_ROWS):
                part = f(matrix(batch.column(0).slice(a, LINE_ROWS)), batch.column(1).slice(a, LINE_ROWS).to_numpy())
                out = part if out is None else out + part
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(lines)), pa.array(list(out))], ["at", "value"])

    def total(table: pa.Table) -> pa.Table:
        return pa.table([table.column("at").slice(0, 1), pa.array([matrix(table.column("value")).sum(0)])], ["at", "value"])

    schema = "at long, value array<double>"
    return matrix(df.select("x", "weight").mapInArrow(run, schema).groupBy("at").applyInArrow(total, schema).toArrow().sort_by("at").column("value"))


def sums(df: DataFrame, kernel: Kernel, shape: Features) -> DataFrame:
    """(id, row_sum): of each row of df (id, x) the sum of its exponential kernel with all rows, times their ``weight`` if there is one; see
    ``sums_apply``."""
    rank, gamma = FORM_RANK, kernel.gamma
    df = df.select("id", "x", F.col("weight").cast("double").alias("weight") if "weight" in df.columns else F.lit(1.0).alias("weight"))
    mean = _added(df, lambda x, _: shape.of(x, rank).sum(0)[None], 1)[0] / shape.rows
    middle, low_mean = mean @ mean, mean.reshape(-1, rank)[:, :SUM_RANK].ravel()

    def parts(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Features less their mean, the rows' means of common parts, and the rows' factors."""
        f = shape.of(x, rank)
        t = f @ mean
        return f - mean, t, np.exp(4 * gamma * (t - middle / 2) - gamma * x.sum(1))

    def form_of(x: np.ndarray, weight: np.ndarray) -> np.ndarray:
        # The last line: the sums of factors, and of factors times means.
        f, t, w = parts(x)
        w = w * weight
        return np.vstack([(f * w[:, None]).T @ f, np.concatenate([[w.sum(), w @ t], np.zeros(f.shape[1] - 2)])])

    form = _added(df, form_of, len(mean) + 1)
    (weights, means), form = form[-1, :2], form[:-1]
    shared = df.sparkSession.sparkContext.broadcast(form)

    def weighed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(1))
            found = [np.zeros((0, 3))]
            for a in range(0, len(x), LINE_ROWS):
                f, t, w = parts(x[a : a + LINE_ROWS])
                # Of the sum, what the row's own means and the quadratic form give.
                rest = weights + 4 * gamma * (middle * weights - t * weights - means) + 8 * gamma**2 * ((f @ shared.value) * f).sum(1)
                found.append(np.stack([w, rest, t], 1))
            w, rest, t = np.concatenate(found).T
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (w, w * batch.column(2).to_numpy(), rest, t))], ["id", "x", "own", "w", "rest", "t"])

    def cell(one: pa.Table, other: pa.Table | None) -> pa.Table:
        sides = []
        for table in [one] if other is None else [one, other]:
            x, n = matrix(table.column("x")), table.num_rows
            f = np.empty((n, len(low_mean) if n else 0), np.float32)
            for a in range(0, n, BLOCK):
                f[a : a + BLOCK] = (shape.of(x[a : a + BLOCK], SUM_RANK) - low_mean) * np.sqrt(4 * gamma)
            w = table.column("w").to_numpy()
            sides.append((x, f, table.column("t").to_numpy(), w, w.astype(np.float32), np.zeros(n)))
        (x, f, t, w, w_low, out), (z, g, s, v, v_low, back) = sides[0], sides[-1]
        for a, b in blocks(len(x), None if other is None else len(z)) if len(x) and len(z) else ():
            y = f[a] @ g[b].T
            i, j = np.nonzero(np.abs(y) > FAR)
            left = y * np.float32(1 / 720)
            for c in (1 / 120, 1 / 24, 1 / 6):
                left += np.float32(c)
                left *= y
            left *= y
            left *= y
            left[i, j] = 0
            far = np.zeros(0)
            if len(i):
                far = 4 * gamma * (common_of_pairs(x[a], z[b], i, j) - t[a][i] - s[b][j] + middle)
                far = np.expm1(far) - far - far * far / 2
            out[a] += left @ v_low[b] + np.bincount(i, far * v[b][j], len(y))
            if other is not None or a != b:
                back[b] += w_low[a] @ left + np.bincount(j, far * w[a][i], y.shape[1])
        tables = [one] if other is None else [one, other]
        return pa.table([pa.array(np.concatenate([q.column("id").to_numpy() for q in tables])), pa.array(np.concatenate([q[5] for q in sides]))], ["id", "left"])

    rows = stored(df.mapInArrow(weighed, "id long, x array<double>, own double, w double, rest double, t double"), "chi-sums")
    left = in_triangle(rows.select("id", "x", "w", "t"), shape.rows, cell, "id long, left double").groupBy("id").agg(F.sum("left").alias("left"))
    line = additive.sums(rows, rows, Kernel("nchi2"), "w")
    return rows.select("id", "own", "rest").join(line, "id").join(left, "id").select("id", (F.col("own") * (F.col("rest") + 4 * gamma * F.col("total") + F.col("left"))).alias("row_sum"))
