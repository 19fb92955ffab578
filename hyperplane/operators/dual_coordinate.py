"""Linear classifiers by dual coordinate descent over partitions, with the dual variables as a table.

The dual: minimise |w|**2 / 2 + sum D_i a_i**2 / 2 - sum a_i with w = sum a_i y_i
x_i and 0 <= a_i <= U_i; for the squared hinge D_i = 1 / (2 C_i) without an upper
bound, for the hinge D_i = 0 and U_i = C_i.  No bias.

Each round every partition goes through its rows, a block at a time, and moves one
alpha after the other to the least of a local problem: the objective with w as it
was, in which what the partition itself has added to w counts ``parts`` times.
That many-fold weight makes the sum of all partitions' steps safe, however the
rows are dealt.  A round starts from alphas carried on along their last move,
clipped to the box, and from plain ones again as soon as the objective rises; this
takes a third of the rounds.  New alphas are written, and one pass sums w from
them, so no error builds up.  Every few rounds a pass takes the primal loss, whose
distance to the dual objective is the duality gap that ends the training.  A task
holds one block of rows and two vectors as long as the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sparse import SparseRows, matrix
from ..sources.tables import dropped, stored
from .decomposition import NotConverged
from .linear import _summed, _times, _weighted

#: Rows of a block, and times that a block is gone through before the next.
BLOCK_ROWS = 4096
LOCAL_TURNS = 3
#: Rounds between two looks at the duality gap.
GAP_EVERY = 5


@dataclass
class DualModel:
    """``alphas``: (id, y, weight, alpha) of all rows."""

    w: np.ndarray
    alphas: DataFrame
    objective: float
    dual: float
    gap: float
    rounds: int


def _bounds(c: float, weight: np.ndarray, loss: str) -> tuple[np.ndarray, np.ndarray]:
    """(D, U) of rows; without weight a row's alpha is 0."""
    box = c * weight
    if loss == "l1":
        return np.zeros(len(box)), box
    with np.errstate(divide="ignore"):
        return 0.5 / box, np.where(box > 0, np.inf, 0.0)


def _descended(x: np.ndarray | SparseRows, y: np.ndarray, alpha: np.ndarray, bend: np.ndarray, top: np.ndarray, u: np.ndarray, parts: int, order: np.ndarray) -> np.ndarray:
    """New alphas of a block; ``u``, w with what this partition has added so far times ``parts``, moves along."""
    sparse = isinstance(x, SparseRows)
    squares = x.squares() if sparse else (x * x).sum(1)
    alpha = alpha.copy()
    curve = parts * squares + bend
    ptr = x.ptr if sparse else None
    for i in order:
        if top[i] <= 0:
            continue
        if sparse:
            use = slice(ptr[i], ptr[i + 1])
            at, val = x.idx[use] - 1, x.val[use]
            slope = y[i] * (val @ u[at]) - 1 + bend[i] * alpha[i]
        else:
            slope = y[i] * (x[i] @ u) - 1 + bend[i] * alpha[i]
        # A row without curvature, as one without features under the hinge, goes to the end that its slope points to.
        new = min(max(alpha[i] - slope / curve[i], 0.0), top[i]) if curve[i] > 0 else top[i] if slope < 0 else 0.0
        if new != alpha[i]:
            step = parts * (new - alpha[i]) * y[i]
            if sparse:
                u[at] += step * val
            else:
                u += step * x[i]
            alpha[i] = new
    return alpha


def fit_dual(df: DataFrame, dim: int, c: float = 1.0, loss: str = "l2", tol: float = 1e-3, max_rounds: int = 500, seed: int = 0) -> DualModel:
    """df: id, x, y in +1 and -1, and weight, which scales C, if there is one; ids are only carried.

    Ends when the duality gap is at most ``tol`` of the objective; raises
    ``NotConverged`` after ``max_rounds``.  Features beyond ``dim`` are dropped.
    """
    if loss not in ("l1", "l2"):
        raise ValueError(f"no loss {loss!r}")
    spark = df.sparkSession
    weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
    parts = spark.sparkContext.defaultParallelism
    dealt = df.select("id", "x", F.col("y").cast("double").alias("y"), weight.alias("weight"), F.lit(0.0).alias("alpha"), F.lit(0.0).alias("before")).repartition(parts, F.xxhash64("id"))
    state = stored(dealt, "dual-state")
    schema, names = state.schema, state.columns
    rounds, push, pace, lowest = 0, 0.0, 1.0, -np.inf

    def carried(alpha: np.ndarray, before: np.ndarray, top: np.ndarray, push: float) -> np.ndarray:
        return np.clip(alpha + push * (alpha - before), 0, top)

    def clipped(column: pa.Array) -> np.ndarray | SparseRows:
        x = matrix(column)
        if isinstance(x, SparseRows):
            use = x.idx <= dim
            return SparseRows(np.concatenate(([0], np.cumsum(use)))[x.ptr], x.idx[use], x.val[use])
        return x[:, :dim] if x.shape[1] >= dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))

    def totals(x, y: np.ndarray, r: np.ndarray, alpha: np.ndarray, before: np.ndarray, push: float) -> np.ndarray:
        bend, top = _bounds(c, r, loss)
        on = carried(alpha, before, top, push)
        some = np.where(alpha > 0, bend, 0.0) * alpha**2
        return np.concatenate([_weighted(x, alpha * y, dim), _weighted(x, on * y, dim), [alpha.sum(), some.sum()]])

    while True:
        wider = (1 + np.sqrt(1 + 4 * pace**2)) / 2
        push, pace = (pace - 1) / wider, wider
        sums = _summed(state.select("x", "y", "weight", "alpha", "before"), lambda *row, push=push: totals(*row, push), 2 * dim + 2)
        w, on = sums[:dim], sums[dim : 2 * dim]
        dual = float(sums[-2] - sums[-1] / 2 - w @ w / 2)
        if dual < lowest:
            push, pace, on = 0.0, 1.0, w
        lowest = dual
        if rounds % GAP_EVERY == 0 or rounds >= max_rounds:
            lost = _summed(state.select("x", "y", "weight"), lambda x, y, r, w=w: np.array([(r * np.maximum(0, 1 - y * _times(x, w)) ** (1 if loss == "l1" else 2)).sum()]), 1)[0]
            primal = float(w @ w / 2 + c * lost)
            if primal - dual <= tol * max(1e-12, abs(primal)):
                break
            if rounds >= max_rounds:
                raise NotConverged(f"a duality gap of {primal - dual:g} at an objective of {primal:g} is left after {rounds} rounds")
        # Partitions of this round, which the files may have been packed into.
        k = state.rdd.getNumPartitions()

        def run(batches: Iterator[pa.RecordBatch], k: int = k, at: int = rounds, w: np.ndarray = on, push: float = push) -> Iterator[pa.RecordBatch]:
            rng, u = np.random.default_rng([seed, at]), w.copy()
            for whole in batches:
                for first in range(0, whole.num_rows, BLOCK_ROWS):
                    batch = whole.slice(first, BLOCK_ROWS)
                    y, r, alpha, before = (batch.column(n).to_numpy() for n in ("y", "weight", "alpha", "before"))
                    x, (bend, top) = clipped(batch.column("x")), _bounds(c, r, loss)
                    new = carried(alpha, before, top, push)
                    for _ in range(LOCAL_TURNS):
                        new = _descended(x, y, new, bend, top, u, k, rng.permutation(len(y)))
                    columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {"alpha": pa.array(new), "before": pa.array(alpha)}
                    yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

        before, state = state, stored(state.mapInArrow(run, schema), "dual-state")
        dropped(before)
        rounds += 1
    return DualModel(w, state.select("id", "y", "weight", "alpha"), primal, dual, primal - dual, rounds)
