"""Linear classifiers without a bias, trained over partitions; vectors are dense or sparse.

The objective is |w|**2 / 2 + sum C_i loss(y_i w.x_i), with the squared hinge
(``l2``) or the hinge (``l1``).  For the squared hinge each iteration is one
pass that sums, per partition, a vector as long as the number of features, for
all classes at once; long ones are added up by ranges of features, so that one
vector a class reaches the driver whatever the number of partitions.  The input is
read once and kept for the passes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sparse import SparseRows, matrix

#: Cells of the curvature matrices of all classes up to which Newton steps are solved on the driver; beyond, by conjugate gradients.
CURVATURE_CELLS = 1 << 20
#: Values of a sum that travel together.
RANGE = 1 << 16


@dataclass
class LinearModel:
    w: np.ndarray
    objective: float
    gradient_norm: float
    duality_gap: float
    iterations: int


def _summed(df: DataFrame, f: Callable[..., np.ndarray], size: int) -> np.ndarray:
    """Sum of f(x, other columns) over partitions.

    A sum longer than ``RANGE`` leaves its partition in packed ranges, without
    those that are zero, which are added up by range: the driver gets each once.
    """
    others = range(1, len(df.columns))

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                total += f(matrix(batch.column(0)), *(batch.column(k).to_numpy(zero_copy_only=False).astype(np.float64) for k in others))
        yield from _ranges((at // RANGE, total[at : at + RANGE]) for at in range(0, size, RANGE))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for at, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                values = np.frombuffer(x.as_buffer())
                totals[at] = totals[at] + values if at in totals else values.copy()
        yield from _ranges(totals.items())

    rows = df.mapInArrow(part, "at int, total binary")
    if size > RANGE:
        rows = rows.repartition(min(32, -(-size // RANGE)), "at").mapInArrow(joined, "at int, total binary")
    elif df.rdd.getNumPartitions() > 64:
        rows = rows.repartition(32).mapInArrow(joined, "at int, total binary")
    out = np.zeros(size)
    for r in rows.toLocalIterator() if size > RANGE else rows.collect():
        out[r.at * RANGE : (r.at + 1) * RANGE] += np.frombuffer(r.total)
    return out


def _ranges(parts: Iterable[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for at, values in parts:
        if values.any():
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["at", "total"])


def _times(x: np.ndarray | SparseRows, w: np.ndarray) -> np.ndarray:
    if isinstance(x, SparseRows):
        return x.times(w)
    n = min(x.shape[1], len(w))
    return x[:, :n] @ w[:n]


def _weighted(x: np.ndarray | SparseRows, v: np.ndarray, dim: int) -> np.ndarray:
    if isinstance(x, SparseRows):
        return x.weighted(v, dim)
    out = np.zeros((dim, *v.shape[1:]))
    n = min(x.shape[1], dim)
    out[:n] = x[:, :n].T @ v
    return out


class _Problems:
    """Problems over rows (x, y, weight, fold), all in the same passes: y is the label, or +1 and -1 without classes.

    Problem p holds class targets[p] against the rest, with c[p], over the rows
    whose fold is not tests[p]; without tests, over all rows.
    """

    def __init__(self, df: DataFrame, dim: int, c: float | list[float], targets: list[float] | None, tests: list[int] | None = None):
        weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
        fold = F.col("fold") if tests is not None else F.lit(-1)
        self.rows = df.select("x", F.col("y").cast("double").alias("y"), weight.alias("weight"), fold.alias("fold")).persist()
        n = len(targets or tests or [1])
        self.dim, self.targets = dim, np.array(targets if targets is not None else [1.0] * n, np.float64)
        self.c, self.tests = np.broadcast_to(np.asarray(c, np.float64), n), None if tests is None else np.asarray(tests)

    def sides(self) -> Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """A function to (side, C) of rows in each problem; C is 0 where a row is held out."""
        targets, tests, c = self.targets, self.tests, self.c

        def f(y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            box = c * weight[:, None]
            return np.where(y[:, None] == targets, 1.0, -1.0), box if tests is None else box * (fold[:, None] != tests)

        return f

    def passed(self, w: np.ndarray, curvature: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """Of each problem: objective, gradient, dual objective, and if asked for the curvature, at the columns of w (dim, problems)."""
        dim, k, sides = self.dim, w.shape[1], self.sides()

        def f(x, *row: np.ndarray) -> np.ndarray:
            side, box = sides(*row)
            slack = np.maximum(0, 1 - side * _times(x, w))
            alpha = 2 * box * slack
            parts = [(box * slack**2).sum(0), (alpha - np.divide(alpha**2, 4 * box, out=np.zeros_like(alpha), where=box > 0)).sum(0), _weighted(x, alpha * side, dim).ravel()]
            if curvature:
                dense = x.dense(dim) if isinstance(x, SparseRows) else x
                parts += [((dense * (2 * box[:, j] * (slack[:, j] > 0))[:, None]).T @ dense).ravel() for j in range(k)]
            return np.concatenate(parts)

        s = _summed(self.rows, f, 2 * k + dim * k + (k * dim * dim if curvature else 0))
        v = s[2 * k : 2 * k + dim * k].reshape(dim, k)
        bend = np.eye(dim) + s[2 * k + dim * k :].reshape(k, dim, dim) if curvature else None
        return (w**2).sum(0) / 2 + s[:k], w - v, s[k : 2 * k] - (v**2).sum(0) / 2, bend

    def bent(self, w: np.ndarray, d: np.ndarray) -> np.ndarray:
        """Products of the curvature at w with the columns of d."""
        dim, sides = self.dim, self.sides()

        def f(x, *row: np.ndarray) -> np.ndarray:
            side, box = sides(*row)
            return _weighted(x, 2 * box * (side * _times(x, w) < 1) * _times(x, d), dim).ravel()

        return d + _summed(self.rows, f, dim * d.shape[1]).reshape(dim, -1)

    def solved(self, w: np.ndarray, gradient: np.ndarray, bend: np.ndarray | None, most: int = 50) -> np.ndarray:
        """Newton steps of all problems: on the driver from curvature matrices, or by conjugate gradients, all problems in step."""
        if bend is not None:
            return np.stack([np.linalg.solve(b, -g) for b, g in zip(bend, gradient.T, strict=True)], 1)
        step, r = np.zeros_like(w), -gradient
        d, rr = r.copy(), (r**2).sum(0)
        enough = 0.01 * rr
        for _ in range(most):
            go = rr > enough
            if not go.any():
                break
            hd = self.bent(w, d)
            size = np.where(go, rr / np.maximum((d * hd).sum(0), 1e-300), 0)
            step, r = step + size * d, r - size * hd
            before, rr = rr, (r**2).sum(0)
            d = r + np.where(go, rr / np.maximum(before, 1e-300), 0) * d
        return step

    def newton(self, tol: float, max_iter: int, conjugate: bool = False, relative: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        w, turn = np.zeros((self.dim, len(self.targets))), 0
        whole = not conjugate and len(self.targets) * self.dim**2 <= CURVATURE_CELLS
        objective, gradient, dual, bend = self.passed(w, whole)
        tol = tol * np.maximum(1, np.abs(gradient).max(0, initial=0)) if relative else tol
        while turn < max_iter and (left := np.abs(gradient).max(0, initial=0) > tol).any():
            step = self.solved(w, gradient, bend) * left
            size, slope = np.ones(len(left)), (gradient * step).sum(0)
            while True:
                found = self.passed(w + size * step, whole)
                short = left & (found[0] > objective + 1e-4 * size * slope + 1e-12 * np.abs(objective)) & (size > 1e-6)
                if not short.any():
                    break
                size = np.where(short, size / 2, size)
            w = w + size * step
            objective, gradient, dual, bend = found
            turn += 1
        return w, objective, gradient, dual, turn

    def barzilai_borwein(self, tol: float, max_iter: int, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
        w, turn = np.zeros((self.dim, len(self.targets))), 0
        objective, gradient, dual, _ = self.passed(w)
        recent = [objective]
        size = 1.0 / np.maximum(1.0, np.abs(gradient).max(0, initial=1))
        while turn < max_iter and (left := np.abs(gradient).max(0, initial=0) > tol).any():
            while True:
                found = self.passed(w - size * left * gradient)
                short = left & (found[0] > np.max(recent[-10:], axis=0) - 1e-4 * size * (gradient**2).sum(0)) & (size >= 1e-12)
                if not short.any():
                    break
                size = np.where(short, size / 2, size)
            s = -size * left * gradient
            d = found[1] - gradient
            w = w + s
            objective, gradient, dual, _ = found
            recent.append(objective)
            ss, sd, dd = (s**2).sum(0), np.maximum((s * d).sum(0), 1e-300), np.maximum((d**2).sum(0), 1e-300)
            first = rule == "bb1" or rule == "both" and turn % 2 == 0
            size = np.where(left & (ss > 0), np.clip(ss / sd if first else sd / dd, 1e-12, 1e12), size)
            turn += 1
        return w, objective, gradient, dual, turn

    def right(self, w: np.ndarray) -> np.ndarray:
        """Of each problem: rows of its held-out fold whose side is told right (a value of 0 counts as -1), and all of them."""
        targets, tests = self.targets, self.tests

        def f(x, y: np.ndarray, weight: np.ndarray, fold: np.ndarray) -> np.ndarray:
            held = fold[:, None] == tests
            return np.concatenate([(held & ((_times(x, w) > 0) == (y[:, None] == targets))).sum(0), held.sum(0)]).astype(np.float64)

        return _summed(self.rows, f, 2 * w.shape[1]).reshape(2, -1).astype(np.int64)

    def done(self) -> None:
        self.rows.unpersist()


def _binary(df: DataFrame, dim: int, c: float, run: Callable[[_Problems], tuple]) -> LinearModel:
    problems = _Problems(df, dim, c, None)
    try:
        w, objective, gradient, dual, turn = run(problems)
    finally:
        problems.done()
    return LinearModel(w[:, 0], float(objective[0]), float(np.abs(gradient).max(initial=0)), float(objective[0] - dual[0]), turn)


def fit_squared_hinge(df: DataFrame, dim: int, c: float = 1.0, tol: float = 1e-4, max_iter: int = 60) -> LinearModel:
    """Newton's method on the primal: df (x, y in +1 and -1, and weight if there is one)."""
    return _binary(df, dim, c, lambda p: p.newton(tol, max_iter))


def fit_conjugate_gradient(df: DataFrame, dim: int, c: float = 1.0, tol: float = 1e-4, max_iter: int = 60) -> LinearModel:
    """As ``fit_squared_hinge``, with Newton steps by conjugate gradients on products with the curvature, whatever the dimension."""
    return _binary(df, dim, c, lambda p: p.newton(tol, max_iter, True))


def fit_barzilai_borwein(df: DataFrame, dim: int, c: float = 1.0, tol: float = 1e-3, max_iter: int = 300, rule: str = "bb1") -> LinearModel:
    """Gradient steps of Barzilai-Borwein length (``bb1``, ``bb2``, or ``both`` in turn), with a non-monotone line search over the last ten objectives."""
    return _binary(df, dim, c, lambda p: p.barzilai_borwein(tol, max_iter, rule))


def cross_validated(df: DataFrame, dim: int, c: list[float], k: int, tol: float = 1e-3, max_iter: int = 100) -> list[tuple[float, int, int]]:
    """(C, rows told right, rows) of each C, pooled over the k folds of df (x, y in +1 and -1, fold, and weight if there is one).

    Fits of all C and folds move in the same passes, one column of w each, with
    the squared hinge; a last pass counts what the held-out folds get right.
    ``tol`` is times the gradient at 0, as C spans many powers.
    """
    pairs = [(x, test) for x in c for test in range(k)]
    problems = _Problems(df, dim, [x for x, _ in pairs], None, [t for _, t in pairs])
    try:
        correct, n = problems.right(problems.newton(tol, max_iter, relative=True)[0])
    finally:
        problems.done()
    return [(x, int(correct[at : at + k].sum()), int(n[at : at + k].sum())) for x, at in zip(c, range(0, len(pairs), k), strict=True)]


def fit_hinge(df: DataFrame, dim: int, c: float = 1.0, tol: float = 1e-6, max_iter: int = 500) -> LinearModel:
    """The hinge loss by Spark's own ``LinearSVC``, whose objective is this one over the total weight and C."""
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.functions import array_to_vector

    weight = F.col("weight").cast("double") if "weight" in df.columns else F.lit(1.0)
    dense = densified(df.select("x", "y", weight.alias("weight")), dim)
    rows = dense.select(array_to_vector("x").alias("features"), (F.col("y") > 0).cast("double").alias("label"), "weight").persist()
    try:
        total = rows.agg(F.sum("weight")).first()[0] or 0.0
        if not total:
            return LinearModel(np.zeros(dim), 0.0, 0.0, 0.0, 0)
        found = LinearSVC(regParam=1 / (c * total), fitIntercept=False, standardization=False, weightCol="weight", tol=tol, maxIter=max_iter).fit(rows)
    finally:
        rows.unpersist()
    w = found.coefficients.toArray()
    loss = _summed(dense.select("x", F.col("y").cast("double"), "weight"), lambda x, y, r: np.array([(r * np.maximum(0, 1 - y * _times(x, w))).sum()]), 1)[0]
    return LinearModel(w, float(w @ w / 2 + c * loss), float("nan"), float("nan"), found.summary().totalIterations if found.hasSummary else 0)


def densified(df: DataFrame, dim: int) -> DataFrame:
    """df with x as an array of ``dim`` doubles; arrays of doubles stay."""
    kind = df.schema["x"].dataType.simpleString()
    if kind.startswith("array<double"):
        return df
    pairs = F.col("x") if kind.startswith("map") else F.map_from_entries(F.col("x"))
    return df.withColumn("x", F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: F.coalesce(F.try_element_at(pairs, i.cast("int")), F.lit(0.0))))


@dataclass
class LinearClassifier:
    """Two classes by the sign of w.x, above 0 being the class whose first row comes first; more by one problem per class against
    the rest, the greatest value deciding and the earlier class winning ties.  ``class_weights`` scale C by the row's label."""

    c: float = 1.0
    solver: str = "newton"
    class_weights: dict[int, float] = field(default_factory=dict)
    tol: float = 1e-4
    max_iter: int = 300
    classes: list[int] = field(default_factory=list)
    w: np.ndarray | None = None

    def fit(self, df: DataFrame, dim: int) -> LinearClassifier:
        """df: id, x, label."""
        from .estimator import weighted

        rows = weighted(df, self.class_weights) if self.class_weights else df
        self.classes = [r.label for r in df.groupBy("label").agg(F.min("id").alias("first")).orderBy("first").collect()]
        targets = self.classes[:1] if len(self.classes) == 2 else self.classes
        problems = _Problems(rows.withColumn("y", F.col("label")), dim, self.c, targets)
        try:
            run = {"newton": lambda: problems.newton(self.tol, self.max_iter), "cg": lambda: problems.newton(self.tol, self.max_iter, True), "bb": lambda: problems.barzilai_borwein(self.tol, self.max_iter, "both")}
            self.w = run[self.solver]()[0]
        finally:
            problems.done()
        return self

    def decision(self, df: DataFrame) -> DataFrame:
        """(id, scores): one value per problem; features beyond those of the training are dropped."""
        w = self.w

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                value = _times(matrix(batch.column(1)), w) if batch.num_rows else np.zeros((0, w.shape[1]))
                ends = pa.array(np.arange(len(value) + 1) * w.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(value.ravel(), pa.float64()))], ["id", "scores"])

        return df.select(F.col("id").cast("long"), "x").mapInArrow(score, "id long, scores array<double>")

    def predict(self, df: DataFrame) -> DataFrame:
        """(id, pred)."""
        found = self.decision(df)
        if len(self.classes) == 2:
            return found.select("id", F.when(F.col("scores")[0] > 0, self.classes[0]).otherwise(self.classes[1]).alias("pred"))
        names = F.array(*map(F.lit, self.classes))
        return found.select("id", F.element_at(names, F.array_position("scores", F.array_max("scores")).cast("int")).alias("pred"))
