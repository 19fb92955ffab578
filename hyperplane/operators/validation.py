"""Stratified folds, validation, cross-validation, searches and sweeps.

Up to ``estimator.ONE_TASK_ROWS`` rows every (fold, gamma) is one grouped task;
beyond, all folds, gammas and C are trained over partitions at once.
"""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.kernels import Kernel, kernel_of
from . import decomposition, estimator, linear, smo
from .estimator import KernelSVC, summary
from .gram import matrix
from .ranks import ranked


def shuffled(id_col: str = "id") -> F.Column:
    """A fixed pseudo-random order that SQL engines agree on."""
    return (F.col(id_col) * 7919) % 10007


def stratified_folds(df: DataFrame, k: int) -> DataFrame:
    """df (id, y, ...) with ``fold`` from 0: rows of each side dealt round-robin in shuffled order, so sizes of a side differ by one at most."""
    rows = df.withColumn("_side", F.col("y") > 0).withColumn("_at", shuffled())
    dealt = ranked(rows, ["_side"], ["_at", "id"], "_rank")
    return dealt.select(*df.columns, (F.col("_rank") % k).cast("int").alias("fold"))


def power_range(low: int, high: int, base: float = 2.0, step: int = 1) -> list[float]:
    """base**low to base**high, both included."""
    return [float(base) ** e for e in range(low, high + 1, step)]


GRID_C = (-5, 15, 2.0, 2)
GRID_GAMMA = (-15, 3, 2.0, 2)
#: C of the search over a list (fixed values).
C_LIST = [0.125, 0.025, 0.5, 1.0, 2.0, 4.0, 8.0, 16.0, 32.0, 64.0, 128.0]


def grid(spark: SparkSession, c: list[float], gamma: list[float]) -> DataFrame:
    return spark.createDataFrame([(a, b) for a in c for b in gamma], "c double, gamma double")


def cross_validate(df: DataFrame, parameters: DataFrame, kernel: str | Callable[[float], Kernel], k: int) -> DataFrame:
    """(c, gamma, correct, n, accuracy) pooled over folds; df: id, x, y, fold.

    ``kernel`` is a name, or a function of gamma that gives a kernel.  Rows go
    once to each fold and gamma; all C of a gamma share the kernel values there,
    and each C after the first starts from the solution before (``smo.path``).
    Tables above ``estimator.ONE_TASK_ROWS`` go to ``cross_validate_apart``.
    """
    make = (lambda gamma: kernel_of(kernel, gamma)) if isinstance(kernel, str) else kernel
    if df.count() > estimator.ONE_TASK_ROWS:
        return cross_validate_apart(df, parameters, make, k)
    tasks = parameters.groupBy("gamma").agg(F.array_sort(F.collect_set("c")).alias("cs")).withColumn("test", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    rows = df.select("id", "x", "y", "fold").join(F.broadcast(tasks))

    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("id")
        gamma, test, cs = part.column("gamma")[0].as_py(), part.column("test")[0].as_py(), part.column("cs")[0].as_py()
        x, y = matrix(part.column("x")), part.column("y").to_numpy().astype(np.float64)
        held = part.column("fold").to_numpy() == test
        kern, mine, theirs = make(gamma), x[~held], x[held]
        rows = smo.Rows(mine, kern) if len(mine) else None
        correct = []
        for s in smo.path(mine, y[~held], kern, cs, rows=rows):
            some = s.alpha > 0
            value = smo.decide(theirs, mine[some], s.alpha[some] * y[~held][some], kern, s.rho)
            correct.append(int((np.where(value < 0, -1, 1) == y[held]).sum()))
        return pa.table({"c": cs, "gamma": [gamma] * len(cs), "correct": correct, "n": [int(held.sum())] * len(cs)})

    parts = rows.groupBy("gamma", "test").applyInArrow(run, "c double, gamma double, correct long, n long")
    return parts.groupBy("c", "gamma").agg(F.sum("correct").alias("correct"), F.sum("n").alias("n")).withColumn("accuracy", F.col("correct") / F.col("n"))


def cross_validate_apart(df: DataFrame, parameters: DataFrame, make: Callable[[float], Kernel], k: int, working: int | None = None) -> DataFrame:
    """``cross_validate`` without a task that holds the table: every (C, gamma, fold) is a problem of one training over partitions.

    Held-out rows get their decision values in the passes of the training.
    """
    pairs = sorted((r.c, r.gamma) for r in parameters.select("c", "gamma").distinct().collect())
    kernels = {gamma: make(gamma) for _, gamma in pairs}
    problems = [(c, gamma, test) for c, gamma in pairs for test in range(k)]
    sides = F.transform(F.array(*[F.lit(t) for _, _, t in problems]), lambda t: F.when(F.col("fold") == t, 0).otherwise(F.col("side")))
    rows = df.select("id", "x", F.col("y").cast("int").alias("side"), "fold").withColumn("y", sides)
    found = decomposition.train_many(rows, [kernels[g] for _, g, _ in problems], [c for c, _, _ in problems], working)
    tests, rho, n = np.array([t for _, _, t in problems]), found.rho, len(problems)

    def counted(batches):
        total = np.zeros((2, n), np.int64)
        for batch in batches:
            f = batch.column("f").flatten().to_numpy().reshape(-1, n)
            held = batch.column("fold").to_numpy()[:, None] == tests
            right = np.where(f - rho < 0, -1, 1) == batch.column("side").to_numpy()[:, None]
            total += np.stack([(held & right).sum(0), held.sum(0)])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n) // k), *map(pa.array, total)], ["pair", "correct", "n"])

    parts = found.state.select("f", "fold", "side").mapInArrow(counted, "pair long, correct long, n long").groupBy("pair").agg(F.sum("correct").alias("correct"), F.sum("n").alias("n"))
    names = df.sparkSession.createDataFrame([(at, float(c), float(g)) for at, (c, g) in enumerate(pairs)], "pair long, c double, gamma double")
    return parts.join(F.broadcast(names), "pair").select("c", "gamma", "correct", "n").withColumn("accuracy", F.col("correct") / F.col("n"))


def cross_validate_linear(df: DataFrame, c: list[float], k: int, dim: int) -> DataFrame:
    """(c, gamma, correct, n, accuracy) of linear classifiers with the squared hinge and no bias, all C and folds in the same passes; df: x, y, fold."""
    found = linear.cross_validated(df, dim, c, k)
    rows = [(float(x), 1.0, correct, n, correct / n if n else None) for x, correct, n in found]
    return df.sparkSession.createDataFrame(rows, "c double, gamma double, correct long, n long, accuracy double")


def best(results: DataFrame) -> DataFrame:
    """The greatest accuracy; ties by the smallest C, then gamma."""
    return results.orderBy(F.desc("accuracy"), "c", "gamma").limit(1)


def search_c(df: DataFrame, kernel: str | Callable[[float], Kernel] = "linear", k: int = 5, c: list[float] | None = None) -> DataFrame:
    """Cross-validated accuracy of each C of a list, ``C_LIST`` by default; df: id, x, y."""
    return cross_validate(stratified_folds(df, k), grid(df.sparkSession, C_LIST if c is None else c, [1.0]), kernel, k)


def accuracy(predictions: DataFrame, label: str = "y", pred: str = "pred") -> DataFrame:
    return predictions.agg(F.sum((F.col(label) == F.col(pred)).cast("long")).alias("correct"), F.count(F.lit(1)).alias("n"), F.avg((F.col(label) == F.col(pred)).cast("double")).alias("accuracy"))


def train_and_test(model, train: DataFrame, test: DataFrame, **fit) -> DataFrame:
    """(correct, n, accuracy) on ``test`` of an estimator fitted to ``train``; both id, x, label."""
    return accuracy(model.fit(train, **fit).predict(test).join(test.select("id", "label"), "id"), "label")


def sweep(datasets: dict[str, tuple[DataFrame, DataFrame]], kernels: dict[str, Kernel], solvers: list[str], c: float = 4.0, repeats: int = 1) -> DataFrame:
    """One row per data set (train and test: id, x, label), kernel and solver: mean seconds of training and prediction over the
    repeats, iterations, objective, support rows and accuracy."""
    out, spark = [], None
    for name, (train, test) in datasets.items():
        spark = train.sparkSession
        for kernel_name, kernel in kernels.items():
            for pairs in solvers:
                times = []
                for _ in range(max(repeats, 1)):
                    began = time.perf_counter()
                    svc = KernelSVC(kernel, c, pairs).fit(train)
                    svc.model = svc.model.persist()
                    head = summary(svc.model).agg(F.sum("iterations").alias("iterations"), F.sum("objective").alias("objective"), F.sum("n_sv").alias("n_sv")).first()
                    trained = time.perf_counter()
                    got = accuracy(svc.predict(test).join(test.select("id", "label"), "id"), "label").first()
                    times.append((trained - began, time.perf_counter() - trained))
                    svc.model.unpersist()
                seconds = np.mean(times, axis=0)
                out.append((name, kernel_name, pairs, float(seconds[0]), float(seconds[1]), head.iterations, head.objective, head.n_sv, got.accuracy))
    schema = "dataset string, kernel string, solver string, train_s double, predict_s double, iterations long, objective double, n_sv long, accuracy double"
    return (spark or SparkSession.getActiveSession()).createDataFrame(out, schema)
