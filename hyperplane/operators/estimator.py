"""Kernel classifiers: training problems run in parallel; models are tables.

Up to ``ONE_TASK_ROWS`` rows each problem is one worker's.  Beyond, all problems
are trained over partitions (``decomposition.train_many``).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Kernel
from ..sources.tables import stored
from . import decomposition, smo
from .gram import against, matrix, scores


#: Rows of a table up to which a worker takes a problem whole.
ONE_TASK_ROWS = 16_000


def model_schema(x_type: str) -> str:
    return f"problem long, sv_id long, x {x_type}, y int, alpha double, rho double, objective double, gap double, iterations long"


def train_problems(rows: DataFrame, kernel: Kernel, c: float, pairs: str = "second", solver: Callable[..., smo.Solution] | None = None) -> DataFrame:
    """Support rows of each ``problem`` in rows (problem, id, x, y in +1 and -1, and weight, which scales C by row, if there is one).

    A problem without support rows gives one row with a null id.  ``solver`` is a
    function like ``smo.solve``: (x, y, kernel, c, pairs=, weights=) to a
    Solution.  A problem is one worker's: it holds the rows and a bounded cache
    of kernel rows; ``train_apart`` has no such bound.
    """
    columns = ["problem", "id", "x", "y", *(["weight"] if "weight" in rows.columns else [])]
    run = solver or smo.solve
    schema = model_schema(rows.schema["x"].dataType.simpleString())

    def fit(part: pa.Table) -> pa.Table:
        part = part.sort_by("id")
        weights = part.column("weight").to_numpy().astype(np.float64) if "weight" in columns else None
        s = run(matrix(part.column("x")), part.column("y").to_numpy(), kernel, c, pairs=pairs, weights=weights)
        some = np.flatnonzero(s.alpha > 0)
        n = max(len(some), 1)
        kept = part.take(pa.array(some if len(some) else [0]))
        mask = np.full(n, not len(some))
        column = lambda name, kind: pc.if_else(pa.array(mask), pa.scalar(None, kind), kept.column(name).combine_chunks().cast(kind))
        return pa.table(
            {
                "problem": kept.column("problem"), "sv_id": column("id", pa.int64()), "x": kept.column("x") if len(some) else pa.nulls(1, part.schema.field("x").type), "y": column("y", pa.int32()),
                "alpha": s.alpha[some] if len(some) else np.zeros(1), "rho": np.full(n, s.rho), "objective": np.full(n, s.objective), "gap": np.full(n, s.gap), "iterations": np.full(n, s.iterations),
            }
        )

    return rows.select(*columns).groupBy("problem").applyInArrow(fit, schema)


def train_apart(rows: DataFrame, targets: list[int], kernel: Kernel, c: float, pairs: str = "second", working: int | None = None) -> DataFrame:
    """The model of ``train_problems`` for each target against the rest, trained over partitions; rows: id, x, label, and weight if there is one."""
    names = F.array(*[F.lit(int(t)).cast("long") for t in targets])
    sides = F.transform(names, lambda t: F.when(F.col("label") == t, 1).otherwise(-1))
    extra = ["weight"] if "weight" in rows.columns else []
    found = decomposition.train_many(rows.select("id", "x", sides.alias("y"), *extra), [kernel] * len(targets), [c] * len(targets), working, pairs=pairs)
    schema = model_schema(rows.schema["x"].dataType.simpleString())
    numbers = lambda values: F.array(*[F.lit(float(v)) for v in values])[F.col("p")]
    each = found.state.select("id", "x", "y", F.posexplode("alpha").alias("p", "alpha"))
    head = [numbers(found.rho).alias("rho"), numbers(found.objective).alias("objective"), numbers(found.gap).alias("gap"), F.lit(found.rounds).cast("long").alias("iterations")]
    model = each.where("alpha > 0").select(names[F.col("p")].alias("problem"), F.col("id").alias("sv_id"), "x", F.col("y")[F.col("p")].cast("int").alias("y"), "alpha", *head)
    having = {r.problem for r in model.select("problem").distinct().collect()}
    bare = [(int(t), None, None, None, 0.0, float(found.rho[p]), float(found.objective[p]), float(found.gap[p]), found.rounds) for p, t in enumerate(targets) if t not in having]
    return model.unionByName(rows.sparkSession.createDataFrame(bare, schema)) if bare else model


def weighted(rows: DataFrame, class_weights: dict[int, float]) -> DataFrame:
    """Rows (label, ...) with ``weight``: the weight of the label, 1 for labels that are not listed; a label that no row has is an error."""
    known = {r.label for r in rows.select("label").distinct().collect()}
    if missing := set(class_weights) - known:
        raise ValueError(f"no row has the labels {sorted(missing)}")
    pairs = [F.when(F.col("label") == k, F.lit(float(w))) for k, w in class_weights.items()]
    return rows.withColumn("weight", F.coalesce(*pairs, F.lit(1.0)))


@dataclass
class KernelSVC:
    """Binary C-SVC, or one problem per class against the rest; labels of any integers, mapped back in predictions.

    The model is a DataFrame of support rows (see ``model_schema``) that ``save``
    and ``load`` keep as Parquet.  ``class_weights`` scale C by the row's label.
    """

    kernel: Kernel = field(default_factory=lambda: Kernel("rbf"))
    c: float = 1.0
    pairs: str = "second"
    class_weights: dict[int, float] = field(default_factory=dict)
    solver: Callable[..., smo.Solution] | None = None
    model: DataFrame | None = None
    classes: list[int] = field(default_factory=list)

    def fit(self, df: DataFrame) -> KernelSVC:
        """df: id, x, label."""
        self.classes = sorted(r.label for r in df.select("label").distinct().collect())
        targets = self.classes[1:] if len(self.classes) == 2 else self.classes
        each = F.explode(F.array(*[F.lit(int(t)).cast("long") for t in targets]))
        rows = weighted(df, self.class_weights) if self.class_weights else df
        if self.solver is None and df.count() > ONE_TASK_ROWS:
            self.model = train_apart(rows, targets, self.kernel, self.c, self.pairs)
            return self
        rows = rows.withColumn("problem", each).withColumn("y", F.when(F.col("label") == F.col("problem"), 1).otherwise(-1))
        # Every pass over the model would train once more.
        self.model = stored(train_problems(rows, self.kernel, self.c, self.pairs, self.solver), "model")
        return self

    def decision(self, df: DataFrame) -> DataFrame:
        """(id, problem, score) of each row and problem; one pass for all problems."""
        rho = {r.problem: r.rho for r in self.model.groupBy("problem").agg(F.first("rho").alias("rho")).collect()}
        support = self.model.where("sv_id is not null").select(F.col("sv_id").alias("id"), "x", "y", "alpha", "problem")
        results = {f"p{n}": ("dot", lambda b, p=p: b["alpha"] * b["y"] * (b["problem"] == p)) for n, p in enumerate(rho)}
        wide = against(df, support, self.kernel, ["y", "alpha", "problem"], results)
        each = F.explode(F.array(*[F.struct(F.lit(p).cast("long").alias("problem"), (F.col(f"p{n}") - r).alias("score")) for n, (p, r) in enumerate(rho.items())])).alias("e")
        return wide.select("id", each).select("id", "e.*")

    def predict(self, df: DataFrame) -> DataFrame:
        """(id, pred): by sign for two classes, zero counting as the second class; else the class with the greatest score, ties by the smallest."""
        found = self.decision(df)
        if len(self.classes) == 2:
            return found.select("id", F.when(F.col("score") < 0, self.classes[0]).otherwise(self.classes[1]).alias("pred"))
        return found.groupBy("id").agg(F.max_by("problem", F.struct("score", -F.col("problem"))).cast("int").alias("pred"))

    def save(self, path: str) -> None:
        self.model.withColumn("classes", F.array(*map(F.lit, self.classes))).write.mode("overwrite").parquet(path)

    def load(self, df: DataFrame) -> KernelSVC:
        self.classes = list(df.select("classes").first().classes)
        self.model = df.drop("classes")
        return self


def summary(model: DataFrame) -> DataFrame:
    """One row per problem: support rows, bias, objective, gap, iterations."""
    return model.groupBy("problem").agg(F.count("sv_id").alias("n_sv"), F.first("rho").alias("rho"), F.first("objective").alias("objective"), F.first("gap").alias("gap"), F.first("iterations").alias("iterations"))


def primal_scores(df: DataFrame, w: DataFrame) -> DataFrame:
    """(id, score) of x against one row of weights; features beyond the weights are dropped."""
    from ..functions.vectors import dot, entries, is_sparse, weighed

    if is_sparse(df):
        return entries(df).join(F.broadcast(w)).select("id", weighed(F.col("x"), F.col("w")).alias("score"))
    return df.join(F.broadcast(w)).select("id", dot(F.col("w"), F.slice("x", F.lit(1), F.size("w"))).alias("score"))


__all__ = ["KernelSVC", "model_schema", "primal_scores", "scores", "summary", "train_problems", "weighted"]
