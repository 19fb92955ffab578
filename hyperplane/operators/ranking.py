"""Ranking as classification of differences: pairs (i, j), j < i, x = x_i - x_j, label +1 if y_i >= y_j else -1.

A pair asks that the row that comes later in the order of (rank, id) scores higher
by one.  ``PairLoss`` gives the squared hinge over all pairs and its derivatives
without forming any: in a tree over that order, the pairs that meet at a node have
their later row in its right half.  By score, with one added on the left, the rows
of the left half that break the margin of a row of the right half are those behind
it, and the other way round, so running sums over the sorted node hold all that a
row needs of its partners.  Nodes within ``BLOCK`` rows are one task's; those above
are sorted over ranges whose sums are carried from range to range.  A row is sorted
once a level: n log n in all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sparse import SparseRows, matrix
from ..functions.vectors import subtract
from ..sources.tables import dropped, stored
from .decomposition import NotConverged
from .linear import LinearModel, _times
from .ranks import ranked, running

#: Rows of the order whose pairs among each other are one task's.
BLOCK = 1 << 14
#: Rows of a range of the levels above, about.
RANGE = 1 << 15


def difference_pairs(df: DataFrame) -> DataFrame:
    """(i, j, x, y) of every pair j < i of df (id, x, rank).  Quadratic by definition: a range join in blocks of ids."""
    a = df.select(F.col("id").alias("i"), F.col("x").alias("xi"), F.col("rank").alias("ri"))
    b = df.select(F.col("id").alias("j"), F.col("x").alias("xj"), F.col("rank").alias("rj"))
    pairs = a.join(b, F.col("j") < F.col("i"))
    return pairs.select("i", "j", subtract(F.col("xi"), F.col("xj")).alias("x"), F.when(F.col("ri") >= F.col("rj"), 1).otherwise(-1).alias("y"))


def _before(df: DataFrame, sums: dict[str, F.Column]) -> tuple[DataFrame, list]:
    """(id, s_*, b_*, n_k, b_k) by id of df (id, rank, ...), and the ranks: ``sums`` of the id's rows and of all rows of smaller ids,
    and how many of each have rank k; linear in the rows, for few ranks."""
    ranks = sorted(r[0] for r in df.select("rank").distinct().collect() if r[0] is not None)
    counts = {f"n_{k}": F.count(F.when(F.col("rank") == r, 1)) for k, r in enumerate(ranks)}
    grouped = df.groupBy("id").agg(*(v.alias(f"s_{n}") for n, v in sums.items()), *(v.alias(n) for n, v in counts.items()))
    return running(grouped, "id", {f"s_{n}": f"b_{n}" for n in sums} | {n: f"b{n[1:]}" for n in counts}, exact=False), ranks


def _up_to(k: int) -> F.Column:
    return sum((F.col(f"b_{i}") for i in range(k + 1)), F.lit(0.0))


def pair_labels(df: DataFrame) -> DataFrame:
    """(rank, n_pos, n_neg): labels of the pairs j < i of df (id, rank) by the rank of row i; running counts in order of id, without forming a pair."""
    before, ranks = _before(df.select("id", "rank"), {"rows": F.count(F.lit(1))})
    kinds = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"n_{k}").alias("n"), _up_to(k).alias("pos"), (_up_to(len(ranks) - 1) - _up_to(k)).alias("neg")) for k in range(len(ranks))])
    if not ranks:
        return df.where("false").select("rank", F.lit(0).cast("long").alias("n_pos"), F.lit(0).cast("long").alias("n_neg"))
    each = before.select(F.explode(kinds).alias("e")).select("e.*").where("n > 0 and pos + neg > 0")
    names = F.array(*map(F.lit, ranks))[F.col("k")].cast(df.schema["rank"].dataType)
    return each.groupBy("k").agg(F.sum(F.col("n") * F.col("pos")).cast("long").alias("n_pos"), F.sum(F.col("n") * F.col("neg")).cast("long").alias("n_neg")).select(names.alias("rank"), "n_pos", "n_neg")


def pair_sums(df: DataFrame) -> DataFrame:
    """(i, n, balance, first): of each id i of df (id, rank, value), over its pairs j < i, their number, the sum of their labels and
    the sum of value_i - value_j; running sums in order of id, without forming a pair.

    A row without a rank makes pairs labelled -1, one without a value no difference, as in ``difference_pairs``.
    """
    value = F.col("value").cast("double")
    rows = df.select("id", "rank", F.when(value.isNotNull(), value).alias("value"))
    sums = {"rows": F.count(F.lit(1)), "values": F.count("value"), "value": F.coalesce(F.sum("value"), F.lit(0.0))}
    before, ranks = _before(rows, sums)
    before = before.where("b_rows > 0")
    pos = sum((F.col(f"n_{k}") * _up_to(k) for k in range(len(ranks))), F.lit(0.0))
    pairs = F.col("s_rows") * F.col("b_rows")
    first = F.when((F.col("s_values") > 0) & (F.col("b_values") > 0), F.col("s_value") * F.col("b_values") - F.col("s_values") * F.col("b_value"))
    return before.select(F.col("id").alias("i"), pairs.cast("long").alias("n"), (2 * pos - pairs).cast("long").alias("balance"), first.alias("first"))


def concordance(scored: DataFrame) -> DataFrame:
    """(concordant, discordant, tied, pairwise_accuracy, tau) over pairs of scored (score, rank) whose ranks differ.

    Counts per score and rank, of few ranks, and running sums in order of score:
    linear in the rows.  A pair of equal scores counts half as right; ``tau`` is
    Kendall's, over the pairs whose ranks differ.
    """
    ranks = sorted(r[0] for r in scored.select("rank").distinct().collect() if r[0] is not None)
    counts = scored.where("rank is not null").groupBy("score").agg(*(F.count(F.when(F.col("rank") == r, 1)).alias(f"n{k}") for k, r in enumerate(ranks)), F.count(F.lit(1)).alias("n"))
    below = running(counts, "score", {f"n{k}": f"b{k}" for k in range(len(ranks))} or {"n": "b"})
    total = lambda terms: F.sum(sum(terms, F.lit(0))).cast("long")
    pairs = [(i, j) for i in range(len(ranks)) for j in range(i)]
    out = below.agg(
        F.coalesce(total([F.col(f"n{i}") * F.col(f"b{j}") for i, j in pairs]), F.lit(0)).alias("concordant"),
        F.coalesce(total([F.col(f"n{j}") * F.col(f"b{i}") for i, j in pairs]), F.lit(0)).alias("discordant"),
        F.coalesce(total([F.col(f"n{i}") * F.col(f"n{j}") for i, j in pairs]), F.lit(0)).alias("tied"),
    )
    n = F.col("concordant") + F.col("discordant") + F.col("tied")
    return out.select("*", ((F.col("concordant") + F.col("tied") / 2) / F.nullif(n, F.lit(0))).alias("pairwise_accuracy"), ((F.col("concordant") - F.col("discordant")) / F.nullif(n, F.lit(0))).alias("tau"))


def _partners(node: np.ndarray, right: np.ndarray, key: np.ndarray, values: np.ndarray, carried: np.ndarray | None = None) -> np.ndarray:
    """Sums of ``values`` over the partners of each row: those of the other half of its node that break the margin with it.

    ``carried`` holds, by node of these rows in ascending order, the sums of left
    and right rows that are sorted before and behind them elsewhere: (left behind,
    right before).
    """
    order = np.lexsort((key, node))
    names, start = np.unique(node[order], return_index=True)
    at = np.searchsorted(names, node[order])
    mine, is_right = values[order], right[order][:, None]
    left, rights = np.cumsum(np.where(is_right, 0, mine), 0), np.cumsum(np.where(is_right, mine, 0), 0)
    before = lambda total: np.where(start[:, None] > 0, total[np.maximum(start - 1, 0)], 0)
    end = np.append(start[1:], len(order)) - 1
    # Of right rows: left rows behind them; of left rows: right rows before them.
    behind, ahead = left[end][at] - left, rights - before(rights)[at]
    if carried is not None:
        behind, ahead = behind + carried[0][at], ahead + carried[1][at]
    out = np.empty_like(mine)
    out[order] = np.where(is_right, behind, ahead)
    return out


def _derived(right: np.ndarray, s: np.ndarray, x: np.ndarray, of: np.ndarray, curvature: bool) -> np.ndarray:
    """Loss, gradient by w and, if asked for, curvature that rows give with the sums over their partners (1, s, s**2, and x)."""
    n, total = of[:, 0], of[:, 1]
    short = np.where(right, n * (1 - s) + total, n * (1 + s) - total)
    loss = np.where(right, n * (1 - s) ** 2 + 2 * (1 - s) * total + of[:, 2], 0).sum()
    parts = [[loss], (np.where(right, -2, 2) * short) @ x]
    if curvature:
        parts.append((x.T @ (2 * (n[:, None] * x - of[:, 3:]))).ravel())
    return np.concatenate(parts)


def _dense(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """Rows as ``dim`` values; features beyond are dropped."""
    x = matrix(column)
    if isinstance(x, SparseRows):
        return x.dense(dim)
    return x[:, :dim] if x.shape[1] >= dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


class PairLoss:
    """|w|**2 / 2 + C times the squared hinge over all pairs of df (id, x, rank); rows without a rank are left out."""

    def __init__(self, df: DataFrame, dim: int, c: float, block: int | None = None):
        self.dim, self.c, self.block = dim, c, block or BLOCK
        places = ranked(df.where("rank is not null").select("id", "x", "rank"), [], ["rank", "id"], "pos")
        self.rows = stored(places.select("pos", F.floor(F.col("pos") / self.block).cast("long").alias("block"), "x"), "rank-rows")
        last = self.rows.agg(F.max("pos")).first()[0]
        self.places = 0 if last is None else int(last) + 1
        self.levels = 0 if last is None else int(last // self.block).bit_length()

    def at(self, w: np.ndarray, curvature: bool = False) -> tuple[float, np.ndarray, np.ndarray | None]:
        """(objective, gradient, curvature or None) at w."""
        dim, block = self.dim, self.block
        size = 1 + dim + (dim * dim if curvature else 0)

        def values(s: np.ndarray, x: np.ndarray) -> np.ndarray:
            return np.column_stack([np.ones(len(s)), s, s * s, *([x] if curvature else [])])

        def inside(part: pa.Table) -> pa.Table:
            part = part.sort_by("pos")
            x = _dense(part.column("x"), dim)
            s, place, total = x @ w, part.column("pos").to_numpy() % block, np.zeros(size)
            v = values(s, x)
            for level in range((block - 1).bit_length()):
                right = (place >> level & 1).astype(bool)
                total += _derived(right, s, x, _partners(place >> level + 1, right, np.where(right, s, s + 1), v), curvature)
            return pa.table({"total": pa.array([total.tobytes()], pa.binary())})

        sums = _added(self.rows.groupBy("block").applyInArrow(inside, "total binary"), size)
        if self.levels:
            sums = sums + self._across(w, curvature, size, values)
        w_part = (float(w @ w / 2), w, np.eye(dim) if curvature else None)
        bend = w_part[2] + self.c * sums[1 + dim :].reshape(dim, dim) if curvature else None
        return w_part[0] + self.c * float(sums[0]), w + self.c * sums[1 : 1 + dim], bend

    def _across(self, w: np.ndarray, curvature: bool, size: int, values) -> np.ndarray:
        """What pairs of different blocks give: each row once a level, sorted by node and score over ranges."""
        dim = self.dim
        kind = self.rows.schema["x"].dataType.simpleString()

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                s = _times(matrix(batch.column("x")), w) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("pos", "block", "x")), pa.array(np.asarray(s, np.float64))], ["pos", "block", "x", "s"])

        each = F.explode(F.sequence(F.lit(0), F.lit(self.levels - 1))).alias("level")
        rows = self.rows.select("pos", "block", "x").mapInArrow(scored, f"pos long, block long, x {kind}, s double").select("*", each)
        right = F.expr("(shiftright(block, level) & 1) = 1")
        rows = rows.select("level", F.expr("shiftright(block, level + 1)").alias("node"), right.alias("right"), F.when(right, F.col("s")).otherwise(F.col("s") + 1).alias("key"), "s", "x", "pos")
        # Each range is one task's, with a row's sums over its partners: of bounded size, whatever the table.
        parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.levels * self.places // RANGE))
        # Equal scores, as all are at first, are dealt by place; their order does not matter, as such pairs have no loss.
        ranges = stored(rows.repartitionByRange(parts, "level", "node", "key", "pos").drop("pos").withColumn("part", F.spark_partition_id()), "rank-ranges")

        def columns(part: pa.Table) -> tuple[np.ndarray, ...]:
            x, s, right = _dense(part.column("x"), dim), part.column("s").to_numpy(), part.column("right").combine_chunks().to_numpy(zero_copy_only=False)
            return part.column("level").to_numpy().astype(np.int64) * (1 << 48) + part.column("node").to_numpy(), right, part.column("key").to_numpy(), s, x

        def totals(part: pa.Table) -> pa.Table:
            node, right, _, s, x = columns(part)
            names, at = np.unique(node, return_inverse=True)
            v = values(s, x)
            both = np.zeros((2, len(names), v.shape[1]))
            np.add.at(both, (right.astype(int), at), v)
            number = part.column("part")[0].as_py()
            return pa.table({"part": pa.array([number] * len(names), pa.int32()), "node": pa.array(names), "sums": pa.array([b.tobytes() for b in both.transpose(1, 0, 2)], pa.binary())})

        # A row for each range and node that reach into each other: at most ranges and blocks together.
        found = ranges.groupBy("part").applyInArrow(totals, "part int, node long, sums binary").toArrow()
        number, node = found.column("part").to_numpy(), found.column("node").to_numpy()
        sums = np.array([np.frombuffer(b.as_py()).reshape(2, -1) for b in found.column("sums")])
        carried = {}
        for name in np.unique(node):
            at = np.flatnonzero(node == name)
            at = at[np.argsort(number[at])]
            before = np.cumsum(sums[at], 0)
            for k, a in enumerate(at):
                carried[int(number[a]), int(name)] = (before[-1, 0] - before[k, 0], before[k, 1] - sums[a, 1])
        shared = self.rows.sparkSession.sparkContext.broadcast(carried)

        def derived(part: pa.Table) -> pa.Table:
            node, right, key, s, x = columns(part)
            mine = [shared.value[part.column("part")[0].as_py(), int(name)] for name in np.unique(node)]
            of = _partners(node, right, key, values(s, x), tuple(np.array(m) for m in zip(*mine, strict=True)))
            return pa.table({"total": pa.array([_derived(right, s, x, of, curvature).tobytes()], pa.binary())})

        out = _added(ranges.groupBy("part").applyInArrow(derived, "total binary"), size)
        shared.destroy()
        dropped(ranges)
        return out

    def fit(self, tol: float = 1e-5, max_iter: int = 60) -> LinearModel:
        """Newton's method with halved steps; ends when no part of the gradient exceeds ``tol`` of that at 0."""
        w, turn = np.zeros(self.dim), 0
        objective, gradient, bend = self.at(w, True)
        enough = tol * max(1.0, float(np.abs(gradient).max(initial=0)))
        while np.abs(gradient).max(initial=0) > enough:
            if turn >= max_iter:
                raise NotConverged(f"the gradient is {np.abs(gradient).max():g} after {turn} steps")
            step, size = np.linalg.solve(bend, -gradient), 1.0
            slope = float(gradient @ step)
            while True:
                found = self.at(w + size * step, True)
                if found[0] <= objective + 1e-4 * size * slope + 1e-12 * abs(objective) or size < 1e-6:
                    break
                size /= 2
            w, turn = w + size * step, turn + 1
            objective, gradient, bend = found
        return LinearModel(w, objective, float(np.abs(gradient).max(initial=0)), float("nan"), turn)

    def done(self) -> None:
        dropped(self.rows)


def _added(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of packed vectors, partition by partition before they leave."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for x in batch.column(0):
                total += np.frombuffer(x.as_py())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    return np.sum([np.frombuffer(r.total) for r in rows.mapInArrow(joined, "total binary").collect()] or [np.zeros(size)], axis=0)


def fit_ranker(df: DataFrame, dim: int, c: float = 1.0, tol: float = 1e-5) -> LinearModel:
    """A linear ranker over all pairs of df (id, x, rank), which are never formed."""
    loss = PairLoss(df, dim, c)
    try:
        return loss.fit(tol)
    finally:
        loss.done()


def rank_experiment(train: DataFrame, test: DataFrame, dim: int, c: float = 1.0) -> tuple[LinearModel, DataFrame]:
    """A linear ranker of the pairs of ``train``, and its concordance on ``test``; both id, x, rank."""
    model = fit_ranker(train, dim, c)
    w = model.w

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_times(matrix(batch.column(0)), w) if batch.num_rows else [], pa.float64()), batch.column(1)], ["score", "rank"])

    kind = test.schema["rank"].dataType.simpleString()
    return model, concordance(test.select("x", "rank").mapInArrow(score, f"score double, rank {kind}"))
