"""Steps of dual SVM training as one-shot DataFrame operators.

A *state* is a table (id, y, alpha, g): labels of +1 or -1, dual variables in
[0, C], and the gradient g of the dual objective.  Extremes break ties by the
smallest id (``first``) or the largest (``last``); rows outside a set give a
null ordering, which the aggregates skip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.kernels import Kernel
from ..functions.vectors import dot, entries, is_sparse
from .gram import against

EPS = 1e-3
FLOOR = 1e-12


def binarized(label: Column) -> Column:
    return F.when(label > 0, 1).otherwise(-1)


def alpha_status(c: float) -> Column:
    a = F.col("alpha")
    return F.when(a >= c, "upper").when(a <= 0, "lower").otherwise("free")


def in_up(c: float) -> Column:
    """Rows whose y alpha may grow."""
    y, a = F.col("y"), F.col("alpha")
    return ((y == 1) & (a < c)) | ((y == -1) & (a > 0))


def in_low(c: float) -> Column:
    y, a = F.col("y"), F.col("alpha")
    return ((y == 1) & (a > 0)) | ((y == -1) & (a < c))


def dual_gradient(df: DataFrame, kernel: Kernel) -> DataFrame:
    """df (id, x, y, alpha) with g = y sum_j alpha_j y_j K - 1; rows with alpha 0 add nothing and are left out of the pairs."""
    active = df.where("alpha > 0").select("id", "x", "y", "alpha")
    sums = against(df, active, kernel, ["y", "alpha"], {"f": ("dot", lambda b: b["alpha"] * b["y"])})
    return df.join(sums, "id").withColumn("g", F.col("y") * F.col("f") - 1).drop("f")


def reconstructed(df: DataFrame, kernel: Kernel, bounded: DataFrame, c: float) -> DataFrame:
    """(id, g) of the rows at a bound, from the part of the gradient that rows at C give them (``bounded``: id, f) and from the free rows.

    While shrunk rows stay at their bounds, ``bounded`` holds, so that only free rows are met again.
    """
    free = df.where((F.col("alpha") > 0) & (F.col("alpha") < c)).select("id", "x", "y", "alpha")
    rest = df.where((F.col("alpha") <= 0) | (F.col("alpha") >= c))
    sums = against(rest, free, kernel, ["y", "alpha"], {"f": ("dot", lambda b: b["alpha"] * b["y"])})
    both = rest.select("id", "y").join(sums, "id").join(bounded.select("id", F.col("f").alias("held")), "id")
    return both.select("id", (F.col("y") * (F.col("f") + F.col("held")) - 1).alias("g"))


def bounded_part(df: DataFrame, kernel: Kernel, c: float) -> DataFrame:
    """(id, f): sums of alpha y K over the rows at C."""
    top = df.where(F.col("alpha") >= c).select("id", "x", "y", "alpha")
    return against(df, top, kernel, ["y", "alpha"], {"f": ("dot", lambda b: b["alpha"] * b["y"])})


def _ordered(value: Column, tie: str) -> Column:
    return F.struct(value.alias("v"), (-F.col("id") if tie == "first" else F.col("id")).alias("t"))


def working_pair(state: DataFrame, c: float, tie: str = "last") -> DataFrame:
    """First-order pair: i with the greatest -y g of those that may grow, j with the greatest y g of those that may fall; one pass."""
    v = -F.col("y") * F.col("g")
    up = F.when(in_up(c), _ordered(v, tie))
    low = F.when(in_low(c), _ordered(-v, tie))
    return state.agg(F.max_by("id", up).alias("i"), F.max(F.when(in_up(c), v)).alias("m"), F.max_by("id", low).alias("j"), F.max(F.when(in_low(c), -v)).alias("mm"))


def optimality_gap(state: DataFrame, c: float) -> DataFrame:
    pair = working_pair(state, c)
    return pair.select((F.col("m") + F.col("mm")).alias("gap"), ((F.col("m") + F.col("mm")) < EPS).alias("optimal"))


def second_order_pair(state: DataFrame, c: float, kernel: Kernel, tie: str = "first") -> DataFrame:
    """i as in the first order; j with the greatest second-order gain d**2 / q, d = m + y g, of those that may fall with d > 0.  state has x."""
    state, sparse = entries(state), is_sparse(state)
    i = working_pair(state, c, tie).select(F.col("i").alias("id"), "m")
    row = state.join(F.broadcast(i), "id").select(F.col("id").alias("i"), "m", F.col("x").alias("xi"))  # one row
    d = F.col("m") + F.col("y") * F.col("g")
    k = lambda a, b: kernel.expr(F.col(a), F.col(b), sparse)
    q = k("xi", "xi") + k("x", "x") - 2 * k("xi", "x")
    gain = d * d / F.when(q <= 0, FLOOR).otherwise(q)
    use = in_low(c) & (d > 0)
    scored = state.join(F.broadcast(row)).select("i", "m", "id", F.when(use, gain).alias("gain"))
    return scored.groupBy("i", "m").agg(F.max_by("id", F.when(F.col("gain").isNotNull(), _ordered(F.round("gain", 9), tie))).alias("j"), F.max("gain").alias("gain"))


def kkt_violators(state: DataFrame, c: float, tol: float = 0.01) -> DataFrame:
    """Rows whose error y E = g breaks the optimality conditions: below -tol with room to grow, or above tol with room to fall."""
    return state.where(((F.col("g") < -tol) & (F.col("alpha") < c)) | ((F.col("g") > tol) & (F.col("alpha") > 0)))


def widest_error(state: DataFrame, c: float, against_id: int | None = None) -> DataFrame:
    """Of free rows, the one whose error y g differs most from that of a given row (the smallest id by default)."""
    e = F.col("y") * F.col("g")
    first = state.agg(F.min_by(e, "id").alias("e1")) if against_id is None else state.where(F.col("id") == against_id).select(e.alias("e1"))
    free = state.where((F.col("alpha") > 0) & (F.col("alpha") < c)).join(F.broadcast(first))
    gap = F.round(F.abs(e - F.col("e1")), 9)
    return free.agg(F.max_by("id", F.struct(gap, -F.col("id"))).alias("id"), F.max(gap).alias("gap"))


def shrink_candidates(state: DataFrame, c: float) -> DataFrame:
    """Rows at a bound whose gradient lies beyond the opposite extreme; they can't be chosen for a pair soon."""
    bounds = working_pair(state, c).select("m", "mm")
    y, g = F.col("y"), F.col("g")
    up = (F.col("alpha") >= c) & F.when(y == 1, -g > F.col("m")).otherwise(-g > F.col("mm"))
    low = (F.col("alpha") <= 0) & F.when(y == 1, g > F.col("mm")).otherwise(g > F.col("m"))
    return state.join(F.broadcast(bounds)).where(up | low).drop("m", "mm")


def pair_step(yi: Column, yj: Column, ai: Column, aj: Column, gi: Column, gj: Column, kii: Column, kjj: Column, kij: Column, c: float) -> tuple[Column, Column]:
    """New alpha of a pair after the analytic step along (y_i, -y_j), clipped to the box."""
    d = -yi * gi + yj * gj
    q = kii + kjj - 2 * kij
    t = d / F.when(q <= 0, FLOOR).otherwise(q)
    room_i = F.when(yi == 1, c - ai).otherwise(ai)
    room_j = F.when(yj == 1, aj).otherwise(c - aj)
    t = F.least(t, room_i, room_j)
    return ai + yi * t, aj - yj * t


def rank_two_update(g: Column, qi: Column, qj: Column, di: Column, dj: Column) -> Column:
    return g + qi * di + qj * dj


def rho(state: DataFrame, c: float) -> DataFrame:
    """Mean of y g over free rows; without any, the middle of the bounds that rows at 0 and C set."""
    y, a, v = F.col("y"), F.col("alpha"), F.col("y") * F.col("g")
    free = (a > 0) & (a < c)
    upper = ((a >= c) & (y == -1)) | ((a <= 0) & (y == 1))
    lower = ((a >= c) & (y == 1)) | ((a <= 0) & (y == -1))
    out = state.agg(F.avg(F.when(free, v)).alias("free"), F.min(F.when(upper, v)).alias("ub"), F.max(F.when(lower, v)).alias("lb"), F.sum(F.when(free, 1).otherwise(0)).alias("n_free"))
    middle = (F.coalesce("ub", "lb") + F.coalesce("lb", "ub")) / 2
    return out.select(F.coalesce("free", middle, F.lit(0.0)).alias("rho"), F.col("n_free").cast("long").alias("n_free"))


def dual_objective(state: DataFrame) -> DataFrame:
    return state.agg((F.sum(F.col("alpha") * (F.col("g") - 1)) / 2).alias("objective"))


def support_vectors(state: DataFrame) -> DataFrame:
    return state.where(F.abs("alpha") > 0)


# Steps of linear (primal weight) training with squared hinge loss: long form of the vectors, weights by index.


def weights_of(df: DataFrame) -> DataFrame:
    """(idx, w): w = sum alpha y x by feature index, from the long form; partial sums before the shuffle."""
    s = (F.col("alpha") * F.col("y")).alias("s")
    if is_sparse(df):
        return entries(df).where("alpha <> 0").select(s, F.inline("x")).groupBy("idx").agg(F.sum(F.col("s") * F.col("val")).alias("w"))
    rows = df.where("alpha <> 0").select(s, F.posexplode("x").alias("pos", "val"))
    return rows.groupBy((F.col("pos") + 1).alias("idx")).agg(F.sum(F.col("s") * F.col("val")).alias("w"))


def weight_vector(w: DataFrame) -> DataFrame:
    """One row with the weights as an array in order of index."""
    return w.agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "w"))), lambda e: e["w"]).alias("w"))


def linear_gradient(df: DataFrame, c: float) -> DataFrame:
    """df (id, x, y, alpha) with g = y w.x + alpha / (2 C) - 1.

    Of dense rows, the weights, as many as features, are broadcast; sparse rows
    meet theirs by index, so that neither side has to fit a worker.
    """
    rest = F.col("alpha") / (2 * c) - 1
    if is_sparse(df):
        products = entries(df).select("id", F.inline("x")).join(weights_of(df), "idx").groupBy("id").agg(F.sum(F.col("w") * F.col("val")).alias("_wx"))
        return df.join(products, "id", "left").withColumn("g", F.col("y") * F.coalesce("_wx", F.lit(0.0)) + rest).drop("_wx")
    w = weight_vector(weights_of(df))
    return df.join(F.broadcast(w)).withColumn("g", F.col("y") * dot(F.col("w"), F.col("x")) + rest).drop("w")


def linear_objective(df: DataFrame, c: float) -> DataFrame:
    """(|w|**2 + sum alpha (alpha / (2 C) - 2)) / 2."""
    square = weights_of(df).agg(F.sum(F.col("w") * F.col("w")).alias("ww"))
    rest = df.agg(F.sum(F.col("alpha") * (F.col("alpha") / (2 * c) - 2)).alias("rest"))
    return square.join(F.broadcast(rest)).select(((F.coalesce("ww", F.lit(0.0)) + F.col("rest")) / 2).alias("objective"))


def projected_norm(gradient: DataFrame) -> DataFrame:
    """Largest absolute gradient, taken as min(0, g) where alpha is 0."""
    p = F.when(F.col("alpha") <= 0, F.least(F.col("g"), F.lit(0.0))).otherwise(F.col("g"))
    return gradient.agg(F.max(F.abs(p)).alias("norm"))


def bb_steps(steps: DataFrame) -> DataFrame:
    """Both Barzilai-Borwein steps from rows (s, d): differences of alpha and of the gradient."""
    sums = steps.agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.sum(F.col("s") * F.col("d")).alias("sd"), F.sum(F.col("d") * F.col("d")).alias("dd"))
    return sums.select((F.col("ss") / F.col("sd")).alias("step1"), (F.col("sd") / F.col("dd")).alias("step2"))
