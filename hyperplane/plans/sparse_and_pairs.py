"""Queries of steps over sparse columns, the loss over all pairs, dual coordinate descent, covariances and matrix rows; registered beside the catalogue's."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import vectors as V
from ..functions.sql_functions import register
from ..operators import covariance, gram, ranking, similar, validation
from ..operators import solver_steps as S
from ..operators.dual_coordinate import fit_dual
from ..operators.estimator import KernelSVC, primal_scores
from .catalogue import DIM, PAIR, SPARSE_V, C, ends, neighbours, problem, query, rounded, sparse_problem, sql_round

PAIRS = ", ".join(f"({sql_round(k.sql('a.x', 'b.x'))}) AS {k.name}" for k in K.ALL)


@query("sparse_pair_kernels", SPARSE_V + f" SELECT a.id, {PAIRS} FROM s a JOIN s b ON b.id = a.id + 1")
def _(spark, d):
    p = sparse_problem(spark, d)
    both = p.select("id", "x").join(p.select((F.col("id") - 1).alias("id"), F.col("x").alias("z")), "id")
    return both.select("id", *(rounded(k.expr(F.col("x"), F.col("z"), True)).alias(k.name) for k in K.ALL))


query("sparse_kernel_diag", SPARSE_V + f" SELECT id, {sql_round(K.POLY.sql('x', 'x'))} AS k FROM s")(
    lambda spark, d: gram.diagonal(sparse_problem(spark, d), K.POLY).withColumn("k", rounded(F.col("k")))
)
query(
    "sparse_q_two_rows",
    SPARSE_V + f" SELECT a.id AS i, b.id, {sql_round('a.y * b.y * ' + K.RBF.sql('a.x', 'b.x'))} AS q FROM s a, s b WHERE a.id IN ((SELECT min(id) FROM s), (SELECT max(id) FROM s))",
)(lambda spark, d: gram.q_rows(p := sparse_problem(spark, d), ends(p, True), K.RBF).withColumn("q", rounded(F.col("q"))))

STATE = SPARSE_V.replace(", s AS (", ", s0 AS (") + f", s AS (SELECT a.id, any_value(a.x) AS x, any_value(a.y) AS y, any_value(a.alpha) AS alpha, any_value(a.y) * sum(b.alpha * b.y * {K.RBF.sql('a.x', 'b.x')}) - 1 AS g FROM s0 a, s0 b GROUP BY a.id)"
GAIN = f"pow(m + s.y * s.g, 2) / greatest({K.RBF.sql('a.x', 'a.x')} + {K.RBF.sql('s.x', 's.x')} - 2 * {K.RBF.sql('a.x', 's.x')}, 1e-12)"
query(
    "sparse_working_pair",
    STATE + PAIR.replace("id DESC", "id") + f", t AS (SELECT w.i, w.m, s.id, CASE WHEN ((s.y = 1 AND s.alpha > 0) OR (s.y = -1 AND s.alpha < 1)) AND m + s.y * s.g > 0 THEN {GAIN} END AS gain FROM w JOIN s a ON a.id = w.i, s)"
    f" SELECT i, {sql_round('m')} AS m, id AS j, {sql_round('gain')} AS gain FROM t WHERE gain IS NOT NULL ORDER BY round(gain, 9) DESC, id LIMIT 1",
)(lambda spark, d: S.second_order_pair(S.dual_gradient(sparse_problem(spark, d), K.RBF), C, K.RBF).select("i", rounded(F.col("m")).alias("m"), "j", rounded(F.col("gain")).alias("gain")))

WEIGHTS = SPARSE_V + ", uu AS (SELECT i AS idx, sum(alpha * y * x[i]) AS w FROM s, (SELECT unnest(range(1, 6)) AS i) GROUP BY i), ww AS (SELECT list(w ORDER BY idx) AS w FROM uu)"
query("sparse_gradient_rows", WEIGHTS + f" SELECT id, {sql_round('y * list_dot_product(ww.w, x) + alpha / 2 - 1')} AS g FROM s, ww")(
    lambda spark, d: S.linear_gradient(sparse_problem(spark, d), C).select("id", rounded(F.col("g")).alias("g"))
)
query("sparse_linear_objective", WEIGHTS + f" SELECT {sql_round('((SELECT sum(w * w) FROM uu) + (SELECT sum(alpha * (alpha / 2 - 2)) FROM s)) / 2')} AS objective")(
    lambda spark, d: S.linear_objective(sparse_problem(spark, d), C).select(rounded(F.col("objective")).alias("objective"))
)
query("sparse_score_primal", WEIGHTS + f" SELECT id, {sql_round('list_dot_product(ww.w, x)')} AS score FROM s, ww")(
    lambda spark, d: primal_scores(p := sparse_problem(spark, d), S.weight_vector(S.weights_of(p))).select("id", rounded(F.col("score")).alias("score"))
)

#: The fixed model at which the loss over pairs is taken, by feature from 1.
PAIR_WEIGHT = "((i * 37) % 11 - 5) * 0.2"


@query(
    "ranking_pair_loss",
    f"""WITH w AS (SELECT list({PAIR_WEIGHT}::double ORDER BY i) AS w FROM (SELECT unnest(range(1, {DIM + 1})) AS i)),
t AS (SELECT id, label, x, list_dot_product(x, w) AS s FROM v, w),
p AS (SELECT a.x AS ax, b.x AS bx, 1 - a.s + b.s AS h FROM t a JOIN t b ON (a.label > b.label OR a.label = b.label AND a.id > b.id) WHERE 1 - a.s + b.s > 0)
SELECT i::bigint AS idx, {sql_round('sum(h * h) + any_value(list_dot_product(w, w)) / 2')} AS loss, {sql_round('sum(-2 * h * (ax[i] - bx[i])) + any_value(w[i])')} AS gradient
FROM p, w, (SELECT unnest(range(1, {DIM + 1})) AS i) GROUP BY i""",
)
def _(spark, d):
    import numpy as np

    loss = ranking.PairLoss(problem(spark, d).withColumn("rank", F.col("label")), DIM, 1.0)
    i = np.arange(1, DIM + 1)
    value, gradient, _ = loss.at(((i * 37) % 11 - 5) * 0.2)
    loss.done()
    return spark.createDataFrame([(int(k), float(value), float(g)) for k, g in zip(i, gradient, strict=True)], "idx long, loss double, gradient double").select(
        "idx", rounded(F.col("loss")).alias("loss"), rounded(F.col("gradient")).alias("gradient")
    )


@query("train_linear_dual", "SELECT true AS box_ok, true AS weights_ok, true AS gap_ok, count(*) AS n FROM v")
def _(spark, d):
    """Conditions of the optimum, taken from the table of alphas: the box, w as their sum, and the gap of objectives."""
    p = problem(spark, d)
    found = fit_dual(p, DIM, 0.1)
    rows = found.alphas.select("id", "alpha").join(p.drop("alpha"), "id")
    w = [r.w for r in S.weights_of(rows).orderBy("idx").collect()]
    off = max((abs(a - b) for a, b in zip(w, found.w, strict=False)), default=0.0)
    return rows.agg((F.min("alpha") >= 0).alias("box_ok"), F.lit(bool(off < 1e-6)).alias("weights_ok"), F.lit(bool(-1e-9 <= found.gap <= 1e-3 * abs(found.objective))).alias("gap_ok"), F.count(F.lit(1)).alias("n"))


# Covariances and matrices.


def cells(spark, matrix):
    rows = [(i + 1, j + 1, float(matrix[i][j])) for i in range(DIM) for j in range(DIM)]
    return spark.createDataFrame(rows, "i long, j long, value double").withColumn("value", rounded(F.col("value")))


query("covariance_matrix", f"SELECT a.idx::bigint AS i, b.idx::bigint AS j, {sql_round('covar_samp(a.val, b.val)')} AS value FROM (SELECT id, i AS idx, x[i] AS val FROM v, (SELECT unnest(range(1, 65)) AS i)) a JOIN (SELECT id, i AS idx, x[i] AS val FROM v, (SELECT unnest(range(1, 65)) AS i)) b ON a.id = b.id GROUP BY a.idx, b.idx")(
    lambda spark, d: cells(spark, covariance.covariance(problem(spark, d), DIM)[1])
)


@query("whitened_covariance", "SELECT a.i::bigint AS i, b.i::bigint AS j, (a.i = b.i)::int::double AS value FROM (SELECT unnest(range(1, 65)) AS i) a, (SELECT unnest(range(1, 65)) AS i) b")
def _(spark, d):
    """The covariance of rows whitened by the inverse of theirs: the unit matrix."""
    p = problem(spark, d)
    return cells(spark, covariance.covariance(covariance.whitened(p, covariance.fitted(p, DIM, 0.0)), DIM)[1])


#: The kernel of two features by the closed inverse of their covariance.
query(
    "kernel_mahalanobis_fitted",
    f"""WITH m AS (SELECT var_samp(x[1]) AS p, covar_samp(x[1], x[2]) AS q, var_samp(x[2]) AS r FROM v)
SELECT a.id, {sql_round('(r * a.x[1] * b.x[1] - q * (a.x[1] * b.x[2] + a.x[2] * b.x[1]) + p * a.x[2] * b.x[2]) / (p * r - q * q)')} AS value FROM v a JOIN v b ON b.id = a.id + 1, m""",
)(
    lambda spark, d: (lambda p: p.join(p.select((F.col("id") - 1).alias("id"), F.col("x").alias("z")), "id").select("id", rounded(covariance.fitted(p, 2, 0.0).expr(F.col("x"), F.col("z"))).alias("value")))(
        problem(spark, d).select("id", F.slice("x", 1, 2).alias("x"))
    )
)


def squares(spark, d):
    """The problem with x as a matrix of eight rows."""
    return problem(spark, d).withColumn("x", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.slice("x", k * 8 + 1, 8)))


query(
    "score_dual_frobenius",
    f"WITH c AS (SELECT a.id, sum(b.alpha * b.y * {K.LINEAR.sql('a.x', 'b.x')}) AS score FROM v a, v b GROUP BY a.id) SELECT id, {sql_round('score')} AS score, CASE WHEN score < 0 THEN -1 ELSE 1 END AS pred FROM c",
)(lambda spark, d: gram.scores(p := squares(spark, d), S.support_vectors(p), K.Frobenius()).select("id", rounded(F.col("score")).alias("score"), "pred"))
query("search_frobenius", None)(lambda spark, d: validation.search_c(squares(spark, d), lambda gamma: K.Frobenius(), 5, [0.125, 1.0]))


@query("train_frobenius", "SELECT true AS equal, count(*) AS n FROM v")
def _(spark, d):
    """Whether training on matrices gives the support and alphas that the linear kernel gives on their values in a row."""
    rows = squares(spark, d).select("id", "x", F.col("y").alias("label"))
    flat = rows.withColumn("x", F.flatten("x"))
    models = [KernelSVC(k, 0.1).fit(r).model.select("sv_id", F.round("alpha", 6).alias("alpha")) for k, r in ((K.Frobenius(), rows), (K.LINEAR, flat))]
    off = models[0].join(models[1].withColumnRenamed("alpha", "other"), "sv_id", "full_outer").agg(F.count(F.when(~F.col("alpha").eqNullSafe(F.col("other")), 1)).alias("off"))
    return rows.agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(off)).select((F.col("off") == 0).alias("equal"), "n")


@query(
    "topn_sparse",
    f"""WITH e AS (SELECT l_orderkey AS id, l_partkey AS idx, sum(l_quantity)::double AS val FROM lineitem GROUP BY ALL),
p AS (SELECT a.id, b.id AS other, sum(a.val * b.val) AS k FROM e a JOIN e b ON a.idx = b.idx AND a.id <> b.id GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(k, 9) DESC, other) AS rank FROM p)
SELECT id, rank::int AS rank, other, {sql_round('k')} AS k FROM t WHERE rank <= 3""",
    view=False,
)
def _(spark, d):
    """Of each order, the three others that share most: vectors of quantities by part."""
    lines = spark.read.parquet(f"{d}/lineitem.parquet").groupBy(F.col("l_orderkey").alias("id"), F.col("l_partkey").alias("idx")).agg(F.sum("l_quantity").alias("val"))
    return similar.topn_sparse(V.sparse(lines), 3).select("id", "rank", "other", rounded(F.col("k")).alias("k"))


@query("sql_kernel_functions", "SELECT a.id, " + ", ".join(f"{sql_round(k.sql('a.x', 'b.x'))} AS {k.name}" for k in (K.LINEAR, K.RBF, K.POLY)) + " FROM v a JOIN v b ON b.id = a.id + 1")
def _(spark, d):
    """Kernels called by name in Spark's SQL."""
    register(spark)
    pairs = neighbours(problem(spark, d))
    return pairs.selectExpr("id", *(f"round(kernel_{k.name}(x, z), 6) + 0D AS {k.name}" for k in (K.LINEAR, K.RBF, K.POLY)))
