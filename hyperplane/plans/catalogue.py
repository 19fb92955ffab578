"""One query per operator over whole tables, and equivalent DuckDB SQL.

The problem is ``embeddings``: x the vector as doubles, y +1 for labels under 5
and -1 otherwise.  The fixed model gives every row alpha = (id * 7919 mod 11) / 10
with C = 1, so rows lie at both bounds and between.  Values are rounded to six
places; adding 0.0 turns a negative zero into zero on both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import vectors as V
from ..operators import decomposition, formats, gram, linear, ranking, ranks, transforms, validation
from ..operators import solver_steps as S
from ..operators.estimator import KernelSVC
from ..operators.linear import LinearClassifier, fit_barzilai_borwein, fit_conjugate_gradient, fit_squared_hinge
from ..sources.tables import stored

C = 1.0
DIM = 64
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

VIEW = """WITH v AS (
  SELECT vec_id AS id, list_transform(embedding, lambda e: e::double) AS x, label, CASE WHEN label < 5 THEN 1 ELSE -1 END AS y, ((vec_id * 7919) % 11) * 0.1::double AS alpha FROM embeddings
), h AS (
  SELECT id, list_transform(x, lambda e: abs(e) / list_sum(list_transform(x, lambda f: abs(f)))) AS x, label, y, alpha FROM v
), l AS (
  SELECT id, i AS idx, x[i] AS val FROM v, (SELECT unnest(range(1, 65)) AS i) WHERE x[i] <> 0
), r AS (
  SELECT user_id AS id, CASE event_type {types} END AS idx, count(*)::double AS val FROM events GROUP BY ALL
)"""


def problem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, x, label, y, alpha) of the embeddings."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    id_ = F.col("vec_id")
    return e.select(id_.alias("id"), V.doubles(F.col("embedding")).alias("x"), "label", F.when(F.col("label") < 5, 1).otherwise(-1).alias("y"),
        (((id_ * 7919) % 11) * F.lit(0.1)).alias("alpha"))


def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return problem(spark, sf_dir).withColumn("x", V.histogram(F.col("x")))


def event_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, idx, val): events per user and type, types numbered in alphabetic order from 1."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    number = F.coalesce(*[F.when(F.col("event_type") == t, i + 1) for i, t in enumerate(EVENT_TYPES)])
    return e.groupBy(F.col("user_id").alias("id"), number.alias("idx")).agg(F.count(F.lit(1)).cast("double").alias("val"))


#: The event types of the driver's tables, in alphabetic order (fixed values).
EVENT_TYPES = ("click", "error", "purchase", "signup", "view")


def rounded(e, n: int = 6):
    return F.round(e, n) + F.lit(0.0)


def sql_round(e: str) -> str:
    return f"round({e}, 6) + 0.0::double"


def query(name: str, sql: str | None, view: bool = True):
    """Registers a query and its SQL, which sees the views v (problem), h (histograms), l (long form) and r (event counts)."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            types = " ".join(f"WHEN '{t}' THEN {i + 1}" for i, t in enumerate(EVENT_TYPES))
            body = sql.strip()
            SQL[name] = (VIEW.format(types=types) + (", " + body[5:] if body.upper().startswith("WITH ") else "\n" + body)) if view else body
        return f

    return put


# Vector functions.

for _name, _f, _sql in (
    ("vec_self_dot", V.self_dot, "list_dot_product(x, x)"),
    ("vec_sum", V.value_sum, "list_sum(x)"),
    ("vec_lp_norm1", lambda x: V.lp_norm(x, 1), "list_sum(list_transform(x, lambda e: abs(e)))"),
    ("vec_lp_norm2", lambda x: V.lp_norm(x, 2), "sqrt(list_dot_product(x, x))"),
    ("vec_lp_norm3", lambda x: V.lp_norm(x, 3), "pow(list_sum(list_transform(x, lambda e: pow(abs(e), 3::double))), 1::double / 3)"),
):
    query(_name, f"SELECT id, {sql_round(_sql)} AS value FROM v")(lambda spark, d, f=_f: problem(spark, d)
        .select("id", rounded(f(F.col("x"))).alias("value")))

query("vec_nnz", "SELECT id, len(list_filter(x, lambda e: e <> 0))::bigint AS nnz FROM v")(lambda spark, d: problem(spark, d)
    .select("id", V.nnz(F.col("x")).cast("long").alias("nnz")))
query("vec_preview", "SELECT id, len(x)::varchar || ':' || array_to_string(list_transform(list_filter(list_zip(range(1, len(x) + "
        "1), x), lambda p: p[2] <> 0)[1:5], lambda p: p[1]::varchar || '/' || printf('%.4f', p[2])), ' ') AS shown "
        "FROM v")(
    lambda spark, d: problem(spark, d).select("id", V.preview(F.col("x")).alias("shown"))
)


@query("vec_densify", f"SELECT id, len(x)::bigint AS dim, {sql_round('list_sum(list_transform(list_zip(x, range(1, len(x) + 1)), lambda p: p[1] * p[2]))')} "
        f"AS checksum FROM v")
def _(spark, d):
    dense = V.densified(V.to_long(problem(spark, d)), DIM)
    return dense.select("id", F.size("x").cast("long").alias("dim"),
        rounded(F.aggregate(F.transform("x", lambda v, i: v * (i + 1)), F.lit(0.0), lambda a, v: a + v)).alias("checksum"))


def neighbours(df: DataFrame) -> DataFrame:
    """Each row with that of the next id."""
    return df.select("id", "x").join(df.select((F.col("id") - 1).alias("id"), F.col("x").alias("z")), "id")


query("vec_pair_dot", f"SELECT a.id, {sql_round('list_dot_product(a.x, b.x)')} AS value FROM v a JOIN v b ON b.id = a.id + 1")(
    lambda spark, d: neighbours(problem(spark, d)).select("id", rounded(V.dot(F.col("x"), F.col("z"))).alias("value"))
)
query("vec_pair_subtract_norm", f"SELECT a.id, {sql_round('list_sum(list_transform(list_zip(a.x, b.x), lambda p: abs(p[1] - p[2])))')} AS value "
        f"FROM v a JOIN v b ON b.id = a.id + 1")(
    lambda spark, d: neighbours(problem(spark, d)).select("id", rounded(V.lp_norm(V.subtract(F.col("x"), F.col("z")), 1)).alias("value"))
)


def _shifted(r: DataFrame) -> DataFrame:
    """Each row under the id before its own."""
    return r.withColumn("id", F.col("id") - 1)


@query("sparse_dot_long", f"SELECT a.id, {sql_round('sum(a.val * b.val)')} AS value FROM r a JOIN r b ON b.id = a.id + 1 AND a.idx = "
        f"b.idx GROUP BY a.id")
def _(spark, d):
    r = event_long(spark, d)
    return V.long_dot(r, _shifted(r)).select("id", rounded(F.col("value")).alias("value"))


@query(
    "sparse_chi2_full_outer",
    f"""WITH b AS (SELECT id - 1 AS id, idx, val AS z FROM r), p AS (SELECT id FROM r INTERSECT SELECT id FROM b)
SELECT id, {sql_round("sum(pow(coalesce(val, 0) - coalesce(z, 0), 2) / (coalesce(val, 0) + coalesce(z, 0)))")} AS value FROM r FULL JOIN b USING (id, idx) JOIN p USING (id) GROUP BY id""",
)
def _(spark, d):
    r = event_long(spark, d)
    return V.long_chi2(r, _shifted(r)).select("id", rounded(F.col("value")).alias("value"))


@query(
    "sparse_subtract",
    f"""WITH b AS (SELECT id - 1 AS id, idx, val AS z FROM r), p AS (SELECT id FROM r INTERSECT SELECT id FROM b)
SELECT id, count(*)::bigint AS nnz, {sql_round("sum(coalesce(val, 0) - coalesce(z, 0))")} AS total FROM r FULL JOIN b USING (id, idx) JOIN p USING (id) WHERE coalesce(val, 0) <> coalesce(z, 0) GROUP BY id""",
)
def _(spark, d):
    r = event_long(spark, d)
    return V.long_subtract(r, _shifted(r)).groupBy("id").agg(F.count(F.lit(1)).alias("nnz"), rounded(F.sum("val")).alias("total"))


# Transforms.

for _p in (1, 2):
    _n = "list_sum(list_transform(x, lambda e: abs(e)))" if _p == 1 else "sqrt(list_dot_product(x, x))"
    query(f"transform_lp_norm{_p}", f"SELECT id, i::int AS idx, {sql_round(f'x[i] / {_n}')} AS val FROM v, (SELECT unnest(range(1, 65)) AS i)")(
        lambda spark, d, p=_p: transforms.lp_norm(problem(spark, d), p).select("id", F.posexplode("x").alias("pos", "val"))
            .select("id", (F.col("pos") + 1).alias("idx"), rounded(F.col("val")).alias("val"))
    )
query("transform_identity", f"SELECT id, {sql_round('list_sum(x)')} AS value FROM v")(lambda spark, d: transforms.identity(problem(spark, d))
    .select("id", rounded(V.value_sum(F.col("x"))).alias("value")))
query("transform_min_max", f"WITH e AS (SELECT idx, min(val) AS low, max(val) AS high FROM (SELECT id, i AS idx, x[i] AS val FROM v, "
        f"(SELECT unnest(range(1, 65)) AS i)) GROUP BY idx) SELECT "
        f"v.id, {sql_round('sum(CASE WHEN high = low THEN 0 ELSE (v.x[e.idx] - low) / (high - low) END)')} AS value "
        f"FROM v, e GROUP BY v.id")(
    lambda spark, d: transforms.min_max(problem(spark, d)).select("id", rounded(V.value_sum(F.col("x"))).alias("value"))
)

# Kernels: each row's sum over the whole table and largest value against another row.

for _k in K.ALL:
    _t = "h" if _k.histogram else "v"
    query(f"kernel_{_k.name}", f"SELECT a.id, {sql_round(f'sum({_k.sql("a.x", "b.x")})')} AS "
        f"row_sum, {sql_round(f'max(CASE WHEN a.id <> b.id THEN {_k.sql("a.x", "b.x")} END)')} AS largest FROM {_t} "
        f"a, {_t} b GROUP BY a.id")(
        lambda spark, d, k=_k: gram.row_sums((histograms if k.histogram else problem)(spark, d), k)
            .select("id", rounded(F.col("row_sum")).alias("row_sum"), rounded(F.col("largest")).alias("largest"))
    )
    query(f"kernel_{_k.name}_next", f"SELECT a.id, {sql_round(_k.sql('a.x', 'b.x'))} AS value FROM {_t} a JOIN {_t} b ON b.id = a.id + 1")(
        lambda spark, d, k=_k: neighbours((histograms if k.histogram else problem)(spark, d))
            .select("id", rounded(k.expr(F.col("x"), F.col("z"))).alias("value"))
    )
query("kernel_mahalanobis_diag",
    f"SELECT a.id, {sql_round('list_sum(list_transform(list_zip(a.x, b.x, range(1, 65)), lambda p: p[1] * p[2] / (1 + p[3] * 0.01::double)))')} "
        f"AS value FROM v a JOIN v b ON b.id = a.id + 1")(
    lambda spark, d: neighbours(problem(spark, d)).select("id", rounded(K.mahalanobis(F.col("x"), F.col("z"), F.transform(F.sequence(F.lit(1),
        F.lit(DIM)), lambda i: 1 / (1 + i * F.lit(0.01))))).alias("value"))
)
query("kernel_frobenius", f"SELECT a.id, {sql_round('list_dot_product(a.x, b.x)')} AS value FROM v a JOIN v b ON b.id = a.id + 1")(
    lambda spark, d: neighbours(problem(spark, d)).select("id", rounded(K.frobenius(_rows8("x"), _rows8("z"))).alias("value"))
)


def _rows8(c: str):
    """The vector as eight rows of eight."""
    return F.transform(F.sequence(F.lit(1), F.lit(57), F.lit(8)), lambda i: F.slice(c, i, F.lit(8)))


@query(
    "chi2_identity_diff",
    "SELECT round(max(abs(list_sum(a.x) + list_sum(b.x) - 4 * " + K.NCHI2.sql("a.x", "b.x") + " - " + K.CHI2.sql("a.x", "b.x")
        .replace("(1 - 0.5::double * ", "(").strip() + ")), 6) + 0.0::double AS diff FROM h a JOIN h b ON b.id = a.id + 1",
)
def _(spark, d):
    x, z = F.col("x"), F.col("z")
    distance = 2 * (1 - K.CHI2.expr(x, z))
    by_identity = V.value_sum(x) + V.value_sum(z) - 4 * K.NCHI2.expr(x, z)
    return neighbours(histograms(spark, d)).agg(rounded(F.max(F.abs(by_identity - distance))).alias("diff"))


# Kernel-matrix operators.

RBF_SQL = K.RBF.sql("a.x", "b.x")


def ends(df: DataFrame, both: bool) -> DataFrame:
    """Smallest id, and the largest."""
    return df.agg(F.explode(F.array(F.min("id"), F.max("id")) if both else F.array(F.min("id"))).alias("id"))


for _name, _both in (("q_row", False), ("q_two_rows", True)):
    query(_name, f"SELECT a.id AS i, b.id, {sql_round(f'a.y * b.y * {RBF_SQL}')} AS q FROM v a, v b WHERE a.id = (SELECT min(id) "
        f"FROM v){' OR a.id = (SELECT max(id) FROM v)' if _both else ''}")(
        lambda spark, d, both=_both: gram.q_rows(p := problem(spark, d), ends(p, both), K.RBF).withColumn("q", rounded(F.col("q")))
    )
query("kernel_diag", f"SELECT id, {sql_round(K.POLY.sql('x', 'x'))} AS k FROM v")(lambda spark, d: gram.diagonal(problem(spark, d), K.POLY)
    .withColumn("k", rounded(F.col("k"))))
query("gram_upper_stats", f"SELECT count(*)::bigint AS n, {sql_round(f'sum({RBF_SQL})')} AS total, {sql_round(f'min({RBF_SQL})')} AS "
        f"low, {sql_round(f'max({RBF_SQL})')} AS high FROM v a JOIN v b ON a.id < b.id")(
    lambda spark, d: gram.upper_stats(problem(spark, d), K.RBF).select("n", *[rounded(F.col(c)).alias(c) for c in ("total", "low", "high")])
)
query("topn_most_similar", "WITH p AS (SELECT a.id, b.id AS other, list_dot_product(a.x, b.x) AS k, row_number() OVER (PARTITION BY a.id "
        "ORDER BY round(list_dot_product(a.x, b.x), 9) DESC, b.id) AS rank FROM v a JOIN v b ON a.id <> b.id) SELECT "
        "id, rank::int AS rank, other, round(k, 6) + 0.0::double AS k FROM p WHERE rank <= 5")(
    lambda spark, d: gram.most_similar(problem(spark, d), K.LINEAR, 5)
        .select("id", F.col("rank").cast("int").alias("rank"), "other", rounded(F.col("k")).alias("k"))
)
query("topn_per_class", "WITH p AS (SELECT label, id, x[1] AS value, row_number() OVER (PARTITION BY label ORDER BY round(x[1], 9) "
        "DESC, id) AS rank FROM v) SELECT label, rank::int AS rank, id, round(value, 6) + 0.0::double AS value FROM p "
        "WHERE rank <= 5")(
    lambda spark, d: gram.topn(problem(spark, d).select("label", "id", F.col("x")[0].alias("value")), "label", 5, "value", "id")
        .select("label", F.col("rank").cast("int").alias("rank"), "id", rounded(F.col("value")).alias("value"))
)

# Labels and classes.

query("label_binarize", "SELECT label, CASE WHEN label - 4 > 0 THEN 1 ELSE -1 END AS y, count(*)::bigint AS n FROM v GROUP BY ALL")(
    lambda spark, d: problem(spark, d).groupBy("label", S.binarized(F.col("label") - 4).alias("y")).agg(F.count(F.lit(1)).alias("n"))
)
query("class_counts", "SELECT label, count(*)::bigint AS n, min(id) AS first FROM v GROUP BY label")(lambda spark, d: problem(spark, d)
    .groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")))


@query("class_group_perm", "WITH c AS (SELECT label, min(id) AS first, count(*) AS n FROM v GROUP BY label), s AS (SELECT a.label, "
        "coalesce(sum(b.n), 0) AS start FROM c a LEFT JOIN c b ON b.first < a.first GROUP BY a.label) SELECT id, "
        "(start + row_number() OVER (PARTITION BY label ORDER BY id) - 1)::bigint AS pos FROM v JOIN s USING (label)")
def _(spark, d):
    p = problem(spark, d).select("id", "label")
    starts = ranks.running(p.groupBy("label").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")), "first", {"n": "start"}).select("label",
        "start")
    return ranks.ranked(p, ["label"], ["id"], "r").join(starts, "label").select("id", (F.col("start") + F.col("r")).cast("long").alias("pos"))


@query("sign_group_perm", "SELECT id, (row_number() OVER (ORDER BY y DESC, id) - 1)::bigint AS pos FROM v")
def _(spark, d):
    p = problem(spark, d).select("id", F.col("y").alias("side"))
    above = p.where("side > 0").count()
    return ranks.ranked(p, ["side"], ["id"], "r").select("id", (F.col("r") + F.when(F.col("side") > 0, 0).otherwise(above)).alias("pos"))


@query("class_weights", "SELECT label, round(0.5::double * (1 + label * 0.25::double), 6) AS c, count(*)::bigint AS n FROM v GROUP BY "
        "label")
def _(spark, d):
    weights = spark.createDataFrame([(i, 1 + i * 0.25) for i in range(10)], "label int, weight double")
    return problem(spark, d).join(F.broadcast(weights), "label").groupBy("label", F.round(0.5 * F.col("weight"), 6).alias("c")).agg(F.count(F.lit(1))
        .alias("n"))


# Dual solver steps, on the gradient of the fixed model.

STATE = f"WITH s AS (SELECT a.id, any_value(a.x) AS x, any_value(a.y) AS y, any_value(a.alpha) AS alpha, any_value(a.y) * sum(b.alpha * b.y * {RBF_SQL}) - 1 AS g FROM v a, v b GROUP BY a.id)"
UP, LOW = "((y = 1 AND alpha < 1) OR (y = -1 AND alpha > 0))", "((y = 1 AND alpha > 0) OR (y = -1 AND alpha < 1))"
PAIR = f", w AS (SELECT (SELECT id FROM s WHERE {UP} ORDER BY round(-y * g, 9) DESC, id DESC LIMIT 1) AS i, (SELECT max(-y * g) FROM s WHERE {UP}) AS m, (SELECT id FROM s WHERE {LOW} ORDER BY round(y * g, 9) DESC, id DESC LIMIT 1) AS j, (SELECT max(y * g) FROM s WHERE {LOW}) AS mm)"


def state(spark: SparkSession, d: str) -> DataFrame:
    """The state of the fixed model, computed once for all that a query asks of it."""
    return stored(S.dual_gradient(problem(spark, d), K.RBF), "state")


query("dual_gradient", STATE + f" SELECT id, {sql_round('g')} AS g FROM s")(lambda spark, d: state(spark, d)
    .select("id", rounded(F.col("g")).alias("g")))
query("alpha_status", "SELECT CASE WHEN alpha >= 1 THEN 'upper' WHEN alpha <= 0 THEN 'lower' ELSE 'free' END AS status, "
        "count(*)::bigint AS n FROM v GROUP BY 1")(
    lambda spark, d: problem(spark, d).groupBy(S.alpha_status(C).alias("status")).agg(F.count(F.lit(1)).alias("n"))
)
query("working_pair_first_order", STATE + PAIR + f" SELECT i, {sql_round('m')} AS m, j, {sql_round('mm')} AS mm FROM w")(
    lambda spark, d: S.working_pair(state(spark, d), C).select("i", rounded(F.col("m")).alias("m"), "j", rounded(F.col("mm")).alias("mm"))
)
GAIN = f"pow(m + s.y * s.g, 2) / greatest({K.RBF.sql('a.x', 'a.x')} + {K.RBF.sql('s.x', 's.x')} - 2 * {K.RBF.sql('a.x', 's.x')}, 1e-12)"
query("working_pair_second_order", STATE + PAIR.replace("id DESC",
    "id") + f", t AS (SELECT w.i, w.m, s.id, CASE WHEN {LOW.replace('alpha', 's.alpha').replace('y =', 's.y =')} AND m + "
        f"s.y * s.g > 0 THEN {GAIN} END AS gain FROM w JOIN s a ON a.id = w.i, s) SELECT i, {sql_round('m')} AS m, id "
        f"AS j, {sql_round('gain')} AS gain FROM t WHERE gain IS NOT NULL ORDER BY round(gain, 9) DESC, id LIMIT 1")(
    lambda spark, d: S.second_order_pair(state(spark, d), C, K.RBF)
        .select("i", rounded(F.col("m")).alias("m"), "j", rounded(F.col("gain")).alias("gain"))
)
query("kkt_violators", STATE + " SELECT id, y, round(alpha, 6) AS alpha FROM s WHERE (g < -0.01 AND alpha < 1) OR (g > 0.01 AND alpha > 0)")(lambda spark, d: S.kkt_violators(state(spark, d), C).select("id", "y", F.round("alpha", 6).alias("alpha")))
query("opt_gap", STATE + PAIR + f" SELECT {sql_round('m + mm')} AS gap, m + mm < 0.001 AS optimal FROM w")(lambda spark,
    d: S.optimality_gap(state(spark, d), C).select(rounded(F.col("gap")).alias("gap"), "optimal"))
query("widest_error", STATE + f", f AS (SELECT y * g AS e1 FROM s ORDER BY id LIMIT 1) SELECT id, {sql_round('abs(y * g - e1)')} AS gap FROM "
        f"s, f WHERE alpha > 0 AND alpha < 1 ORDER BY round(abs(y * g - e1), 9) DESC, id LIMIT 1")(
    lambda spark, d: S.widest_error(state(spark, d), C).select("id", rounded(F.col("gap")).alias("gap"))
)
#: A state with rows to shrink: the negative side at C, every fiftieth of the other free.
SETTLED = "v2 AS (SELECT id, x, y, CASE WHEN y = -1 THEN 1::double WHEN id % 50 = 0 THEN 0.5::double ELSE 0::double END AS alpha FROM v), "


def settled(spark: SparkSession, d: str) -> DataFrame:
    alpha = F.when(F.col("y") == -1, 1.0).when(F.col("id") % 50 == 0, 0.5).otherwise(0.0)
    return stored(S.dual_gradient(problem(spark, d).withColumn("alpha", alpha), K.RBF), "state")


query(
    "shrink_candidates",
    "WITH " + SETTLED + STATE[5:].replace("FROM v a, v b",
        "FROM v2 a, v2 b") + PAIR + " SELECT id FROM s, w WHERE (alpha >= 1 AND CASE WHEN y = 1 THEN -g > m ELSE -g > mm END) OR (alpha <= 0 AND "
        "CASE WHEN y = 1 THEN g > mm ELSE g > m END)",
)(lambda spark, d: S.shrink_candidates(settled(spark, d), C).select("id"))
query("gradient_reconstruct", STATE + f" SELECT id, {sql_round('g')} AS g FROM s WHERE alpha <= 0 OR alpha >= 1")(
    lambda spark, d: S.reconstructed(p := problem(spark, d), K.RBF, S.bounded_part(p, K.RBF, C), C).select("id", rounded(F.col("g")).alias("g"))
)

STEP = f"""{STATE}{PAIR}, t AS (
  SELECT a.id AS i, b.id AS j, a.y AS yi, b.y AS yj, a.alpha AS ai, b.alpha AS aj, least((-a.y * a.g + b.y * b.g) / greatest({K.RBF.sql("a.x", "a.x")} + {K.RBF.sql("b.x", "b.x")} - 2 * {RBF_SQL}, 1e-12),
    CASE WHEN a.y = 1 THEN 1 - a.alpha ELSE a.alpha END, CASE WHEN b.y = 1 THEN b.alpha ELSE 1 - b.alpha END) AS t FROM w JOIN s a ON a.id = w.i JOIN s b ON b.id = w.j)"""


def stepped(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """State, and one row with the first-order pair and its new alphas."""
    st = state(spark, d)
    pair = S.working_pair(st, C).select("i", "j")
    side = lambda n: st.select(F.col("id").alias(n), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"), F.col("alpha").alias(f"a{n}"), F.col("g")
        .alias(f"g{n}"))
    row = side("i").join(F.broadcast(pair), "i").join(side("j"), "j")
    k = lambda a, b: K.RBF.expr(F.col(f"x{a}"), F.col(f"x{b}"))
    new_i, new_j = S.pair_step(*[F.col(c) for c in ("yi", "yj", "ai", "aj", "gi", "gj")], k("i", "i"), k("j", "j"), k("i", "j"), C)
    return st, row.withColumn("ni", new_i).withColumn("nj", new_j)


query("pair_step_update", STEP + f" SELECT i, j, {sql_round('ai + yi * t')} AS alpha_i, {sql_round('aj - yj * t')} AS alpha_j FROM t")(
    lambda spark, d: stepped(spark, d)[1].select("i", "j", rounded(F.col("ni")).alias("alpha_i"), rounded(F.col("nj")).alias("alpha_j"))
)


@query("gradient_rank2_update",
    STEP + f" SELECT s.id, {sql_round(f's.g + s.y * yi * {K.RBF.sql("a.x", "s.x")} * yi * t - s.y * yj * {K.RBF.sql("b.x", "s.x")} * yj * t')} "
        f"AS g FROM t JOIN s a ON a.id = t.i JOIN s b ON b.id = t.j, s")
def _(spark, d):
    st, row = stepped(spark, d)
    q = lambda n: F.col("y") * F.col(f"y{n}") * K.RBF.expr(F.col(f"x{n}"), F.col("x"))
    return st.join(F.broadcast(row)).select("id", rounded(S.rank_two_update(F.col("g"), q("i"), q("j"), F.col("ni") - F.col("ai"),
        F.col("nj") - F.col("aj"))).alias("g"))


query("rho", STATE + f" SELECT {sql_round('avg(y * g)')} AS rho, count(*)::bigint AS n_free FROM s WHERE alpha > 0 AND alpha < 1")(lambda spark,
    d: S.rho(state(spark, d), C).select(rounded(F.col("rho")).alias("rho"), "n_free"))
query("dual_objective", STATE + f" SELECT {sql_round('sum(alpha * (g - 1)) / 2')} AS objective FROM s")(lambda spark,
    d: S.dual_objective(state(spark, d)).select(rounded(F.col("objective")).alias("objective")))
query("support_vectors", "SELECT id, y, round(alpha, 6) AS alpha FROM v WHERE abs(alpha) > 0")(lambda spark, d: S.support_vectors(problem(spark, d))
    .select("id", "y", F.round("alpha", 6).alias("alpha")))

# Linear solver steps.

WEIGHTS = "WITH u AS (SELECT i AS idx, sum(alpha * y * x[i]) AS w FROM v, (SELECT unnest(range(1, 65)) AS i) GROUP BY i), ww AS (SELECT list(w ORDER BY idx) AS w FROM u), g AS (SELECT v.*, y * list_dot_product(ww.w, x) + alpha / 2 - 1 AS g FROM v, ww)"
query("linear_w_from_alpha", WEIGHTS + f" SELECT idx::int AS idx, {sql_round('w')} AS w FROM u")(lambda spark, d: S.weights_of(problem(spark, d))
    .select("idx", rounded(F.col("w")).alias("w")))
query("linear_objective", WEIGHTS + f" SELECT {sql_round('((SELECT sum(w * w) FROM u) + (SELECT sum(alpha * (alpha / 2 - 2)) FROM v)) / 2')} AS "
        f"objective")(lambda spark, d: S.linear_objective(problem(spark, d), C).select(rounded(F.col("objective")).alias("objective")))
query("linear_gradient", WEIGHTS + f" SELECT id, {sql_round('g')} AS g FROM g")(lambda spark, d: S.linear_gradient(problem(spark, d), C)
    .select("id", rounded(F.col("g")).alias("g")))
query("projected_gradient_norm",
    WEIGHTS + f" SELECT {sql_round('max(abs(CASE WHEN alpha <= 0 THEN least(g, 0) ELSE g END))')} AS norm FROM g")(lambda spark,
        d: S.projected_norm(S.linear_gradient(problem(spark, d), C)).select(rounded(F.col("norm")).alias("norm")))


@query(
    "bb_step",
    WEIGHTS + """, n AS (SELECT id, x, y, alpha, g, greatest(0, alpha - 0.01::double * g) AS b FROM g), u2 AS (SELECT i AS idx, sum(b * y * x[i]) AS w FROM n, (SELECT unnest(range(1, 65)) AS i) GROUP BY i),
w2 AS (SELECT list(w ORDER BY idx) AS w FROM u2), e AS (SELECT b - alpha AS s, y * list_dot_product(w2.w, x) + b / 2 - 1 - g AS d FROM n, w2)"""
    + f" SELECT {sql_round('sum(s * s) / sum(s * d)')} AS step1, {sql_round('sum(s * d) / sum(d * d)')} AS step2 FROM "
        f"e",
)
def _(spark, d):
    first = S.linear_gradient(problem(spark, d), C)
    moved = first.withColumn("old", F.col("alpha")).withColumn("g0", F.col("g")).withColumn("alpha",
        F.greatest(F.lit(0.0), F.col("alpha") - 0.01 * F.col("g"))).drop("g")
    second = S.linear_gradient(moved, C)
    return S.bb_steps(second.select((F.col("alpha") - F.col("old")).alias("s"), (F.col("g") - F.col("g0")).alias("d"))).select(rounded(F.col("step1"))
        .alias("step1"), rounded(F.col("step2")).alias("step2"))


# Scoring.


def support(spark: SparkSession, d: str) -> DataFrame:
    return S.support_vectors(problem(spark, d)).select("id", "x", "y", "alpha")


for _k in K.ALL:
    _t = "h" if _k.histogram else "v"
    query(f"score_dual_{_k.name}", f"WITH c AS (SELECT a.id, sum(b.alpha * b.y * {_k.sql('a.x', 'b.x')}) AS score FROM {_t} a, {_t} b GROUP BY "
        f"a.id) SELECT id, {sql_round('score')} AS score, CASE WHEN score < 0 THEN -1 ELSE 1 END AS pred FROM c")(
        lambda spark, d, k=_k: gram.scores(p := (histograms if k.histogram else problem)(spark, d), S.support_vectors(p), k)
            .select("id", rounded(F.col("score")).alias("score"), "pred")
    )


@query("score_primal_linear", WEIGHTS + f" SELECT id, {sql_round('list_dot_product(ww.w, x)')} AS score, CASE WHEN list_dot_product(ww.w, x) > 0 THEN 1 "
        f"ELSE -1 END AS pred FROM v, ww")
def _(spark, d):
    from ..operators.estimator import primal_scores

    p = problem(spark, d)
    return primal_scores(p, S.weight_vector(S.weights_of(p))).select("id", rounded(F.col("score")).alias("score"), F.when(F.col("score") > 0, 1)
        .otherwise(-1).alias("pred"))


@query("ovr_argmax", f"WITH c AS (SELECT a.id, b.label, sum(b.alpha * {RBF_SQL}) AS score FROM v a, v b GROUP BY a.id, b.label) "
        f"SELECT id, arg_max(label, (round(score, 9), -label)) AS pred, {sql_round('max(score)')} AS score FROM c GROUP "
        f"BY id")
def _(spark, d):
    p = problem(spark, d)
    names = sorted(r.label for r in p.select("label").distinct().collect())
    results = {f"c{n}": ("dot", lambda b, n=n: b["alpha"] * (b["label"] == n)) for n in names}
    wide = gram.against(p, p, K.RBF, ["alpha", "label"], results)
    best = F.array_max(F.array(*[F.struct(F.round(f"c{n}", 9).alias("r"), F.lit(-n).alias("l"), F.col(f"c{n}").alias("s")) for n in names]))
    return wide.select("id", (-best["l"]).alias("pred"), rounded(best["s"]).alias("score"))


CORRECT = f"WITH c AS (SELECT a.id, any_value(a.y) AS y, CASE WHEN sum(b.alpha * b.y * {RBF_SQL}) < 0 THEN -1 ELSE 1 END AS pred FROM v a, v b GROUP BY a.id)"


def predicted(spark: SparkSession, d: str) -> DataFrame:
    return gram.scores(p := problem(spark, d), support(spark, d), K.RBF).join(p.select("id", "y"), "id")


query("accuracy", CORRECT + " SELECT sum((y = pred)::int)::bigint AS correct, count(*)::bigint AS n, round(avg((y = pred)::int), 6) AS "
        "accuracy FROM c")(lambda spark, d: validation.accuracy(predicted(spark, d)).withColumn("accuracy", F.round("accuracy", 6)))
query("confusion", CORRECT + " SELECT y, pred, count(*)::bigint AS n FROM c GROUP BY ALL")(lambda spark, d: predicted(spark, d).groupBy("y", "pred")
    .agg(F.count(F.lit(1)).alias("n")))

# Validation.

FOLDS = "WITH f AS (SELECT id, y, ((row_number() OVER (PARTITION BY y > 0 ORDER BY (id * 7919) % 10007, id) - 1) % 5)::int AS fold FROM v)"
query("stratified_folds", FOLDS + " SELECT id, fold FROM f")(lambda spark, d: validation.stratified_folds(problem(spark, d), 5).select("id", "fold"))
query("fold_train_sizes", FOLDS + " SELECT t AS fold, sum((fold <> t)::int)::bigint AS train, sum((fold = t)::int)::bigint AS test FROM f, "
        "(SELECT unnest(range(0, 5))::int AS t) GROUP BY t")(
    lambda spark, d: (lambda f: spark.range(5).select(F.col("id").cast("int").alias("t"))
        .join(F.broadcast(f.groupBy("fold").agg(F.count(F.lit(1)).alias("n")))).groupBy(F.col("t").alias("fold"))
            .agg(F.sum(F.when(F.col("fold") != F.col("t"), F.col("n")).otherwise(0)).alias("train"),
                F.sum(F.when(F.col("fold") == F.col("t"), F.col("n")).otherwise(0)).alias("test")))(validation.stratified_folds(problem(spark, d), 5))
)
query("ranking_pairs", f"SELECT a.id AS i, count(*)::bigint AS n, sum(CASE WHEN a.label >= b.label THEN 1 ELSE -1 END)::bigint AS "
        f"balance, {sql_round('sum(a.x[1] - b.x[1])')} AS first FROM v a JOIN v b ON b.id < a.id GROUP BY a.id")(
    lambda spark, d: ranking.pair_sums(problem(spark, d).select("id", F.col("label").alias("rank"), F.col("x")[0].alias("value")))
        .select("i", "n", "balance", rounded(F.col("first")).alias("first"))
)
query("ranking_pair_labels", "SELECT a.label AS rank, sum((a.label >= b.label)::int)::bigint AS n_pos, sum((a.label < "
        "b.label)::int)::bigint AS n_neg FROM v a JOIN v b ON b.id < a.id GROUP BY a.label")(
    lambda spark, d: ranking.pair_labels(problem(spark, d).select("id", F.col("label").alias("rank")))
)

# Encodings, over event counts per user; rows are users, numbered by id.

ROWS = "WITH n AS (SELECT id, count(*) AS nnz FROM r GROUP BY id), e AS (SELECT id, idx, val, row_number() OVER (PARTITION BY id ORDER BY idx) - 1 AS j FROM r)"
SIZE = "(SELECT max(id) + 1 FROM r)"


def _n_rows(long: DataFrame) -> int:
    return (long.agg(F.max("id")).first()[0] or 0) + 1


query("csr_offsets", ROWS + " SELECT id, nnz::bigint AS nnz, coalesce(sum(nnz) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 "
        "PRECEDING), 0)::bigint AS start FROM n")(lambda spark, d: formats.csr_offsets(r := event_long(spark, d), r.select("id").distinct())
            .select("id", "nnz", "start"))
query("csc_offsets", "WITH c AS (SELECT i AS idx, count(r.id) AS nnz FROM (SELECT unnest(range(1, 8)) AS i) LEFT JOIN r ON r.idx = "
        "i GROUP BY i) SELECT idx::int AS idx, nnz::bigint AS nnz, coalesce(sum(nnz) OVER (ORDER BY idx ROWS BETWEEN "
        "UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM c")(
    lambda spark, d: formats.csc_offsets(event_long(spark, d), 7)
)
query("csc_entries", "SELECT (row_number() OVER (ORDER BY idx, id) - 1)::bigint AS pos, idx, id, val FROM r")(lambda spark,
    d: formats.csc_entries(event_long(spark, d), 7).select(F.col("pos").cast("long").alias("pos"), "idx", "id", "val"))
query("ellpack_positions", ROWS + f" SELECT id, idx, (j * {SIZE} + id)::bigint AS pos FROM e")(lambda spark,
    d: formats.ellpack(r := event_long(spark, d), _n_rows(r)).select("id", "idx", "pos"))
query("ellpack_aligned", ROWS + " SELECT id, ceil(nnz / 2.0)::bigint AS units FROM n")(lambda spark,
    d: formats.ellpack_aligned(formats.row_lengths(r := event_long(spark, d), r.select("id").distinct()), 2))
query("ertilp_positions", ROWS + f" SELECT id, idx, ((j // 2) * {SIZE} * 2 + id * 2 + j % 2)::bigint AS pos FROM e")(lambda spark,
    d: formats.ertilp(r := event_long(spark, d), _n_rows(r), 2).select("id", "idx", "pos"))
_SLICES = ", w AS (SELECT id // 32 AS slice, max(ceil(nnz / {step}.0))::bigint * {pre} AS width FROM n GROUP BY 1), p AS (SELECT slice, width, coalesce(sum(width * 64) OVER (ORDER BY slice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::bigint AS start FROM w)"
query("sliced_ell_starts", ROWS + _SLICES.format(step=2, pre=1) + " SELECT slice, width, start FROM p")(lambda spark,
    d: formats.slice_starts(formats.row_lengths(r := event_long(spark, d), r.select("id").distinct()), 32, 2))
query("sliced_ell_positions", ROWS + _SLICES.format(step=2,
    pre=1) + " SELECT id, idx, (start + (j // 2) * 64 + (id % 32) * 2 + j % 2)::bigint AS pos FROM e JOIN p ON slice = id "
        "// 32")(
    lambda spark, d: formats.sliced(r := event_long(spark, d), formats.row_lengths(r, r.select("id").distinct()), 32, 2).select("id", "idx", "pos")
)
query("sertilp_positions", ROWS + _SLICES.format(step=4,
    pre=2) + " SELECT id, idx, (start + (j // 2) * 64 + (id % 32) * 2 + j % 2)::bigint AS pos FROM e JOIN p ON slice = id "
        "// 32")(
    lambda spark, d: formats.sliced(r := event_long(spark, d), formats.row_lengths(r, r.select("id").distinct()), 32, 2, 2).select("id", "idx", "pos")
)
query("row_length_stats", ROWS + " SELECT sum(nnz)::bigint AS total, max(nnz)::bigint AS longest, round(avg(nnz), 6) AS mean FROM n")(
    lambda spark, d: formats.row_lengths(r := event_long(spark, d), r.select("id").distinct())
        .agg(F.sum("nnz").alias("total"), F.max("nnz").alias("longest"), F.round(F.avg("nnz"), 6).alias("mean"))
)
query("lineitem_lp_norm", "SELECT l_returnflag, l_linestatus, round(sum(sqrt(l_quantity * l_quantity + l_discount * l_discount + l_tax * "
        "l_tax)), 2) AS total FROM lineitem GROUP BY ALL", view=False)(
    lambda spark, d: spark.read.parquet(f"{d}/lineitem.parquet").groupBy("l_returnflag", "l_linestatus")
        .agg(F.round(F.sum(V.lp_norm(F.array("l_quantity", "l_discount", "l_tax"), 2)), 2).alias("total"))
)

# Training: invariants that the optimum must meet.

TRUE = "SELECT true AS gap_ok, true AS box_ok, true AS balance_ok, true AS dual_ok"


def certified(spark: SparkSession, d: str, pairs: str) -> DataFrame:
    """Whether the optimum meets its conditions; the gap of objectives is taken by a scoring of its own."""
    p = problem(spark, d)
    found = decomposition.train(p, K.RBF, C, pairs=pairs)
    sums = found.state.join(p.select("id", "y"), "id").agg(F.min("alpha").alias("low"), F.max("alpha").alias("top"), F.sum(F.col("alpha") * F.col("y")).alias("balance"), F.sum("alpha").alias("total")).first()
    sc = gram.scores(p, decomposition.support(p, found), K.RBF, found.rho).join(p.select("id", "y"), "id")
    slack = sc.agg(F.sum(F.greatest(F.lit(0.0), 1 - F.col("y") * F.col("score"))).alias("s")).first().s
    primal = found.objective + sums.total + C * slack
    row = (found.gap < 1e-3, 0 <= sums.low and sums.top <= C, abs(sums.balance) < 1e-6, -1e-6 <= primal + found.objective < 0.01 * abs(primal))
    return spark.createDataFrame([row], "gap_ok boolean, box_ok boolean, balance_ok boolean, dual_ok boolean")


for _name, _pairs in (("train_smo_rbf", "second"), ("train_first_order_rbf", "first"), ("train_random_rbf", "random")):
    query(_name, TRUE, view=False)(lambda spark, d, pairs=_pairs: certified(spark, d, pairs))


@query("train_ovr_rbf", None)
def _(spark, d):
    p = problem(spark, d)
    found = KernelSVC(K.RBF, C).fit(p.select("id", "x", "label")).predict(p)
    return validation.accuracy(found.join(p.select("id", "label"), "id"), "label")


def _cv(spark, d, c, gamma):
    p = validation.stratified_folds(problem(spark, d), 5)
    return validation.cross_validate(p, validation.grid(spark, c, gamma), "rbf", 5)


query("cv_rbf", None)(lambda spark, d: _cv(spark, d, [1.0], [0.5]))
query("grid_rbf", None)(lambda spark, d: validation.best(_cv(spark, d, validation.power_range(*validation.GRID_C),
    validation.power_range(*validation.GRID_GAMMA))))
query("grid_linear", None)(
    lambda spark, d: validation.best(validation.cross_validate_linear(validation.stratified_folds(problem(spark, d), 5), validation.power_range(*validation.GRID_C), 5, DIM))
)

for _name, _fit, _tol in (("train_linear_l2", fit_squared_hinge, 1e-4), ("train_linear_bb", fit_barzilai_borwein, 1e-3)):
    query(_name, "SELECT true AS gradient_ok, true AS gap_ok", view=False)(
        lambda spark, d, f=_fit, tol=_tol: (lambda m: spark.createDataFrame([(bool(m.gradient_norm <= tol),
            bool(-1e-6 <= m.duality_gap <= 1e-2 * max(1.0, abs(m.objective))))], "gradient_ok boolean, gap_ok boolean"))(f(problem(spark, d)
                .select("x", "y"), DIM, C))
    )

# Sparse vectors: event counts per user as (idx, val) pairs, against the users with ids divisible by 50.

SPARSE = "WITH u AS (SELECT DISTINCT id FROM r), z AS (SELECT u.id, list(coalesce(r.val, 0) ORDER BY i) AS x FROM u CROSS JOIN (SELECT unnest(range(1, 6)) AS i) LEFT JOIN r ON r.id = u.id AND r.idx = i GROUP BY u.id)"


def sparse_problem(spark: SparkSession, d: str) -> DataFrame:
    """(id, x, y, alpha): counts per type over ten; y by whether the user has more views than clicks."""
    long = event_long(spark, d).withColumn("val", F.col("val") / 10)
    side = long.groupBy("id").agg((F.coalesce(F.max(F.when(F.col("idx") == 5, F.col("val"))),
        F.lit(0.0)) > F.coalesce(F.max(F.when(F.col("idx") == 1, F.col("val"))), F.lit(0.0))).alias("more"))
    rows = V.sparse(long).join(side, "id")
    return rows.select("id", "x", F.when(F.col("more"), 1).otherwise(-1).alias("y"), (((F.col("id") * 7919) % 11) * F.lit(0.1)).alias("alpha"))


SPARSE_V = SPARSE + ", s AS (SELECT id, list_transform(x, lambda e: e / 10) AS x, CASE WHEN x[5] > x[1] THEN 1 ELSE -1 END AS y, ((id * 7919) % 11) * 0.1::double AS alpha FROM z)"

for _k in K.ALL:
    query(
        f"sparse_score_{_k.name}",
        SPARSE_V + f", c AS (SELECT a.id, sum(b.alpha * b.y * {_k.sql('a.x', 'b.x')}) AS score FROM s a, s b WHERE b.id % 50 = 0 "
        f"GROUP BY a.id) SELECT id, {sql_round('score')} AS score, CASE WHEN score < 0 THEN -1 ELSE 1 END AS pred FROM "
        f"c",
    )(lambda spark, d, k=_k: gram.scores(p := sparse_problem(spark, d), p.where("id % 50 = 0"), k)
        .select("id", rounded(F.col("score")).alias("score"), "pred"))


@query("sparse_linear_gradient",
    SPARSE_V + f", w AS (SELECT i AS idx, sum(alpha * y * x[i]) AS w FROM s, (SELECT unnest(range(1, 6)) AS i) GROUP BY i) "
        f"SELECT idx::int AS idx, {sql_round('w')} AS w FROM w")
def _(spark, d):
    p = sparse_problem(spark, d)
    rows = p.where("alpha <> 0").select((F.col("alpha") * F.col("y")).alias("s"), F.inline("x")).groupBy("idx").agg(F.sum(F.col("s") * F.col("val"))
        .alias("w"))
    return rows.select("idx", rounded(F.col("w")).alias("w"))


query("csr_entries", "SELECT (row_number() OVER (ORDER BY id, idx) - 1)::bigint AS pos, id, idx, val FROM r")(lambda spark,
    d: formats.csr_entries(event_long(spark, d)))
query("kernel_mahalanobis_full", f"WITH m AS (SELECT list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: CASE WHEN i = "
        f"j THEN 1 ELSE 0.5::double / (i + 2 * j) END)) AS m) SELECT "
        f"a.id, {sql_round('list_dot_product(a.x, list_transform(m.m, lambda q: list_dot_product(q, b.x)))')} AS value "
        f"FROM v a JOIN v b ON b.id = a.id + 1, m")(
    lambda spark, d: neighbours(problem(spark, d)).select("id", rounded(K.Mahalanobis(_mixed()).expr(F.col("x"), F.col("z"))).alias("value"))
)


def _mixed() -> tuple[tuple[float, ...], ...]:
    """A full matrix that is not symmetric."""
    return tuple(tuple(1.0 if i == j else 0.5 / (i + 2 * j) for j in range(1, DIM + 1)) for i in range(1, DIM + 1))


query("ranking_concordance", """WITH p AS (SELECT a.x[1] - b.x[1] AS s, a.label > b.label AS more FROM v a JOIN v b ON a.label > b.label), t AS (SELECT sum((s > 0)::int)::bigint AS concordant, sum((s < 0)::int)::bigint AS discordant, sum((s = 0)::int)::bigint AS tied FROM p)
SELECT concordant, discordant, tied, round((concordant + tied / 2.0) / (concordant + discordant + tied), 6) AS pairwise_accuracy, round((concordant - discordant)::double / (concordant + discordant + tied), 6) AS tau FROM t""")(
    lambda spark, d: ranking.concordance(problem(spark, d).select(F.col("x")[0].alias("score"), F.col("label").alias("rank")))
        .select("concordant", "discordant", "tied", F.round("pairwise_accuracy", 6).alias("pairwise_accuracy"), F.round("tau", 6).alias("tau"))
)


@query("train_rank", None)
def _(spark, d):
    few = problem(spark, d).withColumn("rank", F.col("label"))
    return ranking.rank_experiment(few.where("id % 5 <> 0"), few.where("id % 5 = 0"), DIM)[1]


@query("train_linear_multiclass", None)
def _(spark, d):
    p = problem(spark, d).select("id", "x", "label")
    return validation.train_and_test(LinearClassifier(1.0), p, p, dim=DIM)


@query("train_linear_weights", None)
def _(spark, d):
    p = problem(spark, d).select("id", "x", F.col("y").alias("label"))
    return validation.train_and_test(LinearClassifier(1.0, class_weights={1: 2.0}), p, p, dim=DIM)


query("train_linear_sparse", None)(lambda spark, d: (lambda m: spark.createDataFrame([(round(m.objective, 3), bool(m.duality_gap < 1e-2 * max(1.0,
    m.objective)))], "objective double, gap_ok boolean"))(fit_squared_hinge(sparse_problem(spark, d), 5, C)))
query("train_linear_hinge", None)(lambda spark, d: (lambda m: spark.createDataFrame([(round(m.objective, 2),)],
    "objective double"))(linear.fit_hinge(problem(spark, d), DIM, C)))


@query("train_decomposed_rbf", None)
def _(spark, d):
    found = decomposition.train(problem(spark, d), K.RBF, C)
    return spark.createDataFrame([(round(found.objective, 2), found.gap < 1e-3)], "objective double, gap_ok boolean")


@query("train_platt_rbf", None)
def _(spark, d):
    found = decomposition.train(problem(spark, d), K.RBF, C, pairs="platt")
    return spark.createDataFrame([(found.state.where("alpha > 0").count(), round(found.objective, 1))], "n_sv long, objective double")


query("search_c_list", None)(lambda spark, d: validation.search_c(problem(spark, d), "rbf"))
query("train_test", None)(lambda spark, d: (lambda p: validation.train_and_test(KernelSVC(K.RBF, C), p.where("id % 5 <> 0"),
    p.where("id % 5 = 0")))(problem(spark, d).select("id", "x", F.col("y").alias("label"))))


@query("solver_sweep", None)
def _(spark, d):
    p = problem(spark, d).select("id", "x", F.col("y").alias("label"))
    found = validation.sweep({"embeddings": (p.where("id % 5 <> 0"), p.where("id % 5 = 0"))}, {"linear": K.LINEAR, "rbf": K.RBF}, ["second", "first"],
        C)
    return found.drop("train_s", "predict_s")


query("train_linear_cg", "SELECT true AS gradient_ok, true AS gap_ok", view=False)(
    lambda spark, d: (lambda m: spark.createDataFrame([(bool(m.gradient_norm <= 1e-4),
        bool(-1e-6 <= m.duality_gap <= 1e-2 * max(1.0, abs(m.objective))))],
            "gradient_ok boolean, gap_ok boolean"))(fit_conjugate_gradient(problem(spark, d).select("x", "y"), DIM, C))
)
