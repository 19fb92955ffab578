"""Sparse vectors, linear classifiers, further solvers, searches and ranks, against dense or plain forms."""

import numpy as np
import pyarrow as pa
import pytest
from hyperplane.functions import kernels as K
from hyperplane.functions import sparse
from hyperplane.functions.sparse import SparseRows, matrix, stacked
from hyperplane.operators import decomposition, formats, gram, linear, ranking, ranks, smo, validation
from hyperplane.operators.estimator import KernelSVC, train_problems, weighted
from hyperplane.sources import libsvm
from hyperplane.sources.catalog import Catalog
from pyspark.sql import functions as F


def table(n=60, dim=40, seed=0, share=0.2):
    rng = np.random.default_rng(seed)
    return np.where(rng.random((n, dim)) < share, rng.random((n, dim)).round(3), 0)


def as_structs(x):
    return pa.array([[{"idx": int(j) + 1, "val": float(v[j])} for j in np.flatnonzero(v)] for v in x], pa.list_(pa.struct([("idx", pa.int32()), ("val", pa.float64())])))


def test_sparse_rows():
    x = table()
    s = matrix(as_structs(x))
    assert isinstance(s, SparseRows) and len(s) == 60 and (s.dense(40) == x).all() and np.allclose(s.sums(), x.sum(1)) and np.allclose(s.squares(), (x * x).sum(1))
    assert (s[10:20].dense(40) == x[10:20]).all() and (s[np.arange(60) % 7 == 0].dense(40) == x[::7]).all() and (s[np.array([3, 3, 1])].dense(40) == x[[3, 3, 1]]).all()
    w = np.random.default_rng(1).normal(size=(30, 2))
    assert np.allclose(s.times(w), x[:, :30] @ w) and np.allclose(s.times(w[:, 0]), x[:, :30] @ w[:, 0])
    assert np.allclose(s.weighted(x[:, :2], 40), x.T @ x[:, :2]) and np.allclose(s.weighted(x[:, 0], 40), x.T @ x[:, 0])
    maps = pa.array([[(3, 1.0), (9, None)], None, []], pa.map_(pa.int32(), pa.float64()))
    m = matrix(maps)
    assert m.ptr.tolist() == [0, 2, 2, 2] and m.val.tolist() == [1.0, 0.0]
    assert (matrix(as_structs(x).slice(5, 9)).dense(40) == x[5:14]).all()
    assert (stacked([s[:7], s[7:]]).dense(40) == x).all() and len(matrix(as_structs(x[:0]))) == 0


@pytest.mark.parametrize("kernel", K.ALL, ids=lambda k: k.name)
@pytest.mark.parametrize("columns", [4096, 0])
def test_sparse_kernels(kernel, columns, monkeypatch):
    """Sparse blocks give what dense ones give, through dense blocks of columns or through pairs of entries, a few at a time."""
    monkeypatch.setattr(sparse, "DENSE_COLUMNS", columns)
    monkeypatch.setattr(sparse, "PAIRS", 50)
    x, z = table(), table(35, 40, 3)
    x[4], z[2] = 0, 0
    assert np.allclose(kernel.block(matrix(as_structs(x)), matrix(as_structs(z))), kernel.block(x, z))


def test_own_kernels(spark):
    x, z = table(9, 4, 1, 0.9), table(5, 4, 2, 0.9)
    m = np.arange(16.0).reshape(4, 4)
    full = K.Mahalanobis(tuple(map(tuple, m.tolist())))
    assert np.allclose(full.block(x, z), x @ m @ z.T) and np.allclose(full.block(matrix(as_structs(x)), matrix(as_structs(z))), x @ m @ z.T)
    own = K.Custom(lambda a, b: np.minimum(a[:, None, :], b[None, :, :]).sum(2))
    df = spark.createDataFrame([(i, v.tolist(), 1 if i % 2 else -1, 0.5) for i, v in enumerate(x)], "id long, x array<double>, y int, alpha double")
    got = [r.score for r in gram.scores(df, df, own).orderBy("id").collect()]
    assert np.allclose(got, own.block(x, x) @ (0.5 * np.where(np.arange(9) % 2, 1, -1)))
    with pytest.raises(ValueError):
        K.kernel_of("unknown")


@pytest.fixture(scope="module")
def sparse_problem(spark):
    x = table(150, 12, 5, 0.4)
    y = np.where(x[:, 0] + x[:, 1] - x[:, 2] + 0.1 * x[:, 3] > 0.2, 1, -1)
    rows = [(i, [(int(j) + 1, float(v[j])) for j in np.flatnonzero(v)], v.tolist(), int(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x array<struct<idx: int, val: double>>, dense array<double>, y int").cache()
    return df, x, y


def test_sparse_training(sparse_problem, monkeypatch):
    """A model of sparse rows is that of dense ones, also where the support rows are too many to be sent whole."""
    df, x, y = sparse_problem
    rows = df.withColumn("problem", F.lit(0).cast("long"))
    s = smo.solve(x, y, K.RBF, 2.0)
    model = train_problems(rows, K.RBF, 2.0).cache()
    assert {r.sv_id: round(r.alpha, 9) for r in model.collect()} == {i: round(a, 9) for i, a in enumerate(s.alpha) if a > 0}
    support = model.select(F.col("sv_id").alias("id"), "x", "y", "alpha")
    want = smo.decide(x, x, s.alpha * y, K.RBF, s.rho)
    assert np.allclose([r.score for r in gram.scores(df, support, K.RBF, s.rho).orderBy("id").collect()], want)
    monkeypatch.setattr(gram, "BROADCAST_BYTES", 10)
    monkeypatch.setattr(gram, "BLOCK_ROWS", 40)
    assert np.allclose([r.score for r in gram.scores(df, support, K.RBF, s.rho).orderBy("id").collect()], want)


@pytest.mark.parametrize("cells", [1 << 20, 0])
def test_linear_sparse_is_linear_dense(sparse_problem, monkeypatch, cells):
    monkeypatch.setattr(linear, "CURVATURE_CELLS", cells)
    df, x, y = sparse_problem
    dense = linear.fit_squared_hinge(df.select(F.col("dense").alias("x"), "y"), 12, 0.7)
    for fit in (linear.fit_squared_hinge, linear.fit_conjugate_gradient):
        assert np.allclose(fit(df, 12, 0.7).w, dense.w, atol=1e-4)
    for rule in ("bb1", "bb2", "both"):
        found = linear.fit_barzilai_borwein(df, 12, 0.7, rule=rule)
        assert found.objective == pytest.approx(dense.objective, rel=1e-3) and -1e-6 <= found.duality_gap < 1e-2 * found.objective


def test_linear_hinge(sparse_problem):
    """The hinge loss: no better than what its dual allows, by SMO-like projected ascent on the dual without a bias."""
    df, x, y = sparse_problem
    found = linear.fit_hinge(df, 12, 0.7)
    a, q = np.zeros(len(y)), (x * y[:, None]) @ (x * y[:, None]).T
    for _ in range(400):
        for i in range(len(y)):
            a[i] = np.clip(a[i] - (q[i] @ a - 1) / max(q[i, i], 1e-12), 0, 0.7)
    dual = a.sum() - a @ q @ a / 2
    assert dual - 1e-6 <= found.objective <= dual * 1.02


def test_class_weights(sparse_problem, spark):
    df, x, y = sparse_problem
    rows = df.withColumn("label", F.when(F.col("y") > 0, 8).otherwise(2))
    assert {(r.label, r.weight) for r in weighted(rows, {8: 3.0}).select("label", "weight").distinct().collect()} == {(8, 3.0), (2, 1.0)}
    with pytest.raises(ValueError):
        weighted(rows, {5: 1.0})
    whole = smo.solve(x, y, K.RBF, 1.0, weights=np.where(y > 0, 3.0, 1.0))
    svc = KernelSVC(K.RBF, 1.0, class_weights={8: 3.0}).fit(rows)
    assert svc.model.agg(F.max("alpha")).first()[0] == pytest.approx(whole.alpha.max()) and whole.alpha.max() > 1
    model = linear.LinearClassifier(0.5, class_weights={2: 4.0}).fit(rows, 12)
    slack = lambda w: np.maximum(0, 1 - np.where(y == np.where(model.classes[0] == 8, 1, -1), 1, -1) * (x @ w))
    value = lambda w: w @ w / 2 + (0.5 * np.where(y > 0, 1, 4) * slack(w) ** 2).sum()
    w = model.w[:, 0]
    assert all(value(w) <= value(w + d) + 1e-6 for d in np.random.default_rng(0).normal(0, 0.01, (50, 12)))


@pytest.mark.parametrize("solver", ["newton", "cg", "bb"])
def test_linear_multiclass(sparse_problem, spark, solver):
    df, x, _ = sparse_problem
    label = np.argmax(x[:, :3], 1)
    rows = df.join(spark.createDataFrame([(i, int(v)) for i, v in enumerate(label)], "id long, label int"), "id")
    model = linear.LinearClassifier(1.0, solver).fit(rows, 12)
    assert model.classes == list(dict.fromkeys(label.tolist())) and model.w.shape == (12, 3)
    got = {r.id: r.pred for r in model.predict(rows).collect()}
    value = x @ model.w
    assert [got[i] for i in range(150)] == [model.classes[k] for k in value.argmax(1)]
    assert validation.train_and_test(linear.LinearClassifier(10.0, solver), rows, rows, dim=12).first().accuracy > 0.85
    # Features beyond those of the training are dropped; a value of zero is the second class.
    two = linear.LinearClassifier(1.0, solver, classes=[5, 6], w=np.ones((1, 1)))
    odd = spark.createDataFrame([(0, [(1, 2.0), (99, -50.0)]), (1, []), (2, [(1, -1.0)])], "id long, x array<struct<idx: int, val: double>>")
    assert {r.id: r.pred for r in two.predict(odd).collect()} == {0: 5, 1: 6, 2: 6}


@pytest.mark.parametrize("kernel", [K.LINEAR, K.RBF])
@pytest.mark.parametrize("partners", [1, 3])
def test_platt(kernel, partners):
    x = np.random.default_rng(4).normal(size=(90, 3))
    y = np.where(x[:, 0] + 0.4 * x[:, 1] ** 2 > 0.3, 1, -1)
    s = smo.solve_platt(x, y, kernel, 2.0, seed=1, partners=partners)
    best = smo.solve(x, y, kernel, 2.0, eps=1e-5)
    assert (s.alpha >= 0).all() and (s.alpha <= 2).all() and abs(s.alpha @ y) < 1e-6 and s.gap < 0.05
    assert best.objective - 1e-6 <= s.objective <= best.objective + 0.02 * abs(best.objective)
    assert (smo.solve_platt(x[:5], np.ones(5), kernel, 1.0).alpha == 0).all() and smo.solve(x[:0], y[:0], kernel, 1.0, "platt").iterations == 0


def test_decomposition(sparse_problem):
    """Small working sets, one pass a round, end at the optimum of the whole problem."""
    df, x, y = sparse_problem
    best = smo.solve(x, y, K.RBF, 2.0, eps=1e-4)
    found = decomposition.train(df, K.RBF, 2.0, working=40)
    assert found.gap < smo.EPS and found.objective == pytest.approx(best.objective, abs=1e-2) and found.rho == pytest.approx(best.rho, abs=0.02) and found.rounds > 1
    got = {r.id: r.score for r in gram.scores(df, decomposition.support(df, found), K.RBF, found.rho).collect()}
    assert np.allclose([got[i] for i in range(150)], smo.decide(x, x, best.alpha * y, K.RBF, best.rho), atol=0.02)
    one = decomposition.train(df.where("y = 1"), K.RBF, 1.0)
    assert one.objective == 0 and one.rounds == 0


def test_concordance(spark):
    rng = np.random.default_rng(2)
    rows = [(float(rng.integers(0, 12)), int(rng.integers(0, 4))) for _ in range(200)] + [(1.0, None)]
    got = ranking.concordance(spark.createDataFrame(rows, "score double, rank int").repartition(5)).first()
    pairs = [(a, b) for i, a in enumerate(rows[:-1]) for b in rows[:i] if a[1] != b[1]]
    sign = [np.sign((a[0] - b[0]) * (a[1] - b[1])) for a, b in pairs]
    assert (got.concordant, got.discordant, got.tied) == (sign.count(1), sign.count(-1), sign.count(0))
    assert got.tau == pytest.approx(np.mean(sign)) and got.pairwise_accuracy == pytest.approx((np.mean(sign) + 1) / 2)
    none = ranking.concordance(spark.createDataFrame([(1.0, 1), (2.0, 1)], "score double, rank int")).first()
    assert none.concordant == 0 and none.tau is None


def test_rank_experiment(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 3))
    rows = [(i, v.tolist(), int(np.digitize(v[0] - v[1], [-0.5, 0.5]))) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "id long, x array<double>, rank int")
    _, got = ranking.rank_experiment(df.where("id % 3 <> 0"), df.where("id % 3 = 0"), 3)
    assert got.first().pairwise_accuracy > 0.9


def test_ranks_of_hot_groups(spark):
    """One group over many ranges, ties in the order, and running sums."""
    df = spark.createDataFrame([("a" if i % 10 else "b", i * 7 % 101, i) for i in range(500)], "g string, v int, id long").repartition(6)
    got = {(r.g, r.v, r.id): r.place for r in ranks.ranked(df, ["g"], ["v", "id"], "place").collect()}
    for g in "ab":
        mine = sorted((v, i) for h, v, i in got if h == g)
        assert [got[g, v, i] for v, i in mine] == list(range(len(mine)))
    sums = {r.id: r.before for r in ranks.running(df, "id", {"v": "before"}).collect()}
    assert all(sums[i] == sum(k * 7 % 101 for k in range(i)) for i in range(0, 500, 37))
    assert ranks.ranked(df.limit(0), ["g"], ["id"], "place").count() == 0
    with pytest.raises(ValueError):
        ranks.ranked(df.withColumn("_part", F.lit(1)), ["g"], ["id"], "place")


def test_folds_of_one_side(spark):
    df = spark.createDataFrame([(i, 1 if i % 9 else -1) for i in range(300)], "id long, y int").repartition(7)
    sizes = {}
    for r in validation.stratified_folds(df, 7).collect():
        sizes[r.y, r.fold] = sizes.get((r.y, r.fold), 0) + 1
    assert all(max(v) - min(v) <= 1 for v in ([n for (y, _), n in sizes.items() if y == s] for s in (1, -1)))


def test_searches(spark, sparse_problem):
    df, x, y = sparse_problem
    found = validation.search_c(df, "rbf", 3, [0.5, 8.0])
    assert sorted(r.c for r in found.collect()) == [0.5, 8.0] and all(r.n == 150 for r in found.collect())
    own = validation.cross_validate(validation.stratified_folds(df, 3), validation.grid(spark, [1.0], [0.5]), lambda gamma: K.Kernel("expchi2", gamma), 3).first()
    named = validation.cross_validate(validation.stratified_folds(df, 3), validation.grid(spark, [1.0], [0.5]), "expchi2", 3).first()
    assert own.correct == named.correct and len(validation.C_LIST) == 11
    rows = df.withColumn("label", F.col("y"))
    swept = validation.sweep({"d": (rows, rows)}, {"rbf": K.RBF}, ["second", "platt"], 2.0, repeats=2).collect()
    assert [r.solver for r in swept] == ["second", "platt"] and all(r.accuracy > 0.8 and r.train_s > 0 and r.n_sv > 0 for r in swept)


def test_searches_start_from_the_solution_before(spark, sparse_problem):
    """Every C of a gamma gets the accuracy of a fit of its own."""
    df, x, y = sparse_problem
    folds = validation.stratified_folds(df, 3)
    fold = {r.id: r.fold for r in folds.collect()}
    held = [np.array([fold[i] == k for i in range(150)]) for k in range(3)]
    for r in validation.cross_validate(folds, validation.grid(spark, [0.5, 8.0, 512.0], [0.3]), "rbf", 3).collect():
        kern = K.Kernel("rbf", 0.3)
        right = 0
        for h in held:
            s = smo.solve(x[~h], y[~h], kern, r.c)
            right += int((np.where(smo.decide(x[h], x[~h], s.alpha * y[~h], kern, s.rho) < 0, -1, 1) == y[h]).sum())
        assert abs(r.correct - right) <= 1


def test_csr_and_csc_entries(spark):
    rows = [(i, j, float(10 * i + j)) for i in range(7) for j in range(1, 9) if (i * j) % 3 != 1 and (i or j < 3)]
    long = spark.createDataFrame(rows, "id long, idx int, val double").repartition(4)
    assert [tuple(r)[1:] for r in formats.csr_entries(long).orderBy("pos").collect()] == sorted(rows)
    assert [(r.id, r.idx, r.val) for r in formats.csc_entries(long, 8).orderBy("pos").collect()] == sorted(rows, key=lambda r: (r[1], r[0]))


def test_libsvm_feeds_the_solvers(spark, tmp_path):
    """Ids follow files and lines however these are split, and the maps that are read train as they are."""
    x = table(80, 9, 8, 0.5)
    y = np.where(x[:, 0] > x[:, 1], 1, -1)
    lines = [f"{int(t)} " + " ".join(f"{j + 1}:{v[j]}" for j in np.flatnonzero(v)) + " " for v, t in zip(x, y)]
    (tmp_path / "d").mkdir()
    (tmp_path / "d/a.txt").write_text("\n".join(lines[:50]) + "\n")
    (tmp_path / "d/b.txt").write_text("\r\n".join(lines[50:]))
    whole, dim = libsvm.read_libsvm(spark, f"{tmp_path}/d")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    split = libsvm.read_libsvm(spark, f"{tmp_path}/d")[0].orderBy("id").collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [tuple(r) for r in split] == [tuple(r) for r in whole.orderBy("id").collect()] and [r.id for r in split] == list(range(80))
    rows = whole.select("id", F.col("features").alias("x"), F.col("label").cast("int").alias("y"), F.lit(0).cast("long").alias("problem"))
    want = smo.solve(x, y, K.RBF, 1.0)
    assert {r.sv_id: round(r.alpha, 9) for r in train_problems(rows, K.RBF, 1.0).collect()} == {i: round(a, 9) for i, a in enumerate(want.alpha) if a > 0}
    assert np.allclose(linear.fit_squared_hinge(rows, dim).w, linear.fit_squared_hinge(spark.createDataFrame([(v.tolist(), int(t)) for v, t in zip(x, y)], "x array<double>, y int"), dim).w, atol=1e-4)


def test_benchmark_catalog():
    c = Catalog.benchmarks("/data")
    assert len(list(c)) == 11 and c["a9a"].dim == 123 and c["a9a"].test == "/data/a9a.t"
