"""The quality classifier against a plain ridge regression in one place, and its features against the kernel they stand for."""

import zlib

import numpy as np
from hyperplane.llm import rff_quality as Q
from pyspark.sql import functions as F

DIR = "/root/testdata/sf0.001"


def plain_isotonic(weight, hits):
    """Least squares over non-decreasing values: the greatest least mean of runs, by all pairs of ends."""
    at = np.flatnonzero(weight)
    w, h = np.concatenate(([0], np.cumsum(weight[at]))), np.concatenate(([0], np.cumsum(hits[at])))
    return at, np.array([max(min((h[j] - h[i]) / (w[j] - w[i]) for j in range(k + 1, len(at) + 1)) for i in range(k + 1)) for k in range(len(at))])


def test_ridge_and_calibration(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    labels = spark.read.parquet(f"{DIR}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    known = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    measured = Q.measure(docs).cache()
    model = Q.fit(measured.repartition(7), known)

    fold = {r.doc_id: r.fold for r in known.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(Q.FOLDS)).alias("fold")).collect()}
    label = {r.doc_id: r.label for r in known.collect()}
    assert label and all(zlib.crc32(str(i).encode()) % 5 for i in label)
    stats = {r.doc_id: np.frombuffer(r.stats, np.float32).astype(float) for r in measured.collect()}
    ids = sorted(i for i in label if i in stats)
    x, y, at = np.array([stats[i] for i in ids]), np.array([float(label[i]) for i in ids]), np.array([fold[i] for i in ids])
    shift, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    assert np.allclose(model["shift"], shift) and np.allclose(model["scale"], scale, atol=1e-5)
    z = Q.fourier(x, model["shift"], model["scale"])
    m = z.shape[1]
    penalty = Q.RIDGE * len(y) / m + 1

    def ridge(use):
        """Least squares on rows with the penalty as rows of their own."""
        rows = np.concatenate([z[use], np.sqrt(penalty) * np.eye(m)])
        return np.linalg.lstsq(rows, np.concatenate([y[use], np.zeros(m)]), rcond=None)[0]

    assert np.allclose(model["weights"], ridge(np.ones(len(y), bool)), atol=1e-6)
    raw = np.zeros(len(y))
    for k in range(Q.FOLDS):
        raw[at == k] = z[at == k] @ ridge(at != k)
    bins = Q.bins(raw)
    weight, hits = np.bincount(bins, minlength=Q.BINS), np.bincount(bins, y, minlength=Q.BINS)
    places, value = plain_isotonic(weight, hits)
    curve = model["curve"]
    # Between centres of blocks the curve is drawn straight; over each block its mean is the plain solution's.
    assert (np.diff(curve) >= -1e-12).all()
    edges = np.flatnonzero(np.diff(value) > 1e-12) + 1
    for run in np.split(np.arange(len(places)), edges):
        centre = np.average(places[run], weights=weight[places[run]])
        assert abs(np.interp(centre, np.arange(Q.BINS), curve) - value[run[0]]) < 0.02

    # Scores come from these weights and this curve.
    got = {r.doc_id: r.score for r in Q.score(measured, model).collect()}
    everyone = sorted(stats)
    zs = Q.fourier(np.array([stats[i] for i in everyone]), model["shift"], model["scale"]) @ model["weights"]
    want = np.clip(0.98 * curve[Q.bins(zs)] + 0.02 * np.clip(zs, 0, 1), 0, 1)
    assert np.allclose([got[i] for i in everyone], want)


def test_features_stand_for_a_gaussian_kernel(monkeypatch):
    monkeypatch.setattr(Q, "FEATURES", 20_000)
    x = np.random.default_rng(0).normal(size=(12, Q.N_STATS)) * 0.7
    z = Q.fourier(x, np.zeros(Q.N_STATS), np.ones(Q.N_STATS))[:, :20_000]
    square = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.allclose(z @ z.T, np.exp(-Q.GAMMA * square), atol=0.03)
