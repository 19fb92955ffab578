"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Every document gets a short vector of statistics of its text.  Random Fourier
features approximate a Gaussian kernel over them; ridge scores come from normal
equations summed within partitions and then over groups of partitions, so that
only matrices of a fixed size reach the driver.  Scores of labelled rows are
binned by partition and calibrated by pool-adjacent-violators.

Cases: a null or empty text has statistics of zero and is scored like any other;
without labelled rows, or with one class only, every score is the share of label
1 (0.5 without labels).  A document labelled twice counts twice; a null label is
no label.  Rows with a null id are scored and never learned from.  Extra columns
are not read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, written
from .textbatch import SAME, Words, flat, lean, pieces, spans

FEATURES = 256
GAMMA = 0.15
RIDGE = 1e-3
SEED = 20240607
THRESHOLD = 0.3
BINS = 2048
FOLDS = 3

#: Bytes counted as classes of their own: letters by case, digits, space, line feed, other control, symbols, pipes, marks.
_CLASSES = np.zeros(256, np.uint8)
_CLASSES[0x41:0x5B] = 1
_CLASSES[0x61:0x7B] = 2
_CLASSES[0x30:0x3A] = 3
_CLASSES[0x20] = 4
_CLASSES[[0x0A, 0x0D]] = 5
_CLASSES[list(b"#*$%&@^~=+_\\")] = 6
_CLASSES[list(b"|<>{}[]")] = 7
_CLASSES[list(b"!?")] = 8
_CLASSES[list(b".,;:'\"()-/")] = 9
_CLASSES[0xC0:] = 10
N_CLASSES = 11
#: Statistics per document.
N_STATS = N_CLASSES - 1 + 12


def statistics(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Documents by N_STATS statistics, each of the order of one."""
    n = len(offs) - 1
    size = np.diff(offs)
    some = np.maximum(size, 1)
    cls = _CLASSES[buf]
    of = np.repeat(np.arange(n, dtype=np.int64), size)
    shares = np.bincount(of * 16 + cls, minlength=n * 16).reshape(n, 16)[:, 1:N_CLASSES] / some[:, None]
    w = Words(buf, offs)
    words = np.maximum(w.counts, 1)
    word_of = w.of()
    length = (w.end - w.start).astype(np.float64)
    mean = np.bincount(word_of, length, minlength=n) / words
    spread = np.sqrt(np.maximum(np.bincount(word_of, length * length, minlength=n) / words - mean * mean, 0))
    first, last = cls[w.start], cls[w.end - 1]
    share = lambda flag: np.bincount(word_of[flag], minlength=n) / words
    # Words without any letter, and words whose last two bytes are marks or symbols.
    letters = np.concatenate(([0], np.cumsum((cls == 1) | (cls == 2) | (cls == 10))))
    bare = letters[w.end] == letters[w.start]
    shout = (cls[w.start] == 1) & (cls[np.minimum(w.start + 1, w.end - 1)] == 1) & (length > 1)
    tail2 = cls[np.maximum(w.end - 2, w.start)]
    symbol_tail = ((last == 6) | (last == 8)) & ((tail2 == 6) | (tail2 == 8))
    h = w.hashes(SAME)
    key = (h >> np.uint64(24)) | (word_of.astype(np.uint64) << np.uint64(40))
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    distinct = np.bincount((key[new] >> np.uint64(40)).astype(np.int64), minlength=n)
    # Distinct words are compared with what a text of that length usually has, so their share is damped by length.
    fresh = np.log1p(distinct) / np.log(np.maximum(words, 2))
    feeds = np.bincount(of[buf == 10], minlength=n) + 1
    start = np.unique(np.concatenate((offs[:-1][size > 0], np.flatnonzero(buf[:-1] == 10) + 1 if len(buf) else [])).astype(np.int64))
    stop = np.concatenate((start[1:], [len(buf)])).astype(np.int64)
    line_of = np.searchsorted(offs, start, "right") - 1
    line_key = (spans(buf, start, stop) >> np.uint64(24)) | (line_of.astype(np.uint64) << np.uint64(40))
    line_key.sort()
    again = np.zeros(len(line_key), bool)
    again[1:] = line_key[1:] == line_key[:-1]
    repeated = np.bincount((line_key[again] >> np.uint64(40)).astype(np.int64), minlength=n) / feeds
    return np.column_stack((
        shares * 4, np.log1p(size) / 8, np.log1p(w.counts) / 6, mean / 8, spread / 6, share(first == 1) * 2, share(shout) * 2, share(bare) * 2, share(symbol_tail) * 2,
        fresh * 2, repeated * 2, np.log1p(w.counts / feeds) / 3, share((last == 9) | (last == 8)) * 2,
    ))


def fourier(stats: np.ndarray, shift: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """FEATURES random Fourier features of standardised statistics, the statistics themselves, and a constant."""
    rng = np.random.default_rng(SEED)
    z = np.clip((stats - shift) / scale, -6, 6)
    wave = rng.normal(0, np.sqrt(2 * GAMMA), (stats.shape[1], FEATURES))
    phase = rng.uniform(0, 2 * np.pi, FEATURES)
    return np.column_stack((np.cos(z @ wave + phase) * np.sqrt(2 / FEATURES), z / 8, np.ones(len(z))))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = flat(batch.column(1))
        for a, b, part, part_offs in pieces(buf, offs):
            stats = statistics(part, part_offs).astype(np.float32)
            flat_bytes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * N_STATS), b - a, [None, pa.py_buffer(np.ascontiguousarray(stats))]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), flat_bytes], ["doc_id", "stats"])


def _unpack(column: pa.Array) -> np.ndarray:
    buf, _ = flat(column)
    return buf.view(np.float32).reshape(len(column), N_STATS).astype(np.float64) if len(buf) else np.zeros((0, N_STATS))


def _sums(df: DataFrame, part, size: int) -> np.ndarray:
    """Sum over partitions of part(stats, label, fold), a vector of ``size``: within partitions, then over up to 64 groups of them, then here."""

    def within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                total += part(_unpack(piece.column(0)), *(piece.column(k).to_numpy(zero_copy_only=False) for k in (1, 2)))
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["total"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = np.zeros(size), False
        for batch in batches:
            for x in batch.column(0):
                total, some = total + np.frombuffer(x.as_py()), True
        if some:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], ["total"])

    partial = df.select("stats", "label", "fold").mapInArrow(lean(within), "total binary")
    groups = min(64, max(1, int(df.rdd.getNumPartitions() ** 0.5)))
    rows = partial.repartition(groups).mapInArrow(lean(over), "total binary").collect()
    return np.sum([np.frombuffer(r.total) for r in rows], 0) if rows else np.zeros(size)


def isotonic(weight: np.ndarray, hits: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: non-decreasing share of hits by bin, linear between the centres of the pooled blocks."""
    blocks: list[list[float]] = []  # hits, weight, weighted sum of bins
    for i in np.flatnonzero(weight):
        blocks.append([hits[i], weight[i], weight[i] * i])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            top = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], top, strict=True)]
    return np.interp(np.arange(len(weight)), [at / w for _, w, at in blocks], [h / w for h, w, _ in blocks])


def fit(measured: DataFrame, labels: DataFrame) -> dict:
    """Model from measured documents (doc_id, stats) and labels (doc_id, label 0/1).

    The normal equations are summed by FOLDS folds; each fold is scored by the
    weights of the others for the calibration, and the model's weights come
    from all of them.
    """
    known = labels.where("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("double").alias("label"))
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("double")
    train = written(measured.join(known, "doc_id").select("stats", "label", fold.alias("fold")), "quality-train")
    d = N_STATS
    moments = _sums(train, lambda x, y, _: np.concatenate(([len(y), y.sum()], x.sum(0), (x * x).sum(0))), 2 + 2 * d)
    n, ones = moments[:2]
    if n == 0 or ones in (0, n):
        dropped(train)
        return {"constant": float(ones / n) if n else 0.5}
    shift = moments[2 : 2 + d] / n
    scale = np.maximum(np.sqrt(np.maximum(moments[2 + d :] / n - shift**2, 0)), 1e-6)
    m = FEATURES + d + 1

    def normal(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
        z = fourier(x, shift, scale)
        return np.concatenate([np.concatenate(((u := z[at == k]).T @ u, (u.T @ y[at == k])[None])).ravel() for k in range(FOLDS)])

    by_fold = _sums(train, normal, FOLDS * (m + 1) * m).reshape(FOLDS, m + 1, m)
    ridge = (RIDGE * n / m + 1) * np.eye(m)
    solve = lambda sums: np.linalg.solve(sums[:m] + ridge, sums[m])
    total = by_fold.sum(0)
    others = np.array([solve(total - x) for x in by_fold])

    def binned(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
        raw = (fourier(x, shift, scale) * others[at.astype(np.int64)]).sum(1)
        return np.concatenate((np.bincount(bins(raw), minlength=BINS), np.bincount(bins(raw), y, minlength=BINS)))

    table = _sums(train, binned, 2 * BINS)
    dropped(train)
    return {"shift": shift, "scale": scale, "weights": solve(total), "curve": isotonic(table[:BINS], table[BINS:])}


def bins(raw: np.ndarray) -> np.ndarray:
    """Bin of a ridge score; scores beyond -0.5 to 1.5 share the outer bins."""
    return np.clip(((raw + 0.5) / 2 * BINS).astype(np.int64), 0, BINS - 1)


def predict(model: dict, stats: np.ndarray) -> np.ndarray:
    """Calibrated scores from 0 to 1; within a step of the calibration the ridge score still orders rows a little."""
    if "constant" in model:
        return np.full(len(stats), model["constant"])
    raw = fourier(stats, model["shift"], model["scale"]) @ model["weights"]
    return np.clip(0.98 * model["curve"][bins(raw)] + 0.02 * np.clip(raw, 0, 1), 0, 1)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats) of each row."""
    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(lean(_measured), "doc_id long, stats binary")


def score(measured: DataFrame, model: dict) -> DataFrame:
    """(doc_id, score) of each measured row."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                piece = batch.slice(at, 4096)
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(predict(model, _unpack(piece.column(1))))], ["doc_id", "score"])

    return measured.select("doc_id", "stats").mapInArrow(lean(scored), "doc_id long, score double")


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: int = 5, held: int = 0) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; learns from labels whose crc32(doc_id) mod ``fold`` is not ``held``."""
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold
    measured = written(measure(docs, id_col, text_col), "quality-stats")
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).where(remainder != held)
    scored = score(measured, fit(measured, known))
    return scored.select("doc_id", F.coalesce(remainder == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", fold: int = 5, held: int = 0) -> DataFrame:
    """Rows of ``docs`` whose score reaches THRESHOLD, all columns unchanged; learns as ``score_quality`` does."""
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).alias("label")).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold != held)
    measured = written(measure(docs, id_col, text_col), "quality-stats")
    model = fit(measured, known)
    dropped(measured)
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = flat(batch.column(at))
            for lo, hi, part, part_offs in pieces(buf, offs):
                # Rounded as in the table of statistics, so that both ways judge alike.
                stats = statistics(part, part_offs).astype(np.float32).astype(np.float64)
                yield batch.slice(lo, hi - lo).filter(pa.array(predict(model, stats) >= THRESHOLD))

    return docs.mapInArrow(lean(keep), docs.schema)
