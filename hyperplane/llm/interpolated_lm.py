"""LM scoring by deleted interpolation: bigram, unigram and uniform estimates mixed by buckets of the context's frequency.

Tokens are lower-cased words and one end per document.  Training documents give
maximum-likelihood estimates p2 = c(v w) / c(v) and p1 = c(w) / N; p0 is uniform
over V + 1 words.  Weights of the three, one set per power-of-two bucket of
c(v), are learned by expectation-maximisation on held-out counts: each training
token is deleted from the counts that predict it (leave one out).

Tokens travel in *batches*, one binary row for a few megabytes of text: its
documents, its distinct words' hashes in order, and its tokens as word numbers.
Counting is a scatter and a reply: a batch sends each bucket of hashes the
distinct words and bigrams it has and how often its training documents have
them; the bucket adds up and replies with totals in the same order.  Rows in
shuffles are so few and large that the JVM only moves them.

  tokens   batches, one pass over the texts
  totals   words and bigrams to buckets, which reply
  full     batches with the totals of their words and of their tokens' bigrams
  weights  expectation-maximisation on a histogram of (bucket, p2, p1) of fixed size
  score    one pass over the batches

What is gathered grows with the distinct words and bigrams of batches; only
N, V and the histogram (under 700,000 cells at any size) reach the driver.  A
cell of the histogram stands for the geometric means of its tokens' p2 and p1.

Words and bigrams are known by 64-bit hashes.

Cases: a null or empty text has the end token alone.  A row with a null id is
held out.  Without training documents N = V = 0, every estimate is uniform, and
all scores are 0.  Rows are independent, repeated rows count repeatedly.  Only
the named columns are read.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import dropped, released, written
from .textbatch import LOWER, Words, flat, mix, pieces

#: Bytes of text in a batch.
BATCH = 4 << 20
#: One per power of two that a 64-bit count can reach.
CONTEXT_BUCKETS = 64
#: Histogram: tenths of decades of p2 and p1; bin 0 is zero.
P2_BINS, P1_BINS = 82, 122
#: Expectation-maximisation ends when no weight moves by more, or after so many rounds.
STILL, ROUNDS = 1e-7, 2000
END_HASH = np.uint64(0x5851F42D4C957F2D)
START_HASH = np.uint64(0x14057B7EF767814F)
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string; integers of several bytes are stored plane by plane, which compresses better."""
    out = [np.array([len(arrays)], "<u4").tobytes()]
    for a in arrays:
        code = a.dtype.str.encode().ljust(4)
        raw = np.ascontiguousarray(a).view(np.uint8)
        if a.dtype.kind in "iu" and a.itemsize > 1 and len(a):
            raw = raw.reshape(-1, a.itemsize).T
        out += [code, np.array([len(a)], "<u8").tobytes(), raw.tobytes()]
    return b"".join(out)


def unpack(data) -> list[np.ndarray]:
    view, at, out = memoryview(data), 4, []
    for _ in range(int(np.frombuffer(view[:4], "<u4")[0])):
        kind = np.dtype(bytes(view[at : at + 4]).decode().strip())
        n = int(np.frombuffer(view[at + 4 : at + 12], "<u8")[0])
        at += 12
        raw = np.frombuffer(view[at : at + n * kind.itemsize], np.uint8)
        if kind.kind in "iu" and kind.itemsize > 1 and n:
            raw = np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).ravel()
        out.append(raw.view(kind))
        at += n * kind.itemsize
    return out


SENT = "kind int, batch long, bucket int, data binary"


def _rows(kind: int, batch: int, parts: list[tuple[int, bytes]]) -> pa.RecordBatch:
    n = len(parts)
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([batch] * n, pa.int64()), pa.array([b for b, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["kind", "batch", "bucket", "data"])


def _bounds(buckets: int) -> np.ndarray:
    """First hash of each bucket: equal ranges, so that the order of hashes is the order of buckets."""
    return np.array([-(-(i << 64) // buckets) for i in range(buckets)], np.uint64)


def _tokens(most: int):
    """Rows (id, held, text) to batches (kind 0) of ``most`` bytes and more."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            ids, null, out, counts = (np.concatenate([x[k] for x in held]) for k in range(4))
            words, token = np.unique(np.concatenate([x[4] for x in held]), return_inverse=True)
            held.clear()
            return _rows(0, number, [(-1, pack(ids, null, out, counts.astype(np.uint32), words, token.astype(np.uint32)))])

        for batch in batches:
            buf, offs = flat(batch.column(2))
            ids = batch.column(0)
            null = np.asarray(ids.is_null())
            ids = ids.fill_null(0).to_numpy()
            out = batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, part, part_offs in pieces(buf, offs):
                w = Words(part, part_offs)
                counts = w.counts + 1
                h = np.empty(len(w) + hi - lo, np.uint64)
                ends = np.cumsum(counts) - 1
                last = np.zeros(len(h), bool)
                last[ends] = True
                h[ends] = END_HASH
                h[~last] = w.hashes(LOWER)
                held.append((ids[lo:hi], null[lo:hi], out[lo:hi], counts, h))
                size += len(part)
                if size >= most:
                    yield batch_of()
                    size, number = 0, number + 1
        if held:
            yield batch_of()

    return emit


def _steps(h: np.ndarray) -> np.ndarray:
    """Ascending hashes as differences, whose high bytes are mostly zero."""
    return np.diff(h, prepend=np.uint64(0))


def _sent(buckets: int):
    """Batches to their distinct words and bigrams, with training counts, by bucket (kind 1)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = _bounds(buckets)
        for batch in batches:
            for number, data in zip(batch.column(1).to_pylist(), batch.column(3), strict=True):
                b = Batch(data.as_buffer())
                h, _, times = b.pairs()
                word_times = np.bincount(b.token[b.train], minlength=len(b.words))
                cut, word_cut = (np.append(np.searchsorted(x, bounds), len(x)).tolist() for x in (h, b.words))
                parts = []
                for i, (a, z, c, e) in enumerate(zip(cut[:-1], cut[1:], word_cut[:-1], word_cut[1:], strict=True)):
                    if z > a or e > c:
                        parts.append((i, pack(_steps(b.words[c:e]), *_split(word_times[c:e]), _steps(h[a:z]), *_split(times[a:z]))))
                yield _rows(1, number, parts)

    return emit


def _summed(h: list[np.ndarray], times: list[np.ndarray]) -> tuple[list[np.ndarray], int, int]:
    """Totals of equal hashes, in the order of what came in, their sum, and how many are above 0."""
    h_all, n = np.concatenate(h), np.concatenate(times)
    if not len(h_all):
        return [n] * len(h), 0, 0
    order = np.argsort(h_all)
    h_all = h_all[order]
    first = np.flatnonzero(np.concatenate(([True], h_all[1:] != h_all[:-1])))
    total = np.add.reduceat(n[order].astype(np.int64), first)
    of = np.empty(len(h_all), np.int64)
    of[order] = np.repeat(total, np.diff(np.append(first, len(h_all))))
    return np.split(of, np.cumsum([len(x) for x in h])[:-1]), int(total.sum()), int((total > 0).sum())


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: totals in the order of the words and bigrams that each batch sent (kind 2), and sums over words (kind 3)."""

    def replies(bucket: int, got: list[tuple[int, list[np.ndarray]]]) -> Iterator[pa.RecordBatch]:
        words, n, v = _summed([np.cumsum(x[0], dtype=np.uint64) for _, x in got], [_counts(*x[1:4]) for _, x in got])
        pairs, _, _ = _summed([np.cumsum(x[4], dtype=np.uint64) for _, x in got], [_counts(*x[5:8]) for _, x in got])
        yield _rows(3, -1, [(bucket, pack(np.array([n, v], np.int64)))])
        for (number, _), w, p in zip(got, words, pairs, strict=True):
            yield _rows(2, number, [(bucket, pack(*_split(w), *_split(p)))])

    held: list[tuple[int, list[np.ndarray]]] = []
    last = None
    for batch in batches:
        for number, bucket, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3), strict=True):
            if held and bucket != last:
                yield from replies(last, held)
                held = []
            last = bucket
            held.append((number, unpack(data.as_buffer())))
    if held:
        yield from replies(last, held)


def _narrow(n: np.ndarray) -> np.ndarray:
    """Counts in 32 bits where all fit, in 64 otherwise."""
    return n.astype(np.uint64 if len(n) and n.max() > 0xFFFFFFFF else np.uint32)


def _counts(small: np.ndarray, at: np.ndarray, large: np.ndarray) -> np.ndarray:
    out = small.astype(large.dtype)
    out[at] = large
    return out


def _split(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts as single bytes, and places and values of those above 254."""
    at = np.flatnonzero(n > 254).astype(np.uint32)
    return np.minimum(n, 255).astype(np.uint8), at, _narrow(n[at])


class Batch:
    """A batch's tokens; contexts are the tokens before, or the start of the document (number -1).  ``full`` ones have totals too."""

    def __init__(self, data):
        self.parts = unpack(data)
        self.ids, self.null, self.out, counts, self.words, token = self.parts[:6]
        self.counts, self.token = counts.astype(np.int64), token.astype(np.int64)
        self.ends = np.cumsum(self.counts)
        self.context = np.empty(len(self.token), np.int64)
        self.context[1:] = self.token[:-1]
        self.context[self.ends - self.counts] = -1

    @property
    def train(self) -> np.ndarray:
        """Whether each token is of a training document."""
        return np.repeat(~self.out, self.counts)

    @property
    def totals(self) -> np.ndarray:
        return _counts(*self.parts[6:9])

    def pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(distinct bigrams' hashes in order, number of each token's bigram, training count of each)."""
        key = (self.context + 1) * (len(self.words) + 1) + self.token
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        v, w = self.context[first], self.token[first]
        left = np.where(v < 0, START_HASH, self.words[v])
        h = mix(mix(left) * _PAIR + self.words[w])
        order = np.argsort(h)
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        of = back[of]
        return h[order], of, np.bincount(of[self.train], minlength=len(h))

    def per_doc(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.ends - self.counts) if len(values) else np.zeros(0)


def _with_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (batch, kind descending, bucket), replies before their batch: batches with totals of words and of each token's bigram instead of hashes."""
    replies: list[list[np.ndarray]] = []
    for batch in batches:
        for kind, number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), strict=True):
            if kind:
                replies.append([x.copy() for x in unpack(data.as_buffer())])
                continue
            b = Batch(data.as_buffer())
            words, pairs = (np.concatenate([_counts(*x[k : k + 3]) for x in replies]) for k in (0, 3))
            replies = []
            _, of, _ = b.pairs()
            yield _rows(0, number, [(-1, pack(*b.parts[:4], b.words[:0], b.parts[5], *_split(words), *_split(pairs[of])))])


def estimates(b: Batch, train_docs: int, n: int, deleted: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context bucket, p2, p1) of each token; ``deleted`` leaves the token itself out of all counts."""
    less = 1.0 if deleted else 0.0
    totals = b.totals
    pair = _counts(*b.parts[9:12]).astype(np.float64) - less
    word = totals[b.token].astype(np.float64) - less
    context = np.where(b.context < 0, train_docs, totals[b.context]).astype(np.float64) - less
    p2 = np.where(context > 0, pair / np.maximum(context, 1), 0)
    p1 = word / max(n - less, 1)
    bucket = np.where(context > 0, np.minimum(np.log2(np.maximum(context, 1)).astype(np.int64) + 1, CONTEXT_BUCKETS - 1), 0)
    return bucket, p2, p1


def _bins(p: np.ndarray, n: int) -> np.ndarray:
    return np.where(p > 0, np.clip(np.rint(-10 * np.log10(np.maximum(p, 1e-300))) + 1, 1, n - 1), 0).astype(np.int64)


def _beside(p: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Millionths of decades from the middle of its bin, whole numbers, so that sums don't depend on their order."""
    return np.where(bins > 0, np.rint((np.log10(np.maximum(p, 1e-300)) + (bins - 1) / 10) * 1e6), 0)


def _histogram(train_docs: int, n: int):
    """Tokens of training documents by (context bucket, p2, p1): their number, and how far both lie from the middles of their bins in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(3):
                b = Batch(data.as_buffer())
                train = b.train
                if not train.any():
                    continue
                bucket, p2, p1 = (x[train] for x in estimates(b, train_docs, n, True))
                b2, b1 = _bins(p2, P2_BINS), _bins(p1, P1_BINS)
                some, of = np.unique((bucket * P2_BINS + b2) * P1_BINS + b1, return_inverse=True)
                sums = [np.bincount(of, w, len(some)).astype(np.int64) for w in (None, _beside(p2, b2), _beside(p1, b1))]
                yield pa.RecordBatch.from_arrays([pa.array(some), *map(pa.array, sums)], ["cell", "n", "off2", "off1"])

    return count


def learn_weights(cells: np.ndarray, n: np.ndarray, off2: np.ndarray, off1: np.ndarray, v: int) -> np.ndarray:
    """Weights of p2, p1, p0 by context bucket: expectation-maximisation; a bucket without tokens takes those of the next below with some."""
    bucket, rest = np.divmod(cells, P2_BINS * P1_BINS)
    b2, b1 = np.divmod(rest, P1_BINS)
    value = lambda b, off: np.where(b > 0, 10 ** (off / n / 1e6 - (b - 1) / 10), 0)
    p = np.stack((value(b2, off2), value(b1, off1), np.full(len(cells), 1 / (v + 1))), 1)
    weights = np.tile([0.0, 0.5, 0.5], (CONTEXT_BUCKETS, 1))
    for k in range(CONTEXT_BUCKETS):
        mine = bucket == k
        if not mine.any():
            if k > 0:
                weights[k] = weights[k - 1]
            continue
        own, times = p[mine], n[mine, None] / n[mine].sum()
        w = np.array([1 / 3, 1 / 3, 1 / 3])
        for _ in range(ROUNDS):
            share = own * w
            share /= share.sum(1, keepdims=True)
            before, w = w, (share * times).sum(0)
            if np.abs(w - before).max() < STILL:
                break
        weights[k] = np.maximum(w, 1e-6)
        weights[k] /= weights[k].sum()
    # A context never seen has no p2.
    weights[0] = np.array([0, weights[0][1], weights[0][2]]) / (weights[0][1] + weights[0][2])
    return weights


def _scored(weights: np.ndarray, train_docs: int, n: int, v: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(3):
                b = Batch(data.as_buffer())
                c = b.totals[b.token].astype(np.float64)
                base = b.per_doc(np.log10((c + 1) / (n + v + 1)))
                if n:
                    bucket, p2, p1 = estimates(b, train_docs, n, False)
                    w = weights[bucket]
                    own = b.per_doc(np.log10(w[:, 0] * p2 + w[:, 1] * p1 + w[:, 2] / (v + 1)))
                else:
                    own = base
                known = b.per_doc((c > 0).astype(np.int64))
                ids = pa.array(b.ids, mask=b.null.astype(bool))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(b.out.astype(bool)), pa.array(b.counts), pa.array(known), pa.array(np.full(len(b.ids), n)), pa.array(base), pa.array(own)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return score


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 7, held: int = 2) -> DataFrame:
    """One row per row of ``docs``: tokens, known tokens, add-one base score, and the model's log10 probability of the text."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = min(4 * parts, 1 << 16)
    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % fold == held, F.lit(True))
    rows = rows.select("doc_id", out.alias("held"), F.coalesce("text", F.lit("")).alias("text"))

    tokens = written(rows.mapInArrow(_tokens(BATCH), SENT), "lm-tokens")
    sent = tokens.mapInArrow(_sent(buckets), SENT).repartition(parts, "bucket").sortWithinPartitions("bucket")
    totals = written(sent.mapInArrow(_added, SENT), "lm-totals")
    del sent
    released(spark)
    sums = np.array([unpack(r.data)[0] for r in totals.where("kind = 3").select("data").collect()] or [[0, 0]])
    n, v = (int(x) for x in sums.sum(0))
    train_docs = rows.select("held").where("not held").count()
    # Batches, each after its replies.
    answered = tokens.unionByName(totals.where("kind = 2")).repartition(parts, "batch").sortWithinPartitions("batch", F.desc("kind"), "bucket")
    full = written(answered.mapInArrow(_with_totals, SENT), "lm-full")
    dropped(tokens, totals)
    del answered
    released(spark)
    cells = full.mapInArrow(_histogram(train_docs, n), "cell long, n long, off2 long, off1 long").groupBy("cell").agg(*(F.sum(c).alias(c) for c in ("n", "off2", "off1"))).orderBy("cell").toArrow()
    cell, *sums = (cells.column(c).to_numpy() for c in ("cell", "n", "off2", "off1"))
    weights = learn_weights(cell, *(x.astype(np.float64) for x in sums), v)
    return full.mapInArrow(_scored(weights, train_docs, n, v), "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
