"""Suffix-array dedup: removes each byte inside a K-byte string that also starts in an earlier document.

Shards are dealt by content, so that equal strings meet.  Every K-byte window
has an anchor, the Q-byte gram with the least hash inside it, leftmost of equals;
equal windows have equal anchors at equal offsets.

1. Copies of whole texts are one document; later ones are removed entirely.
2. Anchors' hashes, 40 bits and a bucket each, are dealt to buckets that find
   those of several documents, and say so to each of these documents.  Of a hash
   that many documents of one batch have, the bucket hears once a batch; these
   documents are told by the batch.  A bucket hands on the documents of any other
   hash that grows common as they come, so it holds few documents of a hash.
3. Only windows of such anchors go on.  Those of one anchor in a row make one
   segment, dealt to a shard by the anchor's hash.
4. A shard merges equal segments, builds the suffix array of the others by
   Larsson-Sadakane refinement, takes common prefixes by Kasai's method, and so
   finds classes of equal windows and the smallest document of each.  An anchor
   that few documents have may still come very often in them: segments are taken
   some at a time, and if their different texts are many, they get several suffix
   arrays, whose firsts leave like those of step 5.
5. Segments of a very common anchor are split over shards by document, into more
   parts the more documents were known as each was told.  Such a shard decides what is not its own first; its firsts leave in the order of
   its suffix array, as sorted runs of windows, which are merged across shards
   by binary search, byte by byte.
6. Removed ranges go back to their documents, and the rest is hashed.

What a task holds is bounded by the number of partitions, which follows
``spark.sql.shuffle.partitions``, and the split of common anchors.

Cases: a null or empty text has no bytes and keeps none; its hash is that of no
bytes.  Texts under K bytes are kept.  Rows with equal ids never remove from
each other; rows with one id are taken to hold one text, and the id's ranges
apply to each.  A row with a null id is kept whole and removes nothing.  Only
the named columns are read.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, dropped, released, without, written
from .textbatch import flat, lean, mix, pieces, spans

K = 50
Q = 24
#: Segments of one anchor that a shard takes; above, the anchor is split by document.
ANCHOR_ROWS = 4096
#: Documents of a batch with one anchor from which on they don't go to its bucket.
COMMON = 256
#: Entries that a bucket takes in before it looks for common anchors among them.
SETTLE = 1 << 22
#: Bytes per anchor: of the grams of a window, about two in K - Q + 2 are the least of some window.
ANCHOR_BYTES = (K - Q + 2) // 2
#: Bytes of segments that are judged at a time, and windows that are looked up at a time.
JUDGED = 1 << 20
WINDOWS = 1 << 18
#: Bytes of packed entries that a worker gathers before it deals them out.
GATHER = 16 << 20
_LOW57 = np.uint64((1 << 57) - 1)
_LOW40 = np.uint64((1 << 40) - 1)
_SPLIT = np.uint64(58)
_LOW32 = np.uint64((1 << 32) - 1)


def anchors(buf: np.ndarray, offs: np.ndarray, k: int = K, q: int = Q) -> tuple[np.ndarray, np.ndarray]:
    """(window start, anchor position) of every window of k bytes within a document."""
    size = np.diff(offs)
    count = np.maximum(size - k + 1, 0)
    if not count.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    w = gram_hashes(buf, q)
    # Half of the hash, whatever the length of the buffer, and the position below it: leftmost of equal hashes.
    v = (w & ~_LOW32) | np.arange(len(w), dtype=np.uint64)
    span, have = k - q + 1, 1
    while have < span:
        step = min(have, span - have)
        v = np.minimum(v[:-step], v[step:])
        have += step
    start = np.repeat(offs[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    return start, (v[start] & _LOW32).astype(np.int64)


def gram_hashes(buf: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of every q-byte gram; q is a multiple of 8."""
    n = len(buf)
    padded = np.zeros((n // 8 + 2) * 8, np.uint8)
    padded[:n] = buf
    word = np.empty(n, np.uint64)
    for a in range(8):
        part = padded[a : a + (len(padded) - a) // 8 * 8].view(np.uint64)
        word[a::8] = part[: len(word[a::8])]
    h = word[: n - q + 1] * np.uint64(0x9E3779B97F4A7C15)
    for j in range(8, q, 8):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + word[j : n - q + 1 + j] * np.uint64(0xC2B2AE3D27D4EB4F)
    return mix(h)


def _blobs(column: np.ndarray, parts: int, table: np.ndarray) -> list[tuple[int, bytes]]:
    """Rows of ``table`` by the value of ``column`` below parts, in their order."""
    order = np.argsort(column.astype(np.uint32), kind="stable")
    cut = np.searchsorted(column[order], np.arange(parts + 1))
    table = table[order]
    return [(int(i), table[cut[i] : cut[i + 1]].tobytes()) for i in np.flatnonzero(cut[1:] > cut[:-1])]


def _rows(blobs: list[tuple[int, bytes]], kind: int = 0) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in blobs], pa.int32()), pa.array([kind] * len(blobs), pa.int32()), pa.array([x for _, x in blobs], pa.binary())], ["part", "kind", "data"])


PACKED = "part int, kind int, data binary"
#: Seven bytes per anchor and ten per document and bucket.
_DOC = np.dtype([("doc", "<i8"), ("n", "<u2")])


def _named(h: np.ndarray, buckets: int) -> np.ndarray:
    """Hashes of grams as 40 bits below their bucket."""
    h = h & _LOW57
    return ((h // np.uint64(buckets)) & _LOW40) | ((h % np.uint64(buckets)) << np.uint64(40))


def _parts_of(n: np.ndarray) -> np.ndarray:
    """Into how many parts, as a power of two, anchors of n documents are split: two at least."""
    return np.maximum(np.ceil(np.log2(np.maximum(n / ANCHOR_ROWS, 1))), 1).astype(np.uint64)


def _common(h: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document), sorted and once each, of hashes that COMMON documents or more have."""
    some = np.sort(h)
    some = np.unique(some[: max(len(h) - COMMON + 1, 0)][some[COMMON - 1 :] == some[: max(len(h) - COMMON + 1, 0)]])
    if not len(some):
        return h[:0], d[:0]
    mine = np.isin(h, some)
    h, d = h[mine], d[mine]
    order = np.lexsort((d, h))
    h, d = h[order], d[order]
    # A document may have a hash many times.
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])))
    h, d = h[new], d[new]
    _, of, n = np.unique(h, return_inverse=True, return_counts=True)
    return h[n[of] >= COMMON], d[n[of] >= COMMON]


def _anchor_buckets(buckets: int, groups: int, total: int):
    """Anchors of documents (id, text): per bucket, documents with their numbers of anchors, and 40-bit hashes (kind 0).

    Common hashes of a batch: their names and how many of about ``total`` anchors they are (1), and what their documents are told (2).
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_h, held_d, size = [], [], 0

        def deal() -> Iterator[pa.RecordBatch]:
            h, d = np.concatenate(held_h), np.concatenate(held_d)
            held_h.clear(), held_d.clear()
            common, told = _common(h, d)
            if len(common):
                name, of, n = np.unique(common, return_inverse=True, return_counts=True)
                n = (n * max(1, total / len(h))).astype(np.uint64)
                yield _rows(_blobs(name >> np.uint64(40), buckets, np.stack((name, n), 1)), 1)
                table = np.stack((told.view(np.uint64), common | (_parts_of(n)[of] << _SPLIT)), 1)
                yield _rows(_blobs(np.mod(told, groups), groups, table), 2)
                rest = ~np.isin(h, name)
                h, d = h[rest], d[rest]
            bucket = h >> np.uint64(40)
            order = np.argsort(bucket.astype(np.uint32), kind="stable")
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
            out = []
            for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                mine = order[cut[i] : cut[i + 1]]
                docs, value = d[mine], h[mine]
                new = np.flatnonzero(np.concatenate(([True], docs[1:] != docs[:-1])))
                # Counts above 65535 take several entries.
                n = np.diff(np.concatenate((new, [len(docs)])))
                times = (n + 65534) // 65535
                head = np.zeros(times.sum(), _DOC)
                head["doc"] = np.repeat(docs[new], times)
                head["n"] = 65535
                head["n"][np.cumsum(times) - 1] = n - (times - 1) * 65535
                low = (value & np.uint64(0xFFFFFFFF)).astype("<u4")
                high = ((value >> np.uint64(32)) & np.uint64(0xFF)).astype(np.uint8)
                out.append((i, np.array([len(head), len(docs)], "<u4").tobytes() + head.tobytes() + low.tobytes() + high.tobytes()))
            yield _rows(out)

        for batch in batches:
            buf, offs = flat(batch.column(1))
            ids = batch.column(0).to_numpy()
            for lo, hi, part, part_offs in pieces(buf, offs):
                start, at = anchors(part, part_offs)
                if not len(at):
                    continue
                doc = np.searchsorted(part_offs, start, "right") - 1
                new = np.ones(len(at), bool)
                new[1:] = at[1:] != at[:-1]
                h = _named(gram_hashes(part)[at[new]], buckets)
                held_h.append(h)
                held_d.append(ids[lo:hi][doc[new]])
                size += 16 * len(h)
            if size > GATHER:
                yield from deal()
                size = 0
        if size:
            yield from deal()

    return emit


class _Bucket:
    """Entries of buckets, by hash: documents of common hashes are given out as they come, those of others stay until the end."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0
        self.least = SETTLE
        #: Names of common hashes, sorted, and how many documents are known of each.
        self.common = np.zeros(0, np.uint64)
        self.known = np.zeros(0, np.uint64)

    def add(self, h: np.ndarray, d: np.ndarray) -> None:
        self.held.append((h, d))
        self.size += len(h)

    def tell(self, names: np.ndarray, n: np.ndarray) -> None:
        """Hashes are common, with so many documents more."""
        names, of = np.unique(np.concatenate((self.common, names)), return_inverse=True)
        known = np.zeros(len(names), np.uint64)
        np.add.at(known, of, np.concatenate((self.known, n)))
        self.common, self.known = names, known

    def settled(self, last: bool) -> np.ndarray:
        """(document, hash with its split) of what is common by now; of all that several documents have, if nothing more comes."""
        if not self.size:
            return np.zeros((0, 2), np.uint64)
        h, d = (np.concatenate([x[k] for x in self.held]) for k in (0, 1))
        self.held.clear()
        order = np.argsort(h)
        h, d = h[order], d[order]
        del order
        first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        n = np.diff(np.concatenate((first, [len(h)])))
        keep = np.ones(len(h), bool)
        grown = []
        for i in np.flatnonzero(n > ANCHOR_ROWS).tolist():
            a, b = int(first[i]), int(first[i] + n[i])
            docs = np.unique(d[a:b])
            d[a : a + len(docs)] = docs
            keep[a + len(docs) : b] = False
            if len(docs) > ANCHOR_ROWS:
                grown.append(i)
        names = h[first]
        if len(self.common) or grown:
            at = np.isin(names, self.common)
            at[grown] = True
            real = np.add.reduceat(keep, first, dtype=np.int64)
            self.tell(names[at], real[at].astype(np.uint64))
        common = np.isin(names, self.common)
        split = np.zeros(len(names), np.uint64)
        split[common] = _parts_of(self.known[np.searchsorted(self.common, names[common])])
        give = common.copy()
        if last:
            give |= np.minimum.reduceat(d, first) != np.maximum.reduceat(d, first)
        mine = np.repeat(give, n) & keep
        out = np.stack((d[mine].view(np.uint64), (h | (np.repeat(split, n) << _SPLIT))[mine]), 1)
        self.size = 0
        if not last:
            stay = ~np.repeat(give, n) & keep
            self.add(h[stay], d[stay])
            # As much again comes in before the next look, so that looks stay few.
            self.least = self.size + max(SETTLE, self.size)
        return out


def _repeated(groups: int):
    """Of each bucket: (id, hash) of anchors that several documents have, dealt back by document; common ones say into how many parts they split."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = _Bucket()

        def told(table: np.ndarray) -> Iterator[pa.RecordBatch]:
            for a in range(0, len(table), 1 << 20):
                part = table[a : a + (1 << 20)]
                yield _rows(_blobs(np.mod(part[:, 0].view(np.int64), groups), groups, part))

        for batch in batches:
            for part, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = data.as_buffer()
                if kind == 2:
                    yield _rows([(part, data.to_pybytes())])
                    continue
                if kind == 1:
                    table = np.frombuffer(data, np.uint64).reshape(-1, 2)
                    bucket.tell(table[:, 0], table[:, 1])
                    continue
                n_docs, n = np.frombuffer(data, "<u4", 2).tolist()
                head = np.frombuffer(data, _DOC, n_docs, 8)
                at = 8 + n_docs * _DOC.itemsize
                low = np.frombuffer(data, "<u4", n, at).astype(np.uint64)
                high = np.frombuffer(data, np.uint8, n, at + 4 * n).astype(np.uint64)
                # The bucket goes above the 40 bits, so hashes of several buckets in a task stay apart.
                bucket.add((low | (high << np.uint64(32))) + (np.uint64(part) << np.uint64(40)), np.repeat(head["doc"], head["n"]))
                if bucket.size >= bucket.least:
                    yield from told(bucket.settled(False))
        yield from told(bucket.settled(True))

    return find


#: A window that is the first of its shard.  Windows have one length, so that order by bytes holds for them with zeros at the end too.
_FIRST = np.dtype([("window", f"S{K}"), ("doc", "<i8"), ("place", "<i8")])
#: A segment's entry before its bytes: anchor, document, start, length.
_SEGMENT = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("start", "<u4"), ("size", "<u2")])


def _segments(buckets: int, shards: int):
    """Rows sorted by (group, kind): answers (0) and then documents (1); gives segments of windows with repeated anchors, by shard."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers: list[np.ndarray] = []
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size, group, key, word = 0, None, None, None

        def deal() -> pa.RecordBatch:
            head = np.concatenate([x[0] for x in held])
            shard = np.concatenate([x[1] for x in held])
            body = np.concatenate([x[2] for x in held])
            offs = np.concatenate(([0], np.cumsum(head["size"], dtype=np.int64)))
            order = np.argsort(shard, kind="stable")
            cut = np.searchsorted(shard[order], np.arange(shards + 1))
            out = []
            for i in np.flatnonzero(cut[1:] > cut[:-1]).tolist():
                mine = order[cut[i] : cut[i + 1]]
                n = head["size"][mine].astype(np.int64)
                at = np.repeat(offs[mine] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                out.append((i, np.array([len(mine)], "<u4").tobytes() + head[mine].tobytes() + body[at].tobytes()))
            return _rows(out)

        for batch in batches:
            kinds, groups = batch.column(1).to_numpy(), batch.column(0).to_numpy()
            edge = np.flatnonzero((kinds[1:] != kinds[:-1]) | (groups[1:] != groups[:-1])) + 1
            for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(kinds)], strict=True):
                if b == a:
                    continue
                if groups[a] != group:
                    answers, group, key = [], groups[a], None
                if kinds[a] == 0:
                    answers += [np.frombuffer(x.as_buffer(), np.uint64).reshape(-1, 2).copy() for x in batch.column(2).slice(a, b - a)]
                    continue
                if not answers:
                    continue
                if key is None:
                    table = np.concatenate(answers)
                    key = mix(mix(table[:, 0]) ^ (table[:, 1] & _LOW57))
                    order = np.argsort(key)
                    key, word = key[order], table[order, 1]
                buf, offs = flat(batch.column(2).slice(a, b - a))
                ids = batch.column(3).slice(a, b - a).to_numpy()
                for lo, _, part, part_offs in pieces(buf, offs):
                    start, at = anchors(part, part_offs)
                    if not len(at):
                        continue
                    doc = np.searchsorted(part_offs, start, "right") - 1
                    # Windows in a row with one anchor are one segment.
                    new = np.ones(len(at), bool)
                    new[1:] = (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
                    first = np.flatnonzero(new)
                    last = np.concatenate((first[1:], [len(at)])) - 1
                    h = _named(gram_hashes(part)[at[first]], buckets)
                    own = ids[lo + doc[first]]
                    want = mix(mix(own.view(np.uint64)) ^ h)
                    pos = np.minimum(np.searchsorted(key, want), len(key) - 1)
                    ok = key[pos] == want
                    if not ok.any():
                        continue
                    first, last, h, own, split = first[ok], last[ok], h[ok], own[ok], word[pos[ok]] >> np.uint64(58)
                    head = np.zeros(len(first), _SEGMENT)
                    head["anchor"], head["doc"] = h | (split << np.uint64(58)), own
                    head["start"] = start[first] - part_offs[doc[first]]
                    head["size"] = start[last] - start[first] + K
                    salt = mix(own.view(np.uint64)) & ((np.uint64(1) << split) - np.uint64(1))
                    shard = (mix(h ^ (salt << np.uint64(20))) % np.uint64(shards)).astype(np.int64)
                    n = head["size"].astype(np.int64)
                    body = part[np.repeat(start[first] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                    held.append((head, shard, body))
                    size += len(body) + head.nbytes
                    if size > GATHER:
                        yield deal()
                        held.clear()
                        size = 0
        if held:
            yield deal()

    return emit


def suffix_array(text: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank) by Larsson-Sadakane refinement; position i's suffix ends at end[i], equal suffixes in order of position.

    Ranks start from seven bytes; each round doubles the depth and sorts only
    positions whose rank several share.
    """
    n = len(text)
    key = np.zeros(n, np.uint64)
    at = np.arange(n)
    for h in range(7):
        inside = at + h < end
        symbol = np.where(inside, text[np.minimum(at + h, n - 1)].astype(np.uint64) + np.uint64(1), np.uint64(0))
        key = (key << np.uint64(9)) | symbol
    sa = np.argsort(key, kind="stable")
    key = key[sa]
    head = np.ones(n, bool)
    head[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.flatnonzero(head)[np.cumsum(head) - 1]
    depth, longest = 7, int((end - at).max()) if n else 0
    while depth < longest:
        single = head & np.concatenate((head[1:], [True]))
        open_ = np.flatnonzero(~single)
        if not len(open_):
            break
        p = sa[open_]
        onward = np.where(p + depth < end[p], rank[np.minimum(p + depth, n - 1)] + 1, 0)
        pair = (rank[p].astype(np.uint64) << np.uint64(32)) | onward.astype(np.uint64)
        order = np.argsort(pair, kind="stable")
        sa[open_] = p = p[order]
        pair = pair[order]
        new = np.ones(len(pair), bool)
        new[1:] = pair[1:] != pair[:-1]
        head[open_] = new
        rank[p] = open_[np.flatnonzero(new)[np.cumsum(new) - 1]]
        depth *= 2
    rank[sa] = np.arange(n)
    return sa, rank


def common_prefixes(text: np.ndarray, start: np.ndarray, stop: np.ndarray, sa: np.ndarray, rank: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Kasai's common prefixes of neighbours in the suffix array, all segments [start, stop) stepping together."""
    out = np.zeros(len(text), np.int32)
    size = stop - start
    order = np.argsort(-size, kind="stable")
    start, size = start[order], size[order]
    have = np.zeros(len(start), np.int64)
    for step in range(int(size[0]) if len(size) else 0):
        live = int(np.searchsorted(-size, -step))
        p = start[:live] + step
        r = rank[p]
        before = sa[np.maximum(r - 1, 0)]
        h = np.maximum(have[:live] - 1, 0)
        room = np.minimum(end[p] - p, end[before] - before)
        room[r == 0] = 0
        h = np.minimum(h, room)
        go = np.flatnonzero(h < room)
        while len(go):
            same = text[p[go] + h[go]] == text[before[go] + h[go]]
            go = go[same]
            h[go] += 1
            go = go[h[go] < room[go]]
        have[:live] = h
        out[r] = h
    return out


def _judged(groups: int, merges: int):
    """Of a shard's segments: removed ranges by group of documents (0), and windows to merge across shards (1)."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, bodies = [], []
        for batch in batches:
            for data in batch.column(2):
                data = data.as_buffer()
                n = int(np.frombuffer(data, "<u4", 1)[0])
                heads.append(np.frombuffer(data, _SEGMENT, n, 4))
                bodies.append(np.frombuffer(data, np.uint8, -1, 4 + n * _SEGMENT.itemsize))
        if not heads:
            return
        head, body = np.concatenate(heads), np.concatenate(bodies)
        heads.clear(), bodies.clear()
        del batch, data
        # Sets of anchors of about a million bytes each are judged apart: equal windows have one anchor.
        anchor = head["anchor"]
        by = np.argsort(anchor, kind="stable")
        size = head["size"].astype(np.int64)
        offs = np.concatenate(([0], np.cumsum(size)))
        total = np.concatenate(([0], np.cumsum(size[by])))
        border = np.concatenate(([0], np.flatnonzero(anchor[by][1:] != anchor[by][:-1]) + 1, [len(by)]))
        for a, b in _turns(np.diff(total[border]), JUDGED):
            mine = by[border[a] : border[b]]
            yield from _judge_part(head[mine], body, offs[mine], groups, merges)

    return judge


def _ranges(flag: np.ndarray, owner: np.ndarray, at: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """(id, first byte, end) of runs of flagged windows; owner: segment of each window, at: its place there."""
    some = np.flatnonzero(flag)
    if not len(some):
        return np.zeros((0, 3), np.int64)
    new = np.ones(len(some), bool)
    new[1:] = (owner[some[1:]] != owner[some[:-1]]) | (some[1:] != some[:-1] + 1)
    first = some[new]
    last = some[np.concatenate((np.flatnonzero(new)[1:], [len(some)])) - 1]
    begin = start[owner[first]].astype(np.int64) + at[first]
    return np.stack((doc[owner[first]], begin, start[owner[last]].astype(np.int64) + at[last] + K), 1)


def _turns(size: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """(first, end) of stretches whose sizes add up to ``most``, or that are one."""
    total = np.concatenate(([0], np.cumsum(size)))
    a = 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(total, total[a] + most, "right")) - 1)
        yield a, b
        a = b


def _judge_part(head: np.ndarray, body: np.ndarray, offs: np.ndarray, groups: int, merges: int) -> Iterator[pa.RecordBatch]:
    size = head["size"].astype(np.int64)
    h = np.empty(len(head), np.uint64)
    for a, b in _turns(size, JUDGED):
        h[a:b] = spans(*_compact(body, offs[a:b], size[a:b]))
    # Equal segments are one text; the suffix array holds each once.
    order = np.lexsort((head["doc"], h))
    hs = h[order]
    new = np.ones(len(hs), bool)
    new[1:] = hs[1:] != hs[:-1]
    del h, hs
    first = np.flatnonzero(new)
    # One anchor may have many different texts: several suffix arrays, whose firsts are merged as those of a split anchor.
    turns = list(_turns(size[order[first]], JUDGED))
    for a, b in turns:
        segments = order[first[a] : first[b] if b < len(first) else len(order)]
        yield from _judge_texts(head, body, offs, size, segments, len(turns) > 1, groups, merges, new[first[a] : first[a] + len(segments)])


def _judge_texts(head: np.ndarray, body: np.ndarray, offs: np.ndarray, size: np.ndarray, segments: np.ndarray, several: bool, groups: int, merges: int, new: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of segments in order of their texts; ``new``: whether it is the first of its text, which has the smallest document."""
    chosen = segments[new]
    text_of = np.cumsum(new) - 1
    text, start, stop = _compact(body, offs[chosen], size[chosen])
    smallest = head["doc"][chosen]
    end = np.repeat(stop, stop - start)
    sa, rank = suffix_array(text, end)
    lcp = common_prefixes(text, start, stop, sa, rank, end)
    # Classes of windows: neighbours with a common prefix of K bytes or more.
    cls = np.cumsum(lcp < K)
    del sa, lcp
    owner_text = np.repeat(np.arange(len(start)), stop - start)
    window = np.flatnonzero(end - np.arange(len(text)) >= K)
    least = np.full(int(cls[-1]) + 1 if len(cls) else 1, np.iinfo(np.int64).max)
    window_cls = cls[rank[window]]
    np.minimum.at(least, window_cls, smallest[owner_text[window]])
    least_of = least[window_cls]
    del cls, end, owner_text, window, window_cls
    merge_of = None
    count = (stop - start) - K + 1
    first_window = np.cumsum(count) - count
    # Back to every segment, some at a time: its text's windows in a row.
    for a, b in _turns(count[text_of], WINDOWS):
        mine, text_at = head[segments[a:b]], text_of[a:b]
        n = count[text_at]
        owner = np.repeat(np.arange(b - a), n)
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        later = mine["doc"][owner] > least_of[first_window[text_at][owner] + at]
        found = _ranges(later, owner, at, mine["doc"], mine["start"])
        if len(found):
            yield _rows(_blobs(np.mod(found[:, 0], groups), groups, found), 0)
        shared = several | ((mine["anchor"] >> np.uint64(58)) > 0)
        own = np.flatnonzero(~later & shared[owner])
        if len(own):
            # Firsts of a split anchor's windows, in the order of the suffix array: bytes, document and place.
            text_at = start[text_at[owner[own]]] + at[own]
            by_rank = np.argsort(rank[text_at])
            own, text_at = own[by_rank], text_at[by_rank]
            table = np.empty(len(own), _FIRST)
            table["window"] = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, K)[text_at]).view(f"S{K}")[:, 0]
            table["doc"] = mine["doc"][owner[own]]
            table["place"] = mine["start"][owner[own]].astype(np.int64) + at[own]
            if merge_of is None:
                merge_of = (gram_hashes(text, 48) % np.uint64(merges)).astype(np.int64)
            yield _rows(_blobs(merge_of[text_at], merges, table), 1)


def _compact(body: np.ndarray, offs: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    stop = np.cumsum(size)
    start = stop - size
    return body[np.repeat(offs - start, size) + np.arange(int(stop[-1]))], start, stop


def merged_runs(runs: list[np.ndarray]) -> np.ndarray:
    """Sorted runs of windows as one: of two, the shorter's places in the longer are found by binary search."""
    while len(runs) > 1:
        runs.sort(key=len)
        joined = [np.insert(b, np.searchsorted(b["window"], a["window"]), a) for a, b in zip(runs[::2], runs[1::2], strict=False)]
        runs = joined + ([runs[-1]] if len(runs) % 2 else [])
    return runs[0]


def _merged(groups: int):
    """Windows of split anchors, one sorted run per shard: later documents lose the window."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = [np.frombuffer(x.as_buffer(), _FIRST).copy() for batch in batches for x in batch.column(2)]
        if not runs:
            return
        table = merged_runs(runs)
        runs.clear()
        first = np.flatnonzero(np.concatenate(([True], table["window"][1:] != table["window"][:-1])))
        least = np.repeat(np.minimum.reduceat(table["doc"], first), np.diff(np.append(first, len(table))))
        late = table[table["doc"] > least]
        found = np.stack((late["doc"], late["place"], late["place"] + K), 1)
        if len(found):
            yield _rows(_blobs(np.mod(found[:, 0], groups), groups, found), 0)

    return merge


def _ranges_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merged ranges of each document, from all ranges of a partition's groups."""
    held = [np.frombuffer(x.as_buffer(), np.int64).reshape(-1, 3).copy() for batch in batches for x in batch.column(2)]
    if not held:
        return
    t = np.concatenate(held)
    t = t[np.lexsort((t[:, 1], t[:, 0]))]
    new_doc = np.ones(len(t), bool)
    new_doc[1:] = t[1:, 0] != t[:-1, 0]
    # The furthest end so far within a document: documents are shifted apart.
    of = np.cumsum(new_doc) - 1
    apart = of * (int(t[:, 2].max()) + 1)
    reach = np.maximum.accumulate(t[:, 2] + apart)
    new = new_doc.copy()
    new[1:] |= t[1:, 1] + apart[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.concatenate((first[1:], [len(t)])) - 1
    begin, end, doc = t[first, 1], reach[last] - apart[last], t[first, 0]
    cut = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    stops = np.concatenate((cut[1:], [len(doc)]))
    both = np.stack((begin, end), 1)
    for a in range(0, len(cut), 10_000):
        i, j = cut[a : a + 10_000], stops[a : a + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array([both[x:y].tobytes() for x, y in zip(i, j, strict=True)], pa.binary())], ["doc_id", "ranges"])


def _cut(raw: memoryview, ranges: bytes) -> tuple[int, int, list]:
    """(removed bytes, ranges, kept pieces) of a text."""
    kept, at, removed, n = [], 0, 0, 0
    for a, b in np.frombuffer(ranges, np.int64).reshape(-1, 2).tolist():
        b = min(b, len(raw))
        if a >= b:
            continue
        kept.append(raw[at:a])
        removed, n, at = removed + b - a, n + 1, b
    kept.append(raw[at:])
    return removed, n, kept


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        removed, spans_, digests = [], [], []
        for text, ranges in zip(batch.column(1), batch.column(2), strict=True):
            r, n, kept = _cut(memoryview(text.as_buffer()), ranges.as_py())
            digest = hashlib.sha256()
            for x in kept:
                digest.update(x)
            removed.append(r), spans_.append(n), digests.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(removed, pa.int64()), pa.array(spans_, pa.int64()), pa.array(digests, pa.string())], ["doc_id", "n_removed", "n_spans", "kept_sha256"])


def _without(at: int):
    """Rows with their ranges last, to rows without the bytes of their ranges; bytes of a character that a range cut go with it, and emptied rows go."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for text, ranges in zip(batch.column(at), batch.column(batch.num_columns - 1), strict=True):
                if ranges.is_valid and text.is_valid:
                    kept = b"".join(_cut(memoryview(text.as_buffer()), ranges.as_py())[2]).decode("utf-8", "ignore")
                    keep.append(bool(kept.strip()))
                else:
                    kept = text.as_py()
                    keep.append(True)
                texts.append(kept)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1]).filter(pa.array(keep, pa.bool_()))

    return cut


class Removal:
    """What is to be removed from ``docs``: ``meta`` (doc_id, n_bytes, sha, copy) per row, and ``ranges`` (doc_id, ranges) of documents that aren't copies."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text"):
        spark = docs.sparkSession
        parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"coalesce(cast(`{text_col}` as string), '') text")
        sized = written(self.rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(F.col("text").cast("binary"), 256).alias("sha")), "suffix-sized")
        # A table of its own, so that the join on the hash has plain shuffles on both sides and a large group of copies is split.
        first = sized.where(F.col("n_bytes") >= K).groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k")
        first = written(first, "suffix-firsts")
        copies = written(sized.where(F.col("n_bytes") >= K).join(first, "sha").where("doc_id > first").select("doc_id").distinct(), "suffix-copies")
        self.n_copies = copies.count()
        self.copies = F.broadcast(copies) if self.n_copies <= BROADCAST_ROWS else copies
        self.sized = sized
        self.once = self.rows.where(f"doc_id is not null and octet_length(text) >= {K}").join(self.copies, "doc_id", "left_anti")

        buckets, groups, shards = min(2 * parts, 1 << 16), 4 * parts + 1, 4 * parts
        total = (sized.agg(F.sum("n_bytes")).first()[0] or 0) // ANCHOR_BYTES
        dealt = self.once.mapInArrow(lean(_anchor_buckets(buckets, groups, total)), PACKED).repartition(parts, "part")
        answers = dealt.mapInArrow(lean(_repeated(groups)), PACKED)
        texts = self.once.select(F.pmod("doc_id", F.lit(groups)).cast("int").alias("part"), F.lit(1).alias("kind"), F.col("text").cast("binary").alias("data"), "doc_id")
        both = answers.withColumn("doc_id", F.lit(0).cast("long")).unionByName(texts)
        sorted_ = both.repartition(parts, "part").sortWithinPartitions("part", "kind")
        segments = sorted_.mapInArrow(lean(_segments(buckets, shards)), PACKED).repartition(parts, "part")
        judged = written(segments.mapInArrow(lean(_judged(groups, shards)), PACKED), "suffix-judged")
        merged = judged.where("kind = 1").repartition(parts, "part").mapInArrow(lean(_merged(groups)), PACKED)
        all_ranges = judged.where("kind = 0").unionByName(merged).repartition(parts, "part")
        released(spark)
        self.ranges = written(all_ranges.mapInArrow(lean(_ranges_of), "doc_id long, ranges binary"), "suffix-ranges")
        dropped(judged, first)

    def cut(self) -> DataFrame:
        """(doc_id, text as binary, ranges) of rows that lose a part."""
        return self.once.join(self.ranges, "doc_id").select("doc_id", F.col("text").cast("binary").alias("text"), "ranges")


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: bytes, removed bytes, removed runs, and the hash of what is kept."""
    r = Removal(docs, id_col, text_col)
    cut = r.cut().mapInArrow(lean(_measured), "doc_id long, n_removed long, n_spans long, kept_sha256 string").dropDuplicates(["doc_id"])
    copies = r.copies.withColumn("copy", F.lit(True))
    out = r.sized.join(copies, "doc_id", "left").join(cut, "doc_id", "left")
    nothing = hashlib.sha256().hexdigest()
    copy = F.coalesce(F.col("copy") & (F.col("n_bytes") >= K), F.lit(False))
    return out.select(
        "doc_id", "n_bytes", F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"), F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``docs`` without what repeats: later copies of whole texts go, other texts lose their ranges, all else stays."""
    r = Removal(docs, id_col, text_col)
    ranges = r.ranges.select(F.col("doc_id").alias(id_col), F.col("ranges").alias("_removed_ranges"))
    rest = without(docs, r.copies, id_col).join(ranges, id_col, "left").select(*docs.columns, "_removed_ranges")
    return rest.mapInArrow(lean(_without(docs.columns.index(text_col))), docs.schema)
