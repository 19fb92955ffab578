"""Benchmark decontamination: prefix-filtered set join of item windows against whole documents.

Words are lower-cased runs of letters, digits and non-ASCII characters.  A
window is 13 consecutive words of an item, or the whole item if it has fewer.
Shingles are three consecutive words (fewer in shorter windows).

1. Every document is read once: its words and the positions of those shingles
   that any item holds.  This table is small and goes to the shared folder.
2. Document counts of those shingles over the whole corpus order them by rarity.
   For containment of a whole window the necessary prefix is one shingle, its
   rarest, so each window is indexed by that shingle and its offset.
3. A document's shingles join the prefix index.  The position bound keeps pairs
   whose window starts and ends inside the document; the length bound keeps
   documents with enough words.
4. A pair is verified exactly: all shingles of the window in their places, which
   is equality of its words.

Items are taken ``BLOCK_WORDS`` words at a time, so what is broadcast is bounded
whatever the size of the benchmark; each block is one pass over the documents,
and hits of all blocks are merged per document.

Cases: a null or empty text has no words, no hits, and is clean; a null or empty
item has no windows and occurs nowhere.  Repeated documents give repeated rows.
Two rows with the same item id are windows of one item.  A document with a null
id is carried through; an item with a null id is left out.  Only the named
columns are read.  An empty benchmark leaves every document clean.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written
from .textbatch import ALNUM_WORDS, LOWER, Words, flat, lean, mix, pieces, spans

WINDOW = 13
SHINGLE = 3
BLOCK_WORDS = 1_000_000


def item_words(text: str | None) -> list[bytes]:
    buf = np.frombuffer((text or "").encode(), np.uint8)
    w = Words(buf, np.array([0, len(buf)]), ALNUM_WORDS)
    return [LOWER[np.frombuffer(w.text(i), np.uint8)].tobytes() for i in range(len(w))]


class Block:
    """Vocabulary, shingles and windows of some items.

    Words are known by 64-bit hashes: a word of a document counts as the item's
    if their hashes are equal.  A shingle is a tuple of word numbers; ``windows`` are (item, shingle
    size, shingle numbers in order).
    """

    def __init__(self, items: list[tuple[int, list[bytes]]]):
        vocabulary: dict[bytes, int] = {}
        shingles: dict[tuple[int, ...], int] = {}
        found: dict[tuple[tuple[int, ...], int], set[int]] = {}
        for item, words in items:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words]
            for at in range(max(1, len(ids) - WINDOW + 1) if ids else 0):
                window = ids[at : at + WINDOW]
                size = min(SHINGLE, len(window))
                numbers = tuple(shingles.setdefault(tuple(window[k : k + size]), len(shingles)) for k in range(len(window) - size + 1))
                found.setdefault((numbers, len(window)), set()).add(item)
        self.vocabulary = vocabulary
        spelled = list(vocabulary)
        data = b"".join(spelled)
        ends = np.cumsum([len(x) for x in spelled], dtype=np.int64) if spelled else np.zeros(0, np.int64)
        starts = ends - np.array([len(x) for x in spelled], np.int64)
        h = spans(np.frombuffer(data, np.uint8), starts, ends, LOWER)
        self.word_order = np.argsort(h)
        self.word_hash = h[self.word_order]
        self.sizes = sorted({len(k) for k in shingles})
        self.tables = {}
        for size in self.sizes:
            keys = np.array([k for k in shingles if len(k) == size], np.int64).reshape(-1, size)
            numbers = np.array([v for k, v in shingles.items() if len(k) == size], np.int64)
            kh = self.shingle_hash(keys)
            order = np.argsort(kh)
            self.tables[size] = kh[order], keys[order], numbers[order]
        self.n_shingles = len(shingles)
        self.windows = [(numbers, n, sorted(ids)) for (numbers, n), ids in found.items()]

    @staticmethod
    def shingle_hash(keys: np.ndarray) -> np.ndarray:
        h = np.zeros(len(keys), np.uint64)
        for k in range(keys.shape[1]):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + keys[:, k].astype(np.uint64) + np.uint64(1))
        return h

    def word_numbers(self, w: Words) -> np.ndarray:
        """Number of each document word in the vocabulary, or -1."""
        out = np.full(len(w), -1, np.int64)
        if not len(w) or not len(self.word_hash):
            return out
        h = w.hashes(LOWER)
        at = np.minimum(np.searchsorted(self.word_hash, h), len(self.word_hash) - 1)
        same = np.flatnonzero(self.word_hash[at] == h)
        out[same] = self.word_order[at[same]]
        return out

    def occurrences(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """(word position in the piece, shingle number) of each shingle of the items, in order of positions."""
        ids = self.word_numbers(w)
        doc_end = np.repeat(w.doc[1:], w.counts)
        places, numbers = [], []
        for size in self.sizes:
            ok = ids >= 0
            for k in range(1, size):
                ok[:-k] &= ids[k:] >= 0
                ok[-k:] = False
            at = np.flatnonzero(ok)
            at = at[at + size <= doc_end[at]]
            if not len(at):
                continue
            keys = np.stack([ids[at + k] for k in range(size)], 1)
            kh, known, number = self.tables[size]
            h = self.shingle_hash(keys)
            pos = np.minimum(np.searchsorted(kh, h), len(kh) - 1)
            same = (kh[pos] == h) & (known[pos] == keys).all(1)
            places.append(at[same])
            numbers.append(number[pos[same]])
        if not places:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at, number = np.concatenate(places), np.concatenate(numbers)
        order = np.argsort(at, kind="stable")
        return at[order], number[order]


class PrefixIndex:
    """Windows of a block by their rarest shingle: the necessary prefix for whole containment."""

    def __init__(self, block: Block, n_docs: np.ndarray):
        self.items = [ids for _, _, ids in block.windows]
        self.length = np.array([n for _, n, _ in block.windows], np.int64)
        self.shingles = [np.array(s, np.int64) for s, _, _ in block.windows]
        keys, offsets = [], []
        for s in self.shingles:
            k = min(range(len(s)), key=lambda i: (n_docs[s[i]], s[i], i))
            keys.append(int(s[k]))
            offsets.append(k)
        order = np.argsort(keys, kind="stable")
        self.window = order
        self.key = np.array(keys, np.int64)[order]
        self.offset = np.array(offsets, np.int64)[order]

    def hits(self, places: np.ndarray, numbers: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """(start, window) of each window that the document holds; ``places`` are positions of its ``numbers``."""
        low, high = np.searchsorted(self.key, numbers), np.searchsorted(self.key, numbers, "right")
        n = high - low
        if not n.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        row = np.repeat(np.arange(len(numbers)), n)
        entry = np.repeat(low - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        start, window = places[row] - self.offset[entry], self.window[entry]
        fits = (start >= 0) & (start + self.length[window] <= n_words)
        start, window = start[fits], window[fits]
        # Shingle sizes differ by window length, so a place may hold several numbers: compare (place, number) pairs.
        have = places * (1 << 32) + numbers
        have.sort()
        ok = np.ones(len(start), bool)
        for k in range(WINDOW):
            rest = np.flatnonzero(ok)
            rest = rest[np.array([k < len(self.shingles[x]) for x in window[rest]], bool)] if len(rest) else rest
            if not len(rest):
                break
            want = (start[rest] + k) * (1 << 32) + np.array([self.shingles[x][k] for x in window[rest]], np.int64)
            pos = np.minimum(np.searchsorted(have, want), len(have) - 1)
            ok[rest] = have[pos] == want
        return start[ok], window[ok]


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Block]:
    """Items in blocks of BLOCK_WORDS words; rows stream to the driver one partition at a time, and only a block is held."""
    held: list[tuple[int, list[bytes]]] = []
    size = 0
    for row in items.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null and text is not null").toLocalIterator():
        words = item_words(row.text)
        # An item longer than a block is cut into stretches that overlap by a window less one word.
        step = BLOCK_WORDS - WINDOW
        for at in range(0, max(1, len(words) - WINDOW + 1), step):
            part = words[at : at + step + WINDOW - 1]
            if held and size + len(part) > BLOCK_WORDS:
                yield Block(held)
                held, size = [], 0
            held.append((row.id, part))
            size += len(part)
    if held:
        yield Block(held)


def _found(docs: DataFrame, block) -> DataFrame:
    """row, doc_id, n_words, and places and numbers of shingles (packed), one row per document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        b: Block = block.value
        for batch in batches:
            buf, offs = flat(batch.column(1))
            for lo, hi, part, part_offs in pieces(buf, offs):
                w = Words(part, part_offs, ALNUM_WORDS)
                at, number = b.occurrences(w)
                cut = np.searchsorted(at, w.doc)
                place = at - np.repeat(w.doc[:-1], np.diff(cut))
                blobs = [np.stack((place[x:y], number[x:y])).astype("<i4").tobytes() if y > x else b"" for x, y in zip(cut[:-1], cut[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(w.counts), pa.array(blobs, pa.binary())], ["doc_id", "text_hash", "n_words", "found"])

    return docs.mapInArrow(lean(scan), "doc_id long, text_hash long, n_words long, found binary")


def _document_counts(found: DataFrame, n: int) -> np.ndarray:
    """How many documents hold each of the n shingles of a block; n is bounded by the block."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for batch in batches:
            for x in batch.column(0):
                if raw := x.as_py():
                    total[np.unique(np.frombuffer(raw, "<i4").reshape(2, -1)[1])] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["number", "n"])

    out = np.zeros(n, np.int64)
    some = found.select("found").mapInArrow(lean(count), "number long, n long").groupBy("number").agg(F.sum("n").alias("n")).toArrow()
    out[some.column("number").to_numpy()] = some.column("n").to_numpy()
    return out


def _judge(found: DataFrame, index) -> DataFrame:
    """doc_id, n_words, words hit and items of one block."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prefix: PrefixIndex = index.value
        for batch in batches:
            n_words = batch.column(2).to_numpy(zero_copy_only=False)
            hit_words, hit_items = [], []
            for x, n in zip(batch.column(3), n_words.tolist(), strict=True):
                raw = x.as_py()
                words, items = [], []
                if raw:
                    places, numbers = np.frombuffer(raw, "<i4").reshape(2, -1).astype(np.int64)
                    start, window = prefix.hits(places, numbers, n)
                    if len(start):
                        step = np.zeros(n + 1, np.int64)
                        np.add.at(step, start, 1)
                        np.add.at(step, start + prefix.length[window], -1)
                        words = np.flatnonzero(np.cumsum(step[:-1]) > 0).tolist()
                        items = sorted({i for k in np.unique(window) for i in prefix.items[k]})
                hit_words.append(words)
                hit_items.append(items)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(hit_words, pa.list_(pa.int32())), pa.array(hit_items, pa.list_(pa.int64()))], ["doc_id", "text_hash", "n_words", "hit_words", "items"])

    return found.mapInArrow(lean(judge), "doc_id long, text_hash long, n_words long, hit_words array<int>, items array<long>")


def sha256_of_items(items) -> F.Column:
    texts = F.array_sort(F.transform(items, lambda x: x.cast("string")))
    return F.sha2(F.concat_ws(",", texts), 256)


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least: int = 20) -> DataFrame:
    """One row per document: words, words inside occurrences of item windows, items found, and ``contaminated`` (a ``least``-th of the words or more)."""
    spark = docs.sparkSession
    rows = docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").withColumn("text_hash", F.xxhash64("text"))
    judged: list[DataFrame] = []
    for block in _blocks(items, item_col, item_text_col):
        if not block.windows:
            continue
        found = written(_found(rows, spark.sparkContext.broadcast(block)), "decontaminate-found")
        prefix = PrefixIndex(block, _document_counts(found, block.n_shingles))
        judged.append(_judge(found, spark.sparkContext.broadcast(prefix)))
    if not judged:
        judged = [_judge(_found(rows, spark.sparkContext.broadcast(Block([]))), spark.sparkContext.broadcast(PrefixIndex(Block([]), np.zeros(0))))]
    merged = judged[0]
    if len(judged) > 1:
        # Every block has one row per document; equal rows merge and are dealt out again as often as they came.
        for more in judged[1:]:
            merged = merged.unionByName(more)
        every = lambda name: F.array_sort(F.array_distinct(F.flatten(F.collect_list(name)))).alias(name)
        merged = merged.groupBy("doc_id", "text_hash", "n_words").agg(every("hit_words"), every("items"), (F.count(F.lit(1)) / len(judged)).cast("int").alias("copies"))
        merged = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    n_hit = F.size("hit_words").cast("long")
    return merged.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), sha256_of_items(F.col("items")).alias("items_sha256"),
        ((n_hit > 0) & (least * n_hit >= F.col("n_words"))).alias("contaminated"), "hit_words", "items",
    )
