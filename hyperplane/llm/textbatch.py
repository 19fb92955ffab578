"""Arrow text columns as flat byte buffers, and vectorised word and n-gram hashing over them.

A *batch* is a ``uint8`` buffer that holds the UTF-8 bytes of many documents one
after another, with ``offs[i]:offs[i+1]`` delimiting document ``i``.  A null text
is an empty document.  All functions work on whole documents; a batch is cut
into pieces of about ``PIECE`` bytes between documents to bound memory, and a
document longer than that is a piece of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20

#: Class tables over bytes: 1 where the byte belongs to a word.
SPACE_WORDS = np.ones(256, np.uint8)
SPACE_WORDS[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
ALNUM_WORDS = np.zeros(256, np.uint8)
ALNUM_WORDS[0x30:0x3A] = ALNUM_WORDS[0x41:0x5B] = ALNUM_WORDS[0x61:0x7B] = ALNUM_WORDS[0x80:] = 1

#: Byte tables: A-Z to a-z, or unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
SAME = np.arange(256, dtype=np.uint8)

_B = np.uint64(0x9E3779B97F4A7C15 | 1)
_B_INV = np.uint64(pow(int(_B), -1, 1 << 64))
_N = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the byte base and of its inverse modulo 2**64, at least n of them."""
    have = _powers.get(0)
    if have is None or len(have[0]) < n:
        size = max(PIECE + 64, n)
        up, down = np.full(size, _B, np.uint64), np.full(size, _B_INV, np.uint64)
        up[0] = down[0] = 1
        have = np.multiply.accumulate(up), np.multiply.accumulate(down)
        if size <= 4 * PIECE:
            _powers[0] = have
    return have


def lean(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, after which the worker gives the memory that it no longer uses back to the system, where the system's C library can."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from f(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return run


def flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Buffer and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offs = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def pieces(buf: np.ndarray, offs: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first document, end document, buffer, offsets) of about ``size`` bytes each, cut between documents."""
    at, n = 0, len(offs) - 1
    while at < n:
        end = max(at + 1, int(np.searchsorted(offs, offs[at] + size, "right")) - 1)
        end = min(end, n)
        yield at, end, buf[offs[at] : offs[end]], offs[at : end + 1] - offs[at]
        at = end


class Words:
    """Words of a piece: ``start``, ``end`` byte positions; ``doc[i]:doc[i+1]`` are the words of document i."""

    __slots__ = ("buf", "doc", "end", "offs", "start")

    def __init__(self, buf: np.ndarray, offs: np.ndarray, classes: np.ndarray = SPACE_WORDS):
        self.buf, self.offs = buf, offs
        inside = classes[buf].view(bool)
        full = offs[1:] > offs[:-1]
        first, last = offs[:-1][full], offs[1:][full] - 1
        edge = np.empty(len(buf), bool)
        edge[1:] = inside[1:] & ~inside[:-1]
        edge[first] = inside[first]
        self.start = np.flatnonzero(edge)
        edge[:-1] = inside[:-1] & ~inside[1:]
        edge[last] = inside[last]
        self.end = np.flatnonzero(edge) + 1
        self.doc = np.searchsorted(self.start, offs)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.doc)

    def of(self) -> np.ndarray:
        """Document number of each word."""
        return np.repeat(np.arange(len(self.offs) - 1), self.counts)

    def hashes(self, table: np.ndarray = LOWER) -> np.ndarray:
        return spans(self.buf, self.start, self.end, table)

    def text(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()


def spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = SAME) -> np.ndarray:
    """64-bit hashes of buf[start:end], bytes mapped through ``table``; polynomial prefix sums, so one pass over the bytes."""
    if not len(start):
        return np.zeros(0, np.uint64)
    up, down = powers(len(buf) + 1)
    total = np.empty(len(buf) + 1, np.uint64)
    total[0] = 0
    value = table[buf].astype(np.uint64)
    value += np.uint64(1)
    value *= up[: len(buf)]
    np.cumsum(value, out=total[1:])
    h = (total[end] - total[start]) * down[start]
    return mix(h ^ ((end - start).astype(np.uint64) << np.uint64(56)))


def ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive items of h, over document borders too; len(h) - n + 1 of them."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out *= _N
        out += h[j : len(h) - n + 1 + j]
    return mix(out + np.uint64(n))


def inside(doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """First positions of the n-word windows that don't cross documents, and how many each document has."""
    counts = np.maximum(np.diff(doc) - n + 1, 0)
    starts = np.repeat(doc[:-1] - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(counts.sum())
    return starts, counts


def shingle_sets(w: Words, n: int = 5, table: np.ndarray = LOWER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct n-word shingles of each document; with fewer words the whole sequence is one; without words none.

    Returns (hashes sorted within documents, document number of each, offsets by document).
    """
    h = w.hashes(table)
    at, counts = inside(w.doc, n)
    grams = ngrams(h, n)[at] if len(at) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(w.offs) - 1), counts)
    short = np.flatnonzero((w.counts > 0) & (w.counts < n))
    if len(short):
        whole = np.array([ngrams(h[w.doc[i] : w.doc[i + 1]], int(w.doc[i + 1] - w.doc[i]))[0] for i in short], np.uint64)
        grams, owner = np.concatenate((grams, whole)), np.concatenate((owner, short))
        order = np.argsort(owner, kind="stable")
        grams, owner = grams[order], owner[order]
    ends = np.searchsorted(owner, np.arange(len(w.offs)))
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
        grams[a:b].sort()
    if len(grams):
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (owner[1:] != owner[:-1])
        grams, owner = grams[new], owner[new]
    return grams, owner, np.searchsorted(owner, np.arange(len(w.offs)))
