"""Quality rules: repetition coverage from rolling n-gram hashes.

For each document the operator measures which share of its word characters lies
in n-grams that an earlier place of that document holds too (several n), and how
much of its lines repeats earlier ones, beside plain counts.  First occurrences
are not duplicates, so a passage that stands twice counts once.  All work is per document: one pass, no shuffle.

Cases: a null or empty text has no words and no lines, all counts are 0 and it
is not kept.  Rows are independent, so repeated rows give repeated results and
an empty table an empty result.  Columns other than the two named are not read.
A null id is carried through.  Texts of any length are processed whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .textbatch import SAME, Words, flat, inside, mix, ngrams, pieces, spans

#: Highest share of a document's word characters inside duplicated n-grams, by n (fixed values: the published Gopher limits).
MAX_NGRAM_SHARE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Highest share of lines, and of characters in lines, that repeat an earlier line (the published limits), from two such lines on.
MAX_LINE_SHARE = 0.30
MAX_LINE_CHAR_SHARE = 0.20
MIN_DUP_LINES = 2
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[list(b"#*$%&|<>")] = 1
_CODE_POINT = np.ones(256, np.uint8)
_CODE_POINT[0x80:0xC0] = 0

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean,"
    " n_lines long, dup_line_chars long, max_ngram_coverage double, ngram_coverage array<double>"
)


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose key occurs more than once, in order, and whether the key occurs before each."""
    s = np.sort(key)
    twice = s[1:][s[1:] == s[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64), np.zeros(0, bool)
    at = np.searchsorted(twice, key)
    at[at == len(twice)] = 0
    at = np.flatnonzero(twice[at] == key)
    order = np.argsort(key[at], kind="stable")
    again = np.zeros(len(at), bool)
    again[order[1:]] = key[at][order[1:]] == key[at][order[:-1]]
    return at, again


def _inside(first: np.ndarray, n: int, n_words: int) -> np.ndarray:
    """True for the words inside n-word windows that begin at the given words."""
    step = np.zeros(n_words + 1, np.int32)
    np.add.at(step, first, 1)
    np.add.at(step, first + n, -1)
    return np.cumsum(step[:-1]) > 0


def _covered(w: Words, h: np.ndarray, salt: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """True for the words inside an n-word window that its document holds twice or more, and inside one that it holds before."""
    at, counts = inside(w.doc, n)
    twice, again = _repeated(mix(ngrams(h, n)[at] ^ np.repeat(salt, counts))) if len(at) else (at, np.zeros(0, bool))
    return _inside(at[twice], n, len(w)), _inside(at[twice[again]], n, len(w))


def _per_doc(bounds: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i+1]]."""
    total = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def measure(buf: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    """Counts and coverages of each document of a piece."""
    w = Words(buf, offs)
    n_docs = len(offs) - 1
    chars = np.concatenate(([0], np.cumsum(_CODE_POINT[buf], dtype=np.int64)))
    size = chars[w.end] - chars[w.start]
    word_chars = _per_doc(w.doc, size)
    h = w.hashes(SAME)
    salt = mix(np.arange(1, n_docs + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    # Lines: between line feeds and document borders; only those with a word count.
    cut = np.zeros(len(buf) + 1, bool)
    cut[1:] = buf == 10
    cut[offs[:-1]] = True
    cut[len(buf)] = False
    start = np.flatnonzero(cut)
    stop = np.concatenate((start[1:], [len(buf)]))
    # A line ends before its feed; the last of a document ends with the document.
    fed = (stop > start) & (buf[np.maximum(stop - 1, 0)] == 10) if len(buf) else np.zeros(0, bool)
    stop = stop - fed
    begun = np.searchsorted(w.start, start)
    has_word = np.searchsorted(w.start, stop) > begun
    start, stop = start[has_word], stop[has_word]
    owner = np.searchsorted(offs, start, "right") - 1
    key = mix(spans(buf, start, stop) ^ salt[owner]) if len(start) else np.zeros(0, np.uint64)
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(key), bool)
    again[order[1:]] = key[order[1:]] == key[order[:-1]]
    line_size = chars[stop] - chars[start]
    n_lines = np.bincount(owner, minlength=n_docs)
    n_dup = np.bincount(owner[again], minlength=n_docs)
    dup_chars = np.bincount(owner[again], line_size[again], minlength=n_docs).astype(np.int64)
    all_line_chars = np.bincount(owner, line_size, minlength=n_docs)

    shares = []
    for n in MAX_NGRAM_SHARE:
        twice, again = _covered(w, h, salt, n)
        shares.append(_per_doc(w.doc, np.where(again, size, 0)) / np.maximum(word_chars, 1))
        if n == WINDOW:
            n_repeat = _per_doc(w.doc, twice)
    shares = np.array(shares)
    n_words = w.counts
    failed = (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)
    over = (shares > np.array(list(MAX_NGRAM_SHARE.values()))[:, None]).any(0)
    over |= (n_dup >= MIN_DUP_LINES) & ((n_dup > MAX_LINE_SHARE * n_lines) | (dup_chars > MAX_LINE_CHAR_SHARE * all_line_chars))
    return {
        "n_words": n_words, "word_chars": word_chars, "n_symbols": _per_doc(offs, _SYMBOL[buf]), "n_dup_lines": n_dup, "n_repeat_words": n_repeat,
        "base_failed": failed, "kept": ~failed & ~over, "n_lines": n_lines, "dup_line_chars": dup_chars, "max_ngram_coverage": shares.max(0), "ngram_coverage": shares.T,
    }


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = flat(batch.column(1))
        for a, b, part, part_offs in pieces(buf, offs):
            found = measure(part, part_offs)
            coverage = found.pop("ngram_coverage")
            columns = {"doc_id": batch.column(0).slice(a, b - a)} | {k: pa.array(v) for k, v in found.items()}
            width = coverage.shape[1]
            columns["ngram_coverage"] = pa.ListArray.from_arrays(pa.array(np.arange(0, (b - a + 1) * width, width), pa.int32()), pa.array(coverage.ravel()))
            yield pa.RecordBatch.from_pydict(columns)


def repetition_coverage(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: counts, coverages by n-gram length, and the verdict ``kept``.

    ``kept`` is false when the base rule fails (under 20 words, or over 30 % of
    the words in repeated 8-word windows) or any coverage exceeds its limit.
    """
    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(_batches, SCHEMA)
