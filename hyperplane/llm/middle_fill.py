"""Fill-in-middle: texts are cut at two unit borders and rearranged around sentinels.

A unit is a run of white space with the word behind it, or white space at the end
of the text.  One automaton (Aho-Corasick) over the six white-space characters
and the sentinels gives the sparse events of a text.  Units are counted from the
gaps between white-space events: a gap wider than one character is a word, so it
ends a unit at the event behind it.  The k-th such gap is the border after k
units; words are neither matched nor listed.

Whether and where a text is cut follows from a hash of the seed and its id alone,
so rows are independent: one pass, no shuffle.

Cases: a null or empty text has no units and stays plain, as does a text that
holds a sentinel.  Rows of equal id are cut by the same numbers.  A null id
counts as an empty one and is carried through.  An empty table gives an empty
result.  Other columns are not read, whatever their names.  A text is processed
whole; beside it, events take 8 bytes each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEED = 42
#: Percent of texts that are rearranged, and percent of these with the suffix first.
FIM_PERCENT = 50
SPM_PERCENT = 80
#: Before prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")

_SPACE = " \t\n\x0b\x0c\r"
_FLUSH = 4 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


@lru_cache(maxsize=8)
def automaton(sentinels: tuple[str, ...]) -> ahocorasick.Automaton:
    """White-space characters give 0, sentinels 1."""
    out = ahocorasick.Automaton()
    for c in _SPACE:
        out.add_word(c, 0)
    for s in sentinels:
        out.add_word(s, 1)
    out.make_automaton()
    return out


def events(text: str, sentinels: tuple[str, ...] = SENTINELS) -> tuple[np.ndarray, bool]:
    """Positions of white space in order, and whether any sentinel occurs."""
    found = np.fromiter((2 * end + kind for end, kind in automaton(sentinels).iter(text)), np.int64)
    sentinel = (found & 1).astype(bool)
    return found[~sentinel] >> 1, bool(sentinel.any())


def unit_ends(space: np.ndarray, n_chars: int) -> np.ndarray:
    """End of each unit of a text of n_chars with white space at the given positions."""
    border = np.concatenate(([-1], space, [n_chars]))
    ends = border[1:][np.diff(border) > 1]
    return np.append(ends, n_chars) if len(space) and space[-1] == n_chars - 1 else ends


def draws(seed: int, key: str) -> list[int]:
    """Four 32-bit numbers of a seed and an id."""
    digest = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]


def rearranged(text: str, key: str, seed: int, fim_percent: int, spm_percent: int, sentinels: tuple[str, str, str]) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix_chars, middle_chars, output) of a text."""
    space, reserved = events(text, sentinels)
    ends = unit_ends(space, len(text))
    n = len(ends)
    h = draws(seed, key)
    if not text or reserved or h[2] % 100 >= fim_percent:
        return n, "plain", None, None, text
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    a, b = (int(ends[k - 1]) if k else 0 for k in (low, high))
    before, after, between = sentinels
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_percent:
        return n, "spm", a, b - a, f"{after}{suffix}{before}{prefix}{between}{middle}"
    return n, "psm", a, b - a, f"{before}{prefix}{after}{suffix}{between}{middle}"


def fill_in_middle(
    docs: DataFrame, seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: id, n (units), form (plain, psm or spm), prefix_chars and middle_chars (null if plain) and output."""
    if len(set(sentinels)) < 3 or not all(len(s) > 1 and s[0] not in s[1:] and not set(s) & set(_SPACE) for s in sentinels) or len({s[0] for s in sentinels}) > 1:
        raise ValueError("sentinels are three different texts without white space that share a first character, which they don't hold again")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for batch in batches:
            ids, texts, at, rows, size = batch.column(0), batch.column(1), 0, [], 0
            for i in range(len(batch)):
                key, text = ids[i].as_py(), texts[i].as_py() or ""
                rows.append(rearranged(text, "" if key is None else str(key), seed, fim_percent, spm_percent, sentinels))
                size += len(text)
                if size > _FLUSH or i + 1 == len(batch):
                    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                    yield pa.RecordBatch.from_arrays([ids.slice(at, i + 1 - at), *columns], names)
                    at, rows, size = i + 1, [], 0

    return docs.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that ``fill_in_middle`` took, from its output and form.

    Sentinels share a first character that they hold once, so none can begin in
    a part of the text and end in a sentinel.
    """
    before, after, between = sentinels
    end = F.char_length(output) + 1

    def part(first: str, then: str | None) -> Column:
        start = F.instr(output, first) + len(first)
        stop = F.instr(output, then) if then else end
        return F.substring(output, start, stop - start)

    psm = F.concat(part(before, after), part(between, None), part(after, between))
    spm = F.concat(part(before, between), part(between, None), part(after, before))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
