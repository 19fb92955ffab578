"""An anchor that comes very often in a few documents: a shard's memory, and windows judged in several turns."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from hyperplane.llm import suffix_dedup
from hyperplane.llm.suffix_dedup import K


def _segments(rows, anchor=7):
    """Segments (document, start, bytes) of one anchor as a shard gets them."""
    head = np.zeros(len(rows), suffix_dedup._SEGMENT)
    head["anchor"], head["doc"], head["start"] = anchor, [r[0] for r in rows], [r[1] for r in rows]
    head["size"] = [len(r[2]) for r in rows]
    data = np.array([len(rows)], "<u4").tobytes() + head.tobytes() + b"".join(r[2] for r in rows)
    return suffix_dedup._rows([(0, data)])


def _removed(batches, groups):
    """(document, byte) of all removed ranges, and how many windows were merged."""
    left, runs = set(), []
    for batch in batches:
        for kind, data in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if kind:
                runs.append(data)
            else:
                left |= {(d, i) for d, a, b in np.frombuffer(data, np.int64).reshape(-1, 3).tolist() for i in range(a, b)}
    n = sum(len(x) // suffix_dedup._FIRST.itemsize for x in runs)
    if runs:
        merged = suffix_dedup._merged(groups)(iter([suffix_dedup._rows([(0, x) for x in runs], 1)]))
        left |= _removed(merged, groups)[0]
    return left, n


@pytest.mark.parametrize(("judged", "windows", "anchor"), [(1 << 20, 1 << 18, 7), (1 << 20, 5, 7), (300, 1 << 18, 7), (300, 5, 7), (1, 1, 7), (300, 5, 7 | 1 << 58)])
def test_turns_remove_what_one_turn_removes(monkeypatch, judged, windows, anchor):
    """Many segments, equal and overlapping ones, within and across documents; every split into turns gives the brute-force removal."""
    monkeypatch.setattr(suffix_dedup, "JUDGED", judged, raising=False)
    monkeypatch.setattr(suffix_dedup, "WINDOWS", windows, raising=False)
    rng = random.Random(3)
    base = bytes(rng.choice(b"abc ") for _ in range(160))
    rows = []
    for doc in rng.sample(range(-20, 20), 25):
        for k in range(rng.randrange(1, 9)):
            a = rng.randrange(0, 90)
            text = base[a : a + rng.randrange(K, 71)] if rng.random() < 0.7 else b"ab " * 20
            if rng.random() < 0.3:
                text = text[:-3] + bytes(rng.choice(b"xyz") for _ in range(3))
            rows.append((doc, 200 * k, text))
    least = {}
    for doc, _, text in rows:
        for i in range(len(text) - K + 1):
            least[text[i : i + K]] = min(least.get(text[i : i + K], doc), doc)
    want = {(doc, start + i + j) for doc, start, text in rows for i in range(len(text) - K + 1) if least[text[i : i + K]] < doc for j in range(K)}
    got, merged = _removed(suffix_dedup._judged(9, 5)(iter([_segments(rows, anchor)])), 9)
    assert got == want
    assert bool(merged) == (judged < 1 << 20 or anchor > 7)


def test_memory_of_a_frequent_anchor():
    """200 documents of a word pair each repeated 600 times: 120,000 segments of 70 bytes, 11 MB; judging them at once took 307 MB."""
    text = (b"again and " * 8)[:70]
    rows = [(doc, 80 * k, text) for doc in range(200) for k in range(600)]
    batch = _segments(rows)
    tracemalloc.start()
    n = 0
    for out in suffix_dedup._judged(9, 5)(iter([batch])):
        n += sum(len(x) for x in out.column(2).to_pylist()) // 24
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 199 * 600
    assert peak < 8 * batch.nbytes
