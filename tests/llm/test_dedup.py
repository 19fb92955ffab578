"""Jaccard join, suffix-array dedup and components against brute force."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hyperplane.llm import partenum, suffix_dedup
from hyperplane.llm.components import components

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = (text or "").encode().translate(LOWER).split()
    return frozenset(tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            s, t = sets[a][1], sets[b][1]
            both = len(s & t)
            if s and t and 100 * both >= 80 * (len(s) + len(t) - both):
                root[find(a)] = find(b)
    least = {}
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(least.get(find(x), i), i)
    return sorted((i, len(s), least[find(x)]) for x, (i, s) in enumerate(sets))


def test_jaccard_components(docs, rows):
    got = sorted(tuple(r) for r in partenum.jaccard_components(docs).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute_components(rows)


@pytest.mark.parametrize(("common", "large", "broadcast", "settle"), [(512, 16, 500_000, 1 << 20), (2, 16384, 0, 1 << 20), (3, 8, 0, 4), (512, 16384, 500_000, 2)])
def test_jaccard_large_groups(spark, monkeypatch, common, large, broadcast, settle):
    """Many distinct near copies of one text, and many texts that share half of theirs: groups dealt in blocks or cut again, and signatures that are common in a batch or grow common in a bucket."""
    monkeypatch.setattr(partenum, "SETTLE", settle)
    monkeypatch.setattr(partenum, "GROWN", 3)
    monkeypatch.setattr(partenum, "BLOCK", 16)
    monkeypatch.setattr(partenum, "COMMON", common)
    monkeypatch.setattr(partenum, "LARGE", large)
    monkeypatch.setattr(partenum, "BROADCAST_ROWS", broadcast)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(60):
        t = list(base)
        t[k], t[119 - k] = f"e{k}", f"f{k}"
        rows.append((k, " ".join(t)))
    for k in range(60, 110):
        rows.append((k, " ".join([f"c{i}" for i in range(60)] + [f"d{k}x{i}" for i in range(60)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r) for r in partenum.jaccard_components(docs).collect())
    assert got == brute_components(rows)


def test_a_bucket_hands_on_common_signatures(monkeypatch):
    """100,000 sets with one signature that no batch finds common: they leave as they come, and the bucket's own groups stay as they are."""
    monkeypatch.setattr(partenum, "SETTLE", 1000)
    monkeypatch.setattr(partenum, "GROWN", 200)

    def batches():
        for step in range(2000):
            sig = np.array([5] * 50 + [100 + step] * 2, np.uint32)
            node = np.array([*range(step * 50, step * 50 + 50), 10**6 + step, 10**6 + step + 1], np.uint64)
            data = partenum._packed(sig, node)
            yield pa.RecordBatch.from_arrays([pa.array([3], pa.int32()), pa.array([0], pa.int32()), pa.array([data], pa.binary())], ["bucket", "kind", "data"])

    largest, members, pairs = 0, set(), set()
    for batch in partenum._grouped(batches()):
        largest = max(largest, batch.num_rows)
        for kind, a, b in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2)), strict=True):
            assert kind in (2, 4)
            (members if kind == 4 else pairs).add((a, b))
    assert len({a for a, _ in members}) == 1 and {b for _, b in members} == set(range(100_000))
    assert pairs == {(10**6 + k, 10**6 + k + 1) for k in range(2000)} and largest < 10_000


def test_jaccard_without_ids(spark):
    """Rows without an id link like others; a component takes the smallest id it has."""
    base = [f"b{i}" for i in range(40)]
    near = [*base[:39], "z"]
    rows = [(None, " ".join(base)), (None, " ".join(base)), (9, " ".join(near)), (None, "alone here"), (4, "q w e r t y"), (4, "other text"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id is not None, r.doc_id, r.n_shingles, r.component_id) for r in partenum.jaccard_components(docs).collect())
    assert got == [(False, None, 0, None), (False, None, 1, None), (False, None, 36, 9), (False, None, 36, 9), (True, 4, 1, 4), (True, 4, 2, 4), (True, 9, 36, 9)]


@pytest.mark.parametrize("turn", [0, 1])
def test_signatures_never_miss(turn):
    """Any two sets at the threshold share a signature."""
    rng = np.random.default_rng(5)
    for n in [1, 2, 3, 4, 5, 6, 8, 11, 19, 27, 37, 52, 80, 163, 229, 400, 1500, 9000]:
        for _ in range(60 if n < 100 else 10):
            a = rng.integers(0, 1 << 63, n).astype(np.uint64)
            m = rng.integers(0, n // 4 + 1)
            add = rng.integers(0, n // 4 + 1)
            b = np.concatenate((a[m:], rng.integers(0, 1 << 63, add).astype(np.uint64)))
            both = n - m
            if not len(b) or 100 * both < 80 * (n + len(b) - both) or (m == 0 and add == 0):
                continue
            grams = np.concatenate((np.sort(a), np.sort(b)))
            sig, of = partenum.signatures(grams, np.array([0, n, n + len(b)]), turn=turn)
            assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist()), (n, m, add)


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(1)
    a, extra = rng.integers(0, 1 << 63, 300).astype(np.uint64), rng.integers(0, 1 << 63, 40).astype(np.uint64)
    s = partenum._folded(partenum.sketches(np.concatenate((a, a[20:], extra, a[:250])), np.array([0, 300, 620, 870])))
    assert s.shape == (3, 8)
    assert np.bitwise_count(s[0] ^ s[1]).sum() <= 60
    assert np.bitwise_count(s[0] ^ s[2]).sum() <= 50
    assert np.bitwise_count(s[1] ^ s[2]).sum() > 60


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(50, 51), (51, 52), (7, 7)]])
def test_components(spark, links):
    root = {x: x for p in links for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if any(x in p and p[0] != p[1] for p in links)}


def brute_removal(rows):
    out, first = [], {}
    for i, t in rows:
        b = (t or "").encode()
        for j in range(len(b) - 49):
            first[b[j : j + 50]] = min(first.get(b[j : j + 50], i), i)
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for j in range(len(b) - 49):
            if first[b[j : j + 50]] < i:
                gone[j : j + 50] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


def test_suffix_dedup(docs, rows):
    got = sorted(tuple(r) for r in suffix_dedup.suffix_dedup(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())
    assert got == brute_removal(rows)


def test_suffix_dedup_splits_common_anchors(docs, rows, monkeypatch):
    """With anchors split from two rows on, windows are merged across shards, with the same result."""
    monkeypatch.setattr(suffix_dedup, "ANCHOR_ROWS", 2)
    got = sorted(tuple(r) for r in suffix_dedup.suffix_dedup(docs).collect())
    assert got == brute_removal(rows)


def test_anchors_follow_the_window_alone():
    """Equal windows choose the same gram in pieces of any length, at any place."""
    rng = np.random.default_rng(7)
    passage = rng.integers(97, 99, 400).astype(np.uint8)
    found = []
    for before, after in ((0, 0), (13, 70_000), (300_000, 5)):
        text = np.concatenate((rng.integers(97, 99, before), passage, rng.integers(97, 99, after))).astype(np.uint8)
        start, at = suffix_dedup.anchors(text, np.array([0, len(text)]))
        mine = (start >= before) & (start <= before + 350)
        found.append((at - start)[mine].tolist())
    assert len(found[0]) == 351 and found[0] == found[1] == found[2]


def test_merged_runs():
    rng = np.random.default_rng(3)
    runs = []
    for n in (7, 1, 30, 12):
        run = np.zeros(n, suffix_dedup._FIRST)
        run["window"] = np.sort(np.array([bytes(rng.integers(0, 2, 50, np.uint8)[:3]) + b"x" * 46 + bytes([rng.integers(0, 2)]) for _ in range(n)], "S50"))
        run["doc"] = rng.integers(0, 9, n)
        runs.append(run)
    merged = suffix_dedup.merged_runs(list(runs))
    assert merged["window"].tolist() == sorted(x for r in runs for x in r["window"].tolist())
    assert sorted(merged.tolist()) == sorted(x for r in runs for x in r.tolist())


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    text = rng.integers(97, 99, 300).astype(np.uint8)
    stop = np.array([40, 90, 91, 200, 300])
    start = np.concatenate(([0], stop[:-1]))
    end = np.repeat(stop, stop - start)
    sa, rank = suffix_dedup.suffix_array(text, end)
    suffix = lambda i: text[i : end[i]].tobytes()
    assert sa.tolist() == sorted(range(300), key=lambda i: (suffix(i), i))
    lcp = suffix_dedup.common_prefixes(text, start, stop, sa, rank, end)
    for k in range(1, 300):
        a, b = suffix(sa[k - 1]), suffix(sa[k])
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert lcp[k] == n


def test_drop_repeats(docs, rows):
    got = {(r.doc_id, r.text) for r in suffix_dedup.drop_repeats(docs).collect()}
    kept = {(i, n, gone) for i, n, gone, _, _ in brute_removal(rows)}
    assert {i for i, _ in got} == {i for i, n, gone in kept if gone < n or n == 0}


def test_empty(empty, spark):
    assert partenum.jaccard_components(empty).count() == 0
    assert suffix_dedup.suffix_dedup(empty).count() == 0
    nothing = spark.createDataFrame([(None, "a b c"), (1, None), (None, None)], "doc_id long, text string")
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in partenum.jaccard_components(nothing).collect()), key=str) == [(1, 0, 1), (None, 0, None), (None, 1, None)]
    assert suffix_dedup.suffix_dedup(nothing).count() == 3
