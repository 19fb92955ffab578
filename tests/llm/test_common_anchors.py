"""Anchors that a large share of all documents has: who is told by the batch, who by the bucket, and how much a bucket holds."""

import random

import numpy as np
import pyarrow as pa
import pytest

from hyperplane.llm import suffix_dedup

from test_dedup import brute_removal


@pytest.mark.parametrize(("common", "settle", "anchor_rows"), [(2, 8, 2), (5, 16, 3), (256, 32, 4), (3, 1 << 22, 4096)])
def test_removal_with_common_anchors(docs, rows, monkeypatch, common, settle, anchor_rows):
    """Batches that tell documents themselves, buckets that hand on early, and both at once give the same removal."""
    monkeypatch.setattr(suffix_dedup, "COMMON", common)
    monkeypatch.setattr(suffix_dedup, "SETTLE", settle)
    monkeypatch.setattr(suffix_dedup, "ANCHOR_ROWS", anchor_rows)
    got = sorted(tuple(r) for r in suffix_dedup.suffix_dedup(docs).collect())
    assert got == brute_removal(rows)


def test_one_passage_in_all_documents(spark, monkeypatch):
    """A passage of 200 bytes in each of 3,000 documents, in small batches: split many times, and removed from all but the first."""
    monkeypatch.setattr(suffix_dedup, "COMMON", 16)
    monkeypatch.setattr(suffix_dedup, "ANCHOR_ROWS", 64)
    monkeypatch.setattr(suffix_dedup, "SETTLE", 512)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(9))
    passage = " ".join(word() for _ in range(20))
    rows = [(i, f"{' '.join(word() for _ in range(4))} {passage} {' '.join(word() for _ in range(4))}") for i in range(3000)]
    got = sorted(tuple(r) for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect())
    assert got == brute_removal(rows)


def _batches(rows, size):
    for a in range(0, len(rows), size):
        some = rows[a : a + size]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in some], pa.int64()), pa.array([t for _, t in some])], ["doc_id", "text"])


def test_what_a_bucket_gets_is_bounded(monkeypatch):
    """200,000 documents with one passage: a bucket gets its anchors by name from each batch, not by document, and all documents are told."""
    monkeypatch.setattr(suffix_dedup, "GATHER", 4 << 20)
    rng = random.Random(5)
    passage = " ".join("".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(20))
    rows = [(i, f"{rng.getrandbits(256):064x} {passage}") for i in range(200_000)]
    entries, told, names, batches = {}, {}, set(), 0
    for batch in suffix_dedup._anchor_buckets(8, 33, 4_000_000)(_batches(rows, 10_000)):
        for part, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if kind == 2:
                table = np.frombuffer(data, np.uint64).reshape(-1, 2)
                assert (table[:, 0] % np.uint64(33) == part).all() and (table[:, 1] >> np.uint64(58) > 0).all()
                for h, n in zip(*np.unique(table[:, 1] & suffix_dedup._LOW57, return_counts=True), strict=True):
                    told[h] = told.get(h, 0) + n
            elif kind == 1:
                names |= set(np.frombuffer(data, np.uint64).reshape(-1, 2)[:, 0].tolist())
                batches += part == 0
            else:
                n_docs, n = np.frombuffer(data, "<u4", 2).tolist()
                low = np.frombuffer(data, "<u4", n, 8 + 10 * n_docs).astype(np.uint64) | (np.uint64(part) << np.uint64(40))
                for h, k in zip(*np.unique(low, return_counts=True), strict=True):
                    entries[h] = entries.get(h, 0) + k
    inner = [h for h, n in told.items() if n == 200_000]
    assert len(inner) >= 8 and set(map(int, told)) == names
    assert max(entries.values()) < suffix_dedup.COMMON * (batches + 1)


def test_a_bucket_holds_few_documents_of_a_hash(monkeypatch):
    """A hash that grows common without ever being so in a batch is handed on as it comes; those of one document stay and are dropped."""
    monkeypatch.setattr(suffix_dedup, "SETTLE", 1000)
    monkeypatch.setattr(suffix_dedup, "ANCHOR_ROWS", 100)
    bucket, out, most = suffix_dedup._Bucket(), [], 0
    for step in range(400):
        # One common hash, one of two documents, one that a document has a hundred times, one of a single document.
        h = np.array([7] * 10 + [1000 + step] * 2 + [8] * 100 + [5000 + step], np.uint64)
        d = np.concatenate((np.arange(step * 10, step * 10 + 10), [step, step + 1], [3] * 100, [step]))
        bucket.add(h, d)
        if bucket.size >= bucket.least:
            out.append(bucket.settled(False))
        most = max(most, bucket.size)
    out = np.concatenate([*out, bucket.settled(True)])
    name, split = out[:, 1] & suffix_dedup._LOW57, out[:, 1] >> np.uint64(58)
    assert sorted(out[name == 7, 0].tolist()) == list(range(4000)) and (split[name == 7] > 0).all() and split[name == 7].max() >= 5
    assert sorted(set(name[split == 0].tolist())) == list(range(1000, 1400)) and (name != 8).all()
    assert most < 4 * 1000 + 1200 * 3
