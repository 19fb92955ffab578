"""Sampling of segmentations against full enumeration, and the pipeline end to end."""

import collections
import itertools

import numpy as np
import pytest
from hyperplane.llm import piece_lattice as P
from hyperplane.llm import registry

MODEL = f"{registry.TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def voc():
    return P.vocabulary(MODEL)


def all_segmentations(voc, unit):
    lattice = P.Lattice(voc, [unit])

    def go(i):
        if i == len(unit):
            return [((), 0.0)]
        out = [((int(voc.byte_id[unit[i]]), *x), voc.byte_weight + w) for x, w in go(i + 1)] if lattice.lone[i] else []
        state = np.ones(1, np.int64)
        for j in range(i, len(unit)):
            state = voc.step(state, voc.cls[[unit[j]]])
            if not state[0]:
                break
            if np.isfinite(voc.weight[state[0]]):
                out += [((int(voc.id[state[0]]), *x), voc.weight[state[0]] + w) for x, w in go(j + 1)]
        return out

    found = go(0)
    total = np.logaddexp.reduce([w for _, w in found])
    return {x: w - total for x, w in found}


def test_samples_without_replacement(voc):
    text = "the cat☃s".encode()
    units = [all_segmentations(voc, u) for u in P.units_of(text)]
    p = {sum(c, ()): sum(u[x] for u, x in zip(units, c)) for c in itertools.product(*units)}
    n = 3000
    found = P.sample(voc, [text] * n, np.arange(n), 3)
    first = collections.Counter()
    pairs = collections.Counter()
    for r in found:
        ids = [tuple(x[0].tolist()) for x in r]
        assert len(set(ids)) == 3 and r[0][2] > r[1][2] > r[2][2]
        assert all(abs(p[i] - x[1]) < 1e-9 for i, x in zip(ids, r))
        first[ids[0]] += 1
        pairs[ids[0], ids[1]] += 1
    top = sorted(p, key=p.get)[-3:]
    for a in top:
        assert abs(first[a] / n - np.exp(p[a])) < 0.04
    for a, b in itertools.permutations(top, 2):
        assert abs(pairs[a, b] / n - np.exp(p[a] + p[b]) / (1 - np.exp(p[a]))) < 0.04
    # Inclusion scores make weighted sums unbiased.
    assert abs(np.mean([sum(np.exp(x[1]) / x[3] for x in r) for r in found]) - 1) < 0.03


def test_gives_all_when_few(voc):
    text = "aé".encode()
    every = all_segmentations(voc, P.units_of(text)[0])
    (found,) = P.sample(voc, [text], np.array([1]), len(every) + 5)
    ids = {tuple(x[0].tolist()) for x in found}
    assert len(ids) == len(found) and ids >= {k for k, p in every.items() if p > np.log(1e-11)} and all(x[3] == 1 for x in found)
    (none,) = P.sample(voc, [b""], np.array([1]), 3)
    assert len(none) == 1 and not len(none[0][0])


def test_round_trip(docs, rows, empty, spark):
    out = P.decode_ids(P.encode_topk(docs, MODEL, 2), MODEL).collect()
    want = collections.Counter((i, (t or "").replace("▁", " ")) for i, t in rows)
    assert collections.Counter((r.doc_id, r.decoded) for r in out if r["sample"] == 1) == want
    assert all((r.doc_id, r.decoded) in want for r in out)
    again = P.decode_ids(P.encode_topk(docs.repartition(7), MODEL, 2), MODEL).collect()
    key = lambda r: (r.doc_id, r["sample"], r.ids_crc32, r.n_ids)
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert P.encode_topk(empty, MODEL).count() == 0
    import zlib

    checked = {(r.doc_id, r["sample"], r.n_ids, r.ids_crc32, r.text_crc32) for r in P.encode_topk(docs, MODEL, 2, checked=True).collect()}
    assert checked == {(r.doc_id, r["sample"], r.n_ids, r.ids_crc32, zlib.crc32(r.decoded.encode())) for r in out}


def test_results_hold_the_ids(spark, voc):
    """The query and the pipeline's last stage give the ids themselves, which spell the text."""
    import zlib

    from hyperplane.llm import registry

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    at = "/root/testdata/sf0.001"
    docs = registry.table(spark, at, "documents").limit(20)
    texts = {r.doc_id: (r.text or "").replace("▁", " ").encode() for r in docs.collect()}
    for out in (registry.op3_sentencepiece(spark, at), corpus_pipeline.tokens(spark, docs, at)):
        some = [r for r in out.collect() if r.doc_id in texts]
        assert {r.doc_id for r in some} == set(texts)
        for r in some:
            ids = np.frombuffer(r.ids, "<i4")
            assert len(ids) == r.n_ids and zlib.crc32(ids.tobytes()) == r.ids_crc32
            assert voc.decode(ids) == texts[r.doc_id] and zlib.crc32(texts[r.doc_id]) == r.text_crc32


def test_pipeline(spark, tmp_path):
    import random

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(9)
    clean = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))
    junk = lambda n: " ".join(w + rng.choice(["!!", "$$$"]) for w in clean(n).split())
    texts = [clean(80) for _ in range(150)] + [junk(80) for _ in range(60)]
    near = texts[4].split()
    near[10] = "changed"
    passage, bench = clean(60), clean(30)
    texts += [texts[3], " ".join(near), clean(40) + " " + passage, passage + " " + clean(40), clean(60) + " " + bench]
    names = dict(zip(("copy", "near", "first", "second", "dirty"), range(len(texts) - 5, len(texts))))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 150)) for i in range(210)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(0, bench)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    seen, at = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, at, str(tmp_path)).cache()
        if name != "tokens":
            assert out.columns == docs.columns
        seen[name] = {r.doc_id: r for r in out.collect()}
        at = out
    assert not set(range(150, 210)) & set(seen["quality"]) and len(set(range(150)) & set(seen["quality"])) >= 148
    kept = set(seen["near copies"])
    assert names["copy"] not in kept and names["near"] not in kept and {3, 4} <= kept
    assert passage not in seen["repeats"][names["second"]].text and passage in seen["repeats"][names["first"]].text
    assert names["dirty"] not in seen["contamination"] and set(seen["contamination"]) == set(seen["repeats"]) - {names["dirty"]}
    assert set(seen["tokens"]) == set(seen["contamination"])
    assert {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id").distinct().collect()} == set(seen["tokens"])


ODD = "text string, doc_id long, lang string, source string, n_chars long, node long, stats string, score double, ranges string, part int, label int, component_id long"


def _odd_rows():
    """Null ids and texts, empty and blank texts, repeated rows, one id with two texts, a long text, and columns with the operators' own names."""
    import random

    rng = random.Random(2)
    clean = lambda n: " ".join("".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(n))
    same = clean(60)
    rows = [(1, None), (2, ""), (3, " \n "), (None, None), (None, ""), (None, same), (None, same), (5, same), (5, same), (6, clean(30)), (6, clean(30)), (7, clean(30_000)), (8, "x"), (9, "x")]
    return [(t, i, None, "s", 0, 7, "stats", 0.1, "r", 3, 1, 4) for i, t in rows], same


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_stages_on_odd_rows(spark, tmp_path, monkeypatch, broadcast):
    """Every stage keeps columns and order of columns, and does as its docstring says with odd rows and with empty tables."""
    from hyperplane.llm import partenum, shared, suffix_dedup

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for module in (shared, partenum, suffix_dedup):
        monkeypatch.setattr(module, "BROADCAST_ROWS", broadcast)
    rows, same = _odd_rows()
    docs = spark.createDataFrame(rows, ODD).repartition(3)
    spark.createDataFrame([(5, None), (6, None), (None, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(None, 1, 1), (same[:200], 2, 2)], "text string, item_id long, doc_id long").write.parquet(f"{tmp_path}/benchmark.parquet")
    out, at = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, str(tmp_path))
        if name != "tokens":
            assert found.schema == docs.schema
        out[name] = [(r.doc_id, r["text"] if name != "tokens" else r["sample"]) for r in found.collect()]
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    given = [(r[1], r[0]) for r in rows]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, str(r[1])[:99])
    # Without labels nobody is rejected.
    assert sorted(out["quality"], key=key) == sorted(given, key=key)
    # The short text "x" is a copy of that of id 8; rows without an id stay.
    assert sorted(out["near copies"], key=key) == sorted((r for r in given if r[0] != 9), key=key)
    # Equal rows of one id don't remove from each other, and no id is smaller than 5 that holds their text.
    assert sorted(out["repeats"], key=key) == sorted(given, key=key)
    assert sorted(out["contamination"], key=key) == sorted((r for r in given if r[0] != 5), key=key)
    assert {i for i, _ in out["tokens"]} == {i for i, _ in given} and out["tokens"].count((2, 1)) == 1 and (2, 2) not in out["tokens"]
