"""Decontamination, repetition coverage, token files, URL rules, quality and language model against brute force."""

import collections
import hashlib
import math
import zlib

import numpy as np
import pytest
from hyperplane.llm import decontaminate, interpolated_lm, registry, token_files
from hyperplane.llm.interpolated_lm import score_documents
from hyperplane.llm.repetition import repetition_coverage
from hyperplane.llm.rff_quality import filter_quality, isotonic, score_quality
from hyperplane.llm.url_rules import judge_urls

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
BPE = f"{registry.TOKENIZERS}/byte_bpe_50k.json"


def alnum(text):
    import re

    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(LOWER))


def brute_contamination(rows, items):
    windows = {}
    for item, t in items:
        w = alnum(t)
        for j in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[j : j + 13]), set()).add(item)
    out = []
    for i, t in rows:
        w, hit, found = alnum(t), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (ids := windows.get(tuple(w[j : j + n]))) is not None:
                    hit |= set(range(j, j + n))
                    found |= ids
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out.append((i, len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w)))
    return sorted(out)


@pytest.mark.parametrize("block", [1_000_000, 60])
def test_contamination(spark, docs, rows, monkeypatch, block):
    """Also with items in several blocks, whose hits are merged."""
    monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
    items = [(k, rows[k][1]) for k in (2, 10, 64, 80)] + [(90, "one"), (91, "W12x THE"), (92, None), (93, ""), (94, rows[70][1]), (None, "the of and")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(tuple(r)[:6] for r in decontaminate.contamination(docs, bench).collect())
    assert got == brute_contamination(rows, [x for x in items if x[0] is not None])
    if block > 1000:
        none = decontaminate.contamination(docs, bench.limit(0))
        assert none.where("contaminated or n_hit > 0").count() == 0 and none.count() == len(rows)


def brute_repetition(i, t):
    """All columns by plain loops over words and lines."""
    t = t or ""
    w = t.encode().split()
    size = [len(x.decode()) for x in w]
    chars = sum(size)

    def covered(n, first_too):
        grams, seen, out = collections.Counter(tuple(w[j : j + n]) for j in range(len(w) - n + 1)), set(), set()
        for j in range(len(w) - n + 1):
            g = tuple(w[j : j + n])
            if g in seen or first_too and grams[g] > 1:
                out |= set(range(j, j + n))
            seen.add(g)
        return out

    seen, dup, dup_chars, lines = set(), 0, 0, [x for x in t.split("\n") if x.encode().split()]
    for line in lines:
        dup += line in seen
        dup_chars += len(line) if line in seen else 0
        seen.add(line)
    repeat = len(covered(8, True))
    failed = len(w) < 20 or 100 * repeat > 30 * len(w)
    shares = [sum(size[x] for x in covered(n, False)) / max(chars, 1) for n in range(5, 11)]
    over = any(s > m for s, m in zip(shares, (0.15, 0.14, 0.13, 0.12, 0.11, 0.10), strict=True))
    over |= dup >= 2 and (dup > 0.3 * len(lines) or dup_chars > 0.2 * sum(map(len, lines)))
    return (i, len(w), chars, sum(map(t.count, "#*$%&|<>")), dup, repeat, failed, not failed and not over, len(lines), dup_chars), shares


def test_repetition(spark, docs, rows, empty):
    filler = lambda k, n: " ".join(f"f{k}w{j}" for j in range(n))
    more = [
        (2000, f"{filler(1, 80)} {filler(2, 15)} {filler(3, 60)} {filler(2, 15)}"),  # a passage twice, under all limits
        (2001, f"{filler(1, 80)} {filler(2, 22)} {filler(3, 26)} {filler(2, 22)}"),  # over the limits, but not the base rule's
        (2002, " ".join(f"{filler(2, 6)} x{j} {filler(j + 9, 9)}" for j in range(20))),  # only short n-grams repeat
        (2003, "\n".join(f"{filler(4, 4)}\n{filler(j + 9, 6)}" for j in range(9))),  # lines
        (None, filler(1, 30)),
    ]
    whole = docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = sorted((tuple(r) for r in repetition_coverage(whole).collect()), key=lambda r: (r[0] is not None, r[:10]))
    want = sorted((brute_repetition(i, t) for i, t in rows + more), key=lambda r: (r[0][0] is not None, r[0]))
    for g, (w, shares) in zip(got, want, strict=True):
        assert g[:10] == w
        assert np.allclose(g[11], shares) and math.isclose(g[10], max(shares))
    verdict = {r[0]: r[6:8] for r in got}
    assert [verdict[k] for k in (2000, 2001, 2002, 2003, None)] == [(False, True), (False, False), (False, False), (False, False), (False, True)]
    assert repetition_coverage(empty).count() == 0


def test_pack_round_trip():
    rng = np.random.default_rng(0)
    for bits in (1, 3, 7, 8, 13, 16, 17, 24, 31, 32):
        for n in (0, 1, 5, 1000):
            ids = rng.integers(0, 1 << bits, n).astype(np.uint32)
            assert (token_files.unpack(token_files.pack(ids, bits), bits, n) == ids).all()
    ids = rng.integers(0, 1 << 15, 10_000).astype(np.uint32)
    f = token_files.TokenFile(token_files.encode_file(np.array([4, 9, 11]), np.array([6000, 0, 4000]), ids, 15))
    assert (f.ids(4000, 4200) == ids[4000:4200]).all() and (f.document(2) == ids[6000:]).all() and not len(f.document(1)) and f.doc_ids.tolist() == [4, 9, 11]


@pytest.mark.parametrize(("per_file", "group"), [(4_000_000, 200_000), (50, 300)])
def test_token_files(spark, docs, rows, empty, monkeypatch, per_file, group):
    """The library's own ids, special strings in the text included; files and groups that end between documents."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "FILE_IDS", per_file)
    monkeypatch.setattr(token_files, "GROUP", group)
    t = Tokenizer.from_file(BPE)
    special = [(1000, "hi <|endoftext|> there"), (1001, "<|endoftext|>"), (1002, "a <|endoftext|"), (None, "no id")]
    whole = docs.select("doc_id", "text").unionByName(spark.createDataFrame(special, "doc_id long, text string"))
    at, want = 0, []
    for i, text in sorted(rows + special, key=lambda r: (r[0] is not None, r[0])):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = sorted((tuple(r) for r in token_files.read_tokens(token_files.write_tokens(whole, BPE)).collect()), key=lambda r: r[1])
    assert got == want
    assert token_files.read_tokens(token_files.write_tokens(empty, BPE)).count() == 0


def _random_texts():
    import random

    rng = random.Random(1)
    parts = [" ", "  ", "\n", "\t", " \n", " ", " ", "a", "b's", "é", "12", "!!", "<|endoftext|>", "don't", "x.y", "日本", 'ab,."', "_", "²", "́", "q...", "'", "s", "ª"]
    return ["".join(rng.choices(parts, k=rng.randrange(10))) for _ in range(4000)]


def test_encoder_matches_library():
    from tokenizers import Tokenizer

    t, texts = Tokenizer.from_file(BPE), _random_texts()
    for x, ids in zip(texts, token_files.ByteBpe(BPE).many(texts), strict=True):
        assert ids.tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_encoder_forgets(monkeypatch):
    """With room for few words and pieces, those met lately stay, and the ids are the same."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(token_files, "MEMORY", 60)
    monkeypatch.setattr(token_files, "PIECES", 20)
    t, texts = Tokenizer.from_file(BPE), _random_texts()
    encoder = token_files.ByteBpe(BPE)
    for at in range(0, len(texts), 40):
        some = texts[at : at + 40]
        for x, ids in zip(some, encoder.many(some), strict=True):
            assert ids.tolist() == t.encode(x, add_special_tokens=False).ids, x
    assert len(encoder.hash) < 500 and (np.diff(encoder.hash.astype(object)) > 0).all()


def test_other_patterns_go_through_the_library(tmp_path):
    import json

    from tokenizers import Tokenizer

    spec = json.loads(Tokenizer.from_file(BPE).to_str())
    spec["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "other.json").write_text(json.dumps(spec))
    path = str(tmp_path / "other.json")
    t, texts = Tokenizer.from_file(path), _random_texts()[:300]
    encoder = token_files.ByteBpe(path)
    assert not encoder.by_words
    for x, ids in zip(texts, encoder.many(texts), strict=True):
        assert ids.tolist() == t.encode(x, add_special_tokens=False).ids, x


def test_url_rules(spark):
    urls = ["http://a.b.org/x", "https://Example.ORG/es/1", "http://example.org/en/12", "http://example.org/en/2", "http://x.com/fr/1", "http://com/de/", "http://x.com/frx", "nothing", None, "", "http://org", "http://notorg/", "ftp://user@x.org:80/es/?q=://y#z", "http://casino.net/a", "http://x.net/a?b=/fr/", "http://a.org/\n"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: tuple(r)[1:] for r in judge_urls(pages, registry.URL_RULES).collect()}
    for k, url in enumerate(urls):
        rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
        end = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host, path = rest[:end].lower(), rest[end:].partition("?")[0].partition("#")[0]
        fits = [(len(h + p), h + p, v) for v, h, p in registry.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, default=(0, None, "allow"))
        assert got[k] == (host, path, best[1], best[2]), url
    assert judge_urls(pages.limit(0), registry.URL_RULES).count() == 0
    assert judge_urls(pages, [], "block").where("rule is null and verdict = 'block'").count() == len(urls)


def test_url_rules_with_stars_and_odd_rows(spark):
    """Stars in hosts and paths, columns with the operator's own names, repeated rows, a null id, a long URL, and a rule for all hosts."""
    long = "http://ads.x.com/" + "a/" * 40_000 + "get.exe"
    rows = [(1, "http://ad12.x.com/p", "t"), (1, "http://ad12.x.com/p", "t"), (None, "http://y.com/get/file.exe?x", "t"), (3, long, "t"), (4, "http://y.com/get/", "t"), (5, None, "t"), (6, "http://bad.y.com/get/a.exe", "t")]
    pages = spark.createDataFrame([(*r, r[1], 7) for r in rows], "page_id long, url string, tokens string, host string, id int")
    rules = [("block", "ad*.com", ""), ("block", "com", "/get/*.exe"), ("allow", "bad.y.com", "/get/"), ("block", "*", "/*/get.exe")]
    got = sorted(((r.page_id is not None, r.page_id, r.rule, r.verdict) for r in judge_urls(pages, rules).collect()), key=str)
    assert got == sorted([(False, None, "com/get/*.exe", "block"), *[(True, 1, "ad*.com", "block")] * 2, (True, 3, "*/*/get.exe", "block"), (True, 4, None, "allow"), (True, 5, None, "allow"), (True, 6, "bad.y.com/get/", "allow")], key=str)


def test_url_rules_met_by_a_shuffle(spark, monkeypatch):
    from hyperplane.llm import url_rules

    pages = spark.createDataFrame([(1, "http://a.org/es/1"), (2, "http://b.com/fr/2")], "page_id long, url string")
    whole = judge_urls(pages, registry.URL_RULES).collect()
    monkeypatch.setattr(url_rules, "BROADCAST_ROWS", 0)
    assert sorted(judge_urls(pages, registry.URL_RULES).collect()) == sorted(whole)


@pytest.mark.parametrize("batch", [4 << 20, 20_000])
def test_language_model(docs, rows, empty, spark, monkeypatch, batch):
    """Counts and base score exactly; the score against a plain mixture whose weights come from unrounded probabilities, to 0.1 percent."""
    monkeypatch.setattr(interpolated_lm, "BATCH", batch)
    got = {}
    for r in score_documents(docs).collect():
        got.setdefault(r.doc_id, r)
    tokens = [(i, [*(t or "").encode().translate(LOWER).split(), None]) for i, t in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    train = [ws for i, ws in tokens if not held(i)]
    c = collections.Counter(w for ws in train for w in ws)
    pairs = collections.Counter(p for ws in train for p in zip(["start", *ws], ws, strict=False))
    n, v = sum(c.values()), len(c)
    context = lambda u, first: len(train) if first else c[u]

    def parts(ws, less):
        for k, w in enumerate(ws):
            u = ws[k - 1] if k else "start"
            m = context(u, not k) - less
            yield (m.bit_length() if m > 0 else 0, (pairs[u, w] - less) / m if m > 0 else 0.0, (c[w] - less) / (n - less))

    buckets = collections.defaultdict(list)
    for ws in train:
        for b, p2, p1 in parts(ws, 1):
            buckets[b].append((p2, p1, 1 / (v + 1)))
    weights = {}
    for b, p in buckets.items():
        p, w = np.array(p), np.ones(3) / 3
        for _ in range(3000):
            share = p * w
            share /= share.sum(1, keepdims=True)
            w = share.mean(0)
        weights[b] = np.maximum(w, 1e-6) / np.maximum(w, 1e-6).sum()
    if 0 in weights:
        weights[0] = np.array([0, *weights[0][1:]]) / weights[0][1:].sum()
    else:
        weights[0] = np.array([0, 0.5, 0.5])
    for b in range(1, 40):
        weights.setdefault(b, weights[b - 1])
    for i, ws in tokens:
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i), len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9)
        want = sum(math.log10(np.dot(weights[b], (p2, p1, 1 / (v + 1)))) for b, p2, p1 in parts(ws, 0))
        assert math.isclose(r.score, want, rel_tol=1e-3), i
    long_held = [r for r in got.values() if r.held_out and r.n_tokens > 30]
    assert sum(r.score for r in long_held) > sum(r.base_score for r in long_held)
    assert score_documents(empty).count() == 0
    alone = score_documents(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).first()
    assert alone.held_out and alone.train_tokens == 0 and alone.score == 0


def test_language_model_sums_to_one():
    """Mixture weights of a bucket sum to one, and a context never seen uses no bigrams."""
    from hyperplane.llm.interpolated_lm import P1_BINS, P2_BINS, learn_weights

    cells = np.array([(2 * P2_BINS + 5) * P1_BINS + 40, (2 * P2_BINS + 0) * P1_BINS + 30, 12])
    w = learn_weights(cells, np.array([10.0, 20.0, 3.0]), np.zeros(3), np.zeros(3), 100)
    assert np.allclose(w.sum(1), 1) and w[0, 0] == 0 and w[2, 0] > 0.1


def test_quality(spark, docs, empty):
    import random

    rng = random.Random(4)
    text = lambda good: " ".join(("".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) + ("" if good else rng.choice(["!!", "$$$", "###"]))) for _ in range(rng.randrange(20, 120)))
    rows = [(i, text(i % 3 > 0), int(i % 3 > 0)) for i in range(600)] + [(900, None, 1), (901, "", None)]
    d = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    got = {r.doc_id: r for r in score_quality(d, labels).collect()}
    assert len(got) == len(rows)
    for i, _, y in rows:
        assert 0 <= got[i].score <= 1 and got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and got[i].predicted == int(got[i].score >= 0.3)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out and i < 900]
    assert sum(p == y for p, y in held) >= 0.95 * len(held)
    kept = {r.doc_id for r in filter_quality(d, labels).collect()}
    assert kept == {i for i in got if got[i].predicted}
    assert score_quality(d, labels.limit(0)).where("score <> 0.5").count() == 0
    assert score_quality(empty, labels).count() == 0


def test_isotonic():
    w, h = np.array([1.0, 0, 2, 1, 1, 0]), np.array([1.0, 0, 0, 1, 1, 0])
    curve = isotonic(w, h)
    assert (np.diff(curve) >= -1e-12).all() and abs(curve[0] - 1 / 3) < 0.34 and curve[-1] == 1


def test_counts_beyond_32_bits():
    """Totals of a token above 2**32 stay whole, in both forms, and contexts above 2**22 have buckets of their own."""
    import types

    lm = interpolated_lm
    big, h = np.array([3 << 30], np.uint32), np.array([7], np.uint64)
    data = lm.pack(h, *lm._split(big), h, *lm._split(big))
    out = [x for x in lm._added(iter([lm._rows(1, b, [(0, data)]) for b in (0, 1)])) if x.column(0)[0].as_py() != 3]
    for x in out:
        got = lm.unpack(x.column(3)[0].as_buffer())
        assert int(lm._counts(*got[:3])[0]) == int(lm._counts(*got[3:])[0]) == 6 << 30
    at = lambda n: int(lm.estimates(types.SimpleNamespace(parts=[None] * 9 + list(lm._split(np.array([1]))), totals=np.array([n]), token=np.array([0]), context=np.array([0])), 1, n, False)[0][0])
    assert at(1 << 23) < at(1 << 30) < at(1 << 40) < lm.CONTEXT_BUCKETS


def test_contamination_with_clashing_columns(spark):
    """Benchmark and documents with columns of the operator's own names, repeated rows, and an item twice."""
    rows = [(1, "one two three"), (1, "one two three"), (2, None), (None, "one two three"), (3, "zero one two three four")]
    docs = spark.createDataFrame([(t, i, 5, "w", 1) for i, t in rows], "text string, doc_id long, item_id long, words string, n_words int")
    bench = spark.createDataFrame([("One, two", 4, 1, "x"), ("One, two", 4, 2, "y"), (None, 6, 3, "z")], "text string, item_id long, doc_id long, hit string")
    got = sorted((r.doc_id is not None, r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(docs, bench).collect())
    assert got == [(False, None, 3, 2, 1, True), (True, 1, 3, 2, 1, True), (True, 1, 3, 2, 1, True), (True, 2, 0, 0, 0, False), (True, 3, 5, 2, 1, True)]
    assert decontaminate.contamination(docs.limit(0), bench).count() == 0


def test_quality_on_odd_rows(spark):
    """Columns with the operator's own names, repeated rows, a label twice, null ids, a long text."""
    import random

    rng = random.Random(8)
    text = lambda i: " ".join("".join(rng.choices("abcd" if i % 2 else "#$%!", k=4)) for _ in range(30))
    rows = [(i, text(i)) for i in range(200)]
    rows += [rows[0], (None, text(1)), (900, None), (901, ""), (902, text(1) * 12_000)]
    docs = spark.createDataFrame([(t, i, 0.1, 1, "s", 3) for i, t in rows], "text string, doc_id long, score double, label int, stats string, quality int")
    labels = spark.createDataFrame([("n", i, i % 2) for i in range(200)] + [("n", 4, 0), ("n", None, 1), ("n", 5, None)], "text string, doc_id long, quality int")
    got = score_quality(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 0}) == 1
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and r.doc_id < 200)
    kept = filter_quality(docs, labels)
    assert kept.schema == docs.schema and sorted(r.doc_id for r in kept.collect() if r.doc_id is not None and r.doc_id < 200) == list(range(1, 200, 2))


def test_isotonic_against_least_squares():
    """The curve goes through the centres of the blocks that merging violators pair by pair leaves."""
    rng = np.random.default_rng(3)
    w = rng.integers(1, 9, 12).astype(float)
    h = np.round(w * np.clip(np.linspace(0, 1, 12) + rng.normal(0, 0.3, 12), 0, 1))
    curve = isotonic(w, h)
    assert (np.diff(curve) >= -1e-12).all()
    blocks = [[b, a] for a, b in zip(w, h)]
    merged = [(x[0], x[1], 1) for x in blocks]
    k = 0
    while k < len(merged) - 1:
        if merged[k][0] * merged[k + 1][1] >= merged[k + 1][0] * merged[k][1]:  # equal shares are one block too
            merged[k : k + 2] = [tuple(p + q for p, q in zip(merged[k], merged[k + 1]))]
            k = max(k - 1, 0)
        else:
            k += 1
    ends = np.cumsum([m[2] for m in merged])
    weight_at = [np.average(np.arange(e - m[2], e), weights=w[e - m[2] : e]) for m, e in zip(merged, ends)]
    assert np.allclose(curve, np.interp(np.arange(12), weight_at, [m[0] / m[1] for m in merged]))
