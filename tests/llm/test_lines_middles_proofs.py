"""Line deduplication, fill-in-middle and the Merkle manifest against brute force, on odd rows and on both sides of size switches."""

import collections
import hashlib
import re
import zlib

import pytest
from hyperplane.llm import line_dedup, merkle
from hyperplane.llm.line_dedup import drop_common_lines
from hyperplane.llm.middle_fill import events, fill_in_middle, restored, unit_ends
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\x0c\r"
ASCII_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# Lines.

COMMON = "All rights reserved, and so is this line of the footer."
LINE_ROWS = [(k, f"start {k}\n  {COMMON.upper() if k % 2 else COMMON}\t\nend {k}\n") for k in range(12)]
LINE_ROWS += [
    (20, "É" * 40 + "A"), (21, "É" * 40 + "a"), (22, "É" * 40 + "a"), (23, "É" * 40 + "a "), (24, "É" * 40 + "a "), (25, "É" * 40 + "A"), (26, "é" * 40 + "a"),
    (30, "y" * 39), (31, "y" * 39), (32, "y" * 39), (33, "y" * 39), (34, "y" * 39), (40, "z" * 40), (41, "z" * 40), (42, "z" * 40), (43, "z" * 40 + "\r"), (43, "z" * 40), (44, None), (45, ""),
    (-7, f"{COMMON}\n{COMMON}\n\n{COMMON}"), (5, LINE_ROWS[5][1]), (None, COMMON), (None, COMMON), (46, "\n" * 50 + COMMON + "\nx" * 30_000), (11, COMMON + "\nanother row of the largest but one"),
]


def brute_lines(rows):
    def keys(t):
        return [(x, x.strip(SPACE).translate(ASCII_LOWER)) for x in (t or "").split("\n")]

    held = collections.defaultdict(set)
    for i, t in rows:
        for _, k in keys(t):
            if i is not None and len(k) >= 40:
                held[k].add(i)
    common = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = []
    for i, t in rows:
        lines = keys(t)
        kept = [x for x, k in lines if i is None or i >= common.get(k, i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_common_lines_go(spark, monkeypatch, broadcast):
    """With keys broadcast, and with keys met by a shuffle in which the hot ones are dealt over several tasks."""
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(line_dedup, "HOT", 3)
    docs = spark.createDataFrame([(i, t, "x", 1, 2) for i, t in LINE_ROWS], "doc_id long, text string, lines string, id int, gone int").repartition(3)
    got = drop_common_lines(docs)
    assert sorted(map(tuple, got.collect()), key=repr) == brute_lines(LINE_ROWS)
    assert drop_common_lines(docs.limit(0)).count() == 0


def test_lines_stay_native(spark, docs, rows):
    got = drop_common_lines(docs, min_chars=12, min_docs=3)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert got.count() == len(rows)


def test_lines_above_the_threshold_of_a_split_key(spark):
    """A line of every document: counted and dropped over all tasks."""
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit(COMMON + "\n"), F.col("id").cast("string")).alias("text"))
    got = drop_common_lines(docs)
    assert got.agg(F.sum("n_dropped"), F.max("n_dropped")).first()[:] == (19_999, 1)
    assert got.where("n_dropped = 0").first()[:] == (19_999, 2, 0, COMMON + "\n19999")


# Middles.

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_middle(i, t):
    t = t or ""
    units = UNIT.findall(t)
    n = len(units)
    x = sha(f"42:{'' if i is None else i}")
    h1, h2, h3, h4 = (int(x[8 * k : 8 * k + 8], 16) for k in range(4))
    if not t or any(s in t for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return i, n, "plain", None, None, t
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return i, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return i, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_middles(spark, docs, rows):
    odd = [(1000 + k, t) for k, t in enumerate([" ", "\n\n", "a", " a", "a ", "<P", "a<S>b", "<<M> x y", "P> < P > <S", "日 本 語 x  ", "x\x0b\x0cy\r", "<" * 9, "\x1c\x1d a\x85b"] * 6)]
    odd += [(None, "one two three"), (None, None), (7, "rows of an id that another row has")]
    every = rows + odd
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string"))
    made = fill_in_middle(more.withColumns({"n": F.lit("x"), "form": F.lit(1), "output": F.lit(2)}))
    got = made.withColumn("restored", restored(F.col("output"), F.col("form"))).collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == sorted((brute_middle(i, t) for i, t in every), key=repr)
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}
    assert sorted(r["restored"] for r in got) == sorted(t or "" for _, t in every)
    assert fill_in_middle(docs.limit(0)).count() == 0


def test_units_are_counted_from_gaps():
    for t in ["", " ", "a", "  a", "a  ", " a b ", "\n\nab\tc  d\r\n", "a b"]:
        space, sentinel = events(t)
        ends = unit_ends(space, len(t)).tolist()
        assert not sentinel and [t[a:b] for a, b in zip([0, *ends], ends, strict=False)] == UNIT.findall(t)
    assert events("a <S> b")[1] and not events("a <S > b")[1]


def test_other_sentinels_restore(spark):
    rows = [(k, "<| a <|b |> c" * (k % 5)) for k in range(60)]
    marks = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    made = fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), seed=1, fim_percent=100, spm_percent=50, sentinels=marks)
    got = made.withColumn("restored", restored(F.col("output"), F.col("form"), marks)).collect()
    assert all(r["restored"] == rows[r["doc_id"]][1] for r in got) and {r["form"] for r in got} == {"plain", "psm", "spm"}
    with pytest.raises(ValueError):
        fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), sentinels=("<P>", "<P>", "<M>"))


# Proofs.


def brute_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha("".join(last[k : k + 2])) for k in range(0, len(last), 2)])
    return levels


def brute_path(levels, k):
    """(sibling or None, whether it is left) of each level."""
    out = []
    for level in levels[:-1]:
        j = k ^ 1
        out.append((level[j] if j < len(level) else None, j < k))
        k //= 2
    return out


@pytest.mark.parametrize("step", [1, 2, 3, 4, 7])
def test_traversal_gives_every_path(step):
    for n in [1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 31, 33, 100, 127, 128, 129]:
        leaves = [hashlib.sha256(bytes([k])).digest() for k in range(n)]
        levels = brute_levels([x.hex() for x in leaves])
        top = merkle.height(n)
        assert merkle.tree_root(leaves.__getitem__, n, top).hex() == levels[-1][0]
        for k, path in enumerate(merkle.traversal(leaves.__getitem__, n, top, step)):
            want = brute_path(levels, k)
            assert [x and x.hex() for x in path] == [x for x, _ in want]
            proof, sides = merkle.packed(path, k)
            assert merkle.folded(leaves[k], proof, sides).hex() == levels[-1][0]
            assert merkle.folded(leaves[k - 1], proof, sides).hex() != levels[-1][0] or n == 1


def test_traversal_holds_stacked_subtrees_only(monkeypatch):
    """Leaves are asked for in a window of each level's subtree, and kept nodes stay below two subtrees a level."""
    n, levels, step = 1 << 12, 12, 4
    alive, most = {}, 0
    plain = merkle.subtree

    def counted(leaf, n, start, top, low, keep):
        alive.setdefault(top, []).append(keep)
        return plain(leaf, n, start, top, low, keep)

    monkeypatch.setattr(merkle, "subtree", counted)
    for k, _ in enumerate(merkle.traversal(lambda i: i.to_bytes(32, "big"), n, levels, step)):
        if k % 97 == 0:
            most = max(most, sum(len(x) for kept in alive.values() for x in kept[-2:]))
    assert most <= 2 * 3 * (2 << step)


PROOF_ROWS = [(k, f"text {k} é" * (k % 3), ["en", "fr", None, "aü", "z"][0 if k % 3 else k % 5], "src" if k % 4 else None, k if k % 6 else None, "x", 1) for k in range(-4, 90)]
PROOF_ROWS += [(3, "text 3 é", "en", "other", 9, "x", 1), (None, None, None, None, None, "x", 1), (None, "", "solo", "", 0, "x", 1), (7, "again", "en", "s", 1, "x", 1), (7, "again", "en", "s", 1, "x", 1)]


def brute_proofs(rows):
    def leaf(i, t, lang, source, n_chars):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, source, lang, n_chars, t)))

    groups = collections.defaultdict(list)
    for i, t, lang, source, n_chars, *_ in rows:
        tampered = i is not None and zlib.crc32(str(i).encode()) % 7 == 0 and n_chars is not None
        groups[lang].append((i, leaf(i, t, lang, source, n_chars), leaf(i, t, lang, source, n_chars + tampered if n_chars is not None else None)))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = brute_levels([x[1] for x in groups[lang]])
    crown = brute_levels([trees[x][-1][0] for x in langs])
    out = []
    for at, lang in enumerate(langs):
        for k, (i, original, shown) in enumerate(groups[lang]):
            path = brute_path(trees[lang], k) + brute_path(crown, at)
            for sibling, left in path:
                shown = sha((sibling or "") + shown if left else shown + (sibling or ""))
            out.append((i, original, trees[lang][-1][0], crown[-1][0], sha("".join(x for x, _ in path if x)), shown, shown == crown[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block", [1, 3, 12])
@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_manifest(spark, monkeypatch, block, broadcast):
    """With trees of one and of several rounds of blocks."""
    if broadcast == 0 and block != 3:
        pytest.skip("one size of blocks is enough")
    monkeypatch.setattr(merkle, "BROADCAST_ROWS", broadcast)
    docs = spark.createDataFrame(PROOF_ROWS, "doc_id long, text string, lang string, source string, n_chars long, g string, at long").repartition(5)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    got = merkle.manifest(docs, presented={"n_chars": F.col("n_chars") + 1}, where=tampered, block=block)
    rows = got.collect()
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted((tuple(r[c] for c in names) for r in rows), key=repr) == brute_proofs(PROOF_ROWS)
    assert {r["verified"] for r in rows} == {True, False}
    assert all(merkle.folded(bytes.fromhex(r["leaf"]), bytes(r["proof"]), r["sides"]).hex() == r["root"] for r in rows)


def test_manifest_of_odd_tables(spark, docs, rows):
    assert merkle.manifest(docs.limit(0)).count() == 0
    one = merkle.manifest(docs.where("doc_id = 20")).collect()
    assert len(one) == 1 and one[0]["leaf"] == one[0]["subroot"] == one[0]["root"] and one[0]["verified"] and one[0]["proof"] == b""
    whole = merkle.manifest(docs, block=4)
    assert whole.where("verified").count() == len(rows) and whole.select("root").distinct().count() == 1
