"""Quotation linking on threads written by hand."""

import random

import pytest
from hyperplane.llm.quotation import conversation_text, link_quotations

SCHEMA = "conv_id long, turn long, role string, text string, level int, root string"
THREAD = [
    (1, 0, "a", "First line here.\nSecond line."),
    (1, 1, "b", "A new topic\nwith two lines"),
    (1, 2, "a", "On Monday, b wrote:\n> A NEW  topic\n> with two lines\nI agree."),
    (1, 3, "c", "> First line here.\nNo.\n>> nothing known\nReally no."),
    (1, 4, "b", "> I agree.\n>> a new topic\n> > with two lines\nThanks"),
    (1, 5, "d", "> Thanks\nWelcome"),
    (1, 6, "d", "> not in any message\nlost"),
    (1, 7, "e", "On Monday I wrote: nothing"),
    (2, 0, "a", "> Thanks\nother conversation"),
    (2, 1, "a", None),
    (2, 2, "a", ""),
    (None, 1, "x", "> First line here."),
    (3, None, "x", "y"),
    (4, 0, "a", "same"), (4, 0, "a", "same"), (4, 1, "b", "> same\nyes"),
]


@pytest.fixture(scope="module")
def linked(spark):
    return link_quotations(spark.createDataFrame([(*r, 1, "x") for r in THREAD], SCHEMA)).cache()


def test_replies(linked):
    got = {(r.conv_id, r.turn): r for r in linked.collect()}
    assert {k[1]: r.reply_to for k, r in got.items() if k[0] == 1} == {0: None, 1: None, 2: 1, 3: 0, 4: 2, 5: 4, 6: None, 7: None}
    assert {k[1]: r.root for k, r in got.items() if k[0] == 1} == {0: 0, 1: 1, 2: 1, 3: 0, 4: 1, 5: 1, 6: 6, 7: 7}
    order = sorted((r.position, k[1]) for k, r in got.items() if k[0] == 1)
    assert order == list(enumerate([0, 3, 1, 2, 4, 5, 6, 7]))
    assert got[1, 2].body == "I agree." and got[1, 3].body == "No.\nReally no." and got[1, 7].body == "On Monday I wrote: nothing"
    assert (got[1, 4].n_quoted, got[1, 4].deepest) == (3, 2) and got[2, 0].reply_to is None and got[2, 1].body == ""
    assert got[None, 1].position is None and got[None, 1].root is None and got[3, None].position is None
    assert linked.count() == len(THREAD) and sorted(r.position for r in linked.where("conv_id = 4").collect()) == [0, 1, 2] and got[4, 1].reply_to == 0


def test_long_chain_and_hot_line(spark):
    """Every message quotes the one before; a line that all hold goes to the first."""
    rows = [(7, 0, "a", "m0\nhello")] + [(7, i, "a", f"> m{i - 1}\n> m{i - 1}\n> hello\nm{i}\nhello") for i in range(1, 60)]
    got = {r.turn: r for r in link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(got[i].reply_to == i - 1 and got[i].root == 0 and got[i].position == i for i in range(1, 60))


def test_empty_and_format(spark, linked):
    assert link_quotations(spark.createDataFrame([], SCHEMA)).count() == 0
    first = conversation_text(linked.where("conv_id = 1 and position = 2")).first()
    assert first.formatted == "<|b|>\nA new topic\nwith two lines\n"


PLAIN = "conv_id long, turn long, role string, text string"


def test_passages_before_lines(spark):
    """Lines that many messages hold do not outvote the passage, and each holder of a line is a candidate."""
    rows = [
        (1, 0, "a", "Hi all\nThanks for the update\nAlpha"),
        (1, 1, "b", "Hi all\nThanks for the update\nBeta"),
        (1, 2, "c", "> Hi all\n> Thanks for the update\n> Beta\nyes"),
        (1, 3, "c", "> Hi all Thanks\n> for the update Alpha\nwrapped anew"),
        (1, 4, "c", "> Hi all\n> Thanks for the update\nno first line tells them apart"),
        (2, 0, "a", "same\ntext"), (2, 1, "b", "same\ntext"), (2, 2, "c", "> same\n> text\nof the latest"),
    ]
    got = {(r.conv_id, r.turn): r.reply_to for r in link_quotations(spark.createDataFrame(rows, PLAIN)).collect()}
    assert got[1, 2] == 1 and got[1, 3] == 0 and got[1, 4] == 1 and got[2, 2] == 1


def _runs(text):
    out = []
    for line in text.split("\n"):
        level, body = (line.count(">"), line.lstrip("> ")) if line.startswith(">") else (0, line)
        if out and out[-1][0] == level:
            out[-1][1].append(body)
        else:
            out.append((level, [body]))
    return out


def _brute(messages):
    """reply_to by comparing each message with all earlier ones."""
    found = {}
    for turn, text in messages.items():
        scores = {}
        earlier = {t: [x for level, x in _runs(messages[t]) if level == 0] for t in messages if t < turn}
        for level, run in (x for x in _runs(text) if x[0]):
            whole = [t for t, held in earlier.items() if any(" ".join(h) == " ".join(run) for h in held)]
            credit = [(t, len(run)) for t in whole] or [(t, sum(any(line in h for h in held) for line in run)) for t, held in earlier.items()]
            for t, n in credit:
                near, total = scores.get(t, (0, 0))
                scores[t] = (near + n * (level == 1), total + n)
        best = max(((*s, t) for t, s in scores.items() if s[1]), default=(None,))
        found[turn] = best[-1]
    return found


def test_replies_against_all_pairs(spark):
    rng = random.Random(5)
    convs = {}
    for c in range(12):
        convs[c] = {}
        for t in range(25):
            convs[c][t] = "\n".join("> " * rng.choice([0, 0, 1, 1, 2]) + f"w{int(rng.random() ** 2 * 9)}" for _ in range(rng.randrange(1, 9)))
    got = {(r.conv_id, r.turn): r.reply_to for r in link_quotations(spark.createDataFrame([(c, t, "a", x) for c, m in convs.items() for t, x in m.items()], PLAIN)).collect()}
    assert got == {(c, t): r for c, m in convs.items() for t, r in _brute(m).items()}


def _threads(spark):
    """Conversations in which quotes are whole, cut short, wrapped anew, nested, and introduced; with a null id, a null text, and two texts of one turn."""
    rng = random.Random(11)
    rows = []
    for c in range(15):
        said = []
        for t in range(30):
            own = [" ".join(rng.choice(["alpha", "Beta", "gamma", "delta", "x"]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 5))]
            lines = []
            for _ in range(rng.randrange(0, 3) if said else 0):
                source = rng.choice(said)
                some = source[rng.randrange(len(source)) :] if rng.random() < 0.3 else " ".join(source).split(" ") if rng.random() < 0.3 else source
                level = rng.choice([1, 1, 2])
                lines += [*(["On Monday, someone wrote:"] if rng.random() < 0.3 else []), *(rng.choice(["> ", ">"]) * level + (x.upper() if rng.random() < 0.2 else x.replace(" ", "  ")) for x in some)]
                lines += rng.choice([[], [""], ["ok"]])
            said.append(own)
            rows.append((c, t, "a", "\n".join(lines + own)))
    rows += [(0, 3, "b", "> alpha\nsecond text of a turn"), (None, 1, "x", "> alpha"), (1, 90, "x", None), (1, 91, "x", "")]
    return spark.createDataFrame(rows, PLAIN).repartition(4)


def test_threads_against_sql(spark):
    import duckdb
    from hyperplane.llm.registry import OP1_SQL

    messages = _threads(spark)
    con = duckdb.connect()
    con.register("conversations", messages.toPandas().astype({"conv_id": "Int64"}))
    names = ["conv_id", "turn", "role", "reply_to", "root", "position", "n_quoted", "deepest", "body"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({OP1_SQL})").fetchall()
    got = [tuple(r) for r in link_quotations(messages).select(*names).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[3] is not None for r in got) > 150 and sum(r[3] is None for r in got) > 30


def test_very_long_message(spark):
    """A message of a megabyte is quoted whole, and in part, by later ones."""
    lines = [f"line {i} of a long message with some words" for i in range(25_000)]
    rows = [(1, 0, "a", "\n".join(lines)), (1, 1, "b", "\n".join("> " + x for x in lines) + "\nyes"), (1, 2, "c", "> line 7 of a long message with some words\n> line 9 of a long message with some words\nno")]
    got = {r.turn: r for r in link_quotations(spark.createDataFrame(rows, PLAIN)).collect()}
    assert got[1].reply_to == 0 and got[1].n_quoted == 25_000 and got[1].body == "yes" and got[2].reply_to == 0 and len(got[0].body) == len(rows[0][3])
