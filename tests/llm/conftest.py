import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, node long"


def words(rng, n, vocabulary=400):
    return " ".join(rng.choice(["the", "of", "and"]) if rng.random() < 0.3 else f"w{rng.randrange(vocabulary)}x" for _ in range(n))


def corpus():
    """Copies, near copies, shared passages, null and empty texts, a very long text, short ones, repeated rows, and non-ASCII."""
    rng = random.Random(3)
    passage = words(rng, 70, 5000)
    texts = [words(rng, rng.randrange(1, 200)) for _ in range(60)]
    texts += [texts[3], texts[3], texts[7]]
    for k in range(12):  # near copies of one text
        t = texts[10].split()
        t[k % len(t)] = f"edit{k}"
        texts.append(" ".join(t))
    texts += [words(rng, 40) + " " + passage + "\n" + words(rng, 30) for _ in range(8)]
    texts += [None, "", " \n\t ", "one", "Été déjà vu 日本語 ▁ — ok", "a b c d", "A B c D", "x" * 300, words(rng, 30_000), "line one here\n" * 40, "   double  spaces \n here"]
    texts += [words(rng, 230_000, 50_000), texts[12], words(rng, 20)]  # above a piece of 1 MiB, with texts behind it
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(5, texts[5]), (5, texts[5])]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The corpus with columns whose names operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "src", len(t or ""), "x", 1) for i, t in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
