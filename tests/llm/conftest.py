import random

import pytest

WORDS = ["alpha", "Beta", "gamma,", "delta", "épsilon", "zeta!", "eta", "theta", "iota", "kappa", "λάμδα", "mu", "nu", "xi", "omicron", "pi"]


def prose(seed: int, n: int, words=WORDS) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(words) + str(r.randrange(40)) for _ in range(n))


SHARED = prose(99, 60)


def corpus() -> list[tuple]:
    """(doc_id, text, lang, source, n_chars) with nulls, empties, repeats, copies, near copies, shared passages and a long text."""
    texts = [prose(k, 30 + 7 * k) for k in range(12)]
    near = texts[5].split(" ")
    near[3] = "changed"
    texts += [texts[2], texts[2], " ".join(near), prose(50, 20) + "\n" + SHARED + "\t" + prose(51, 20), SHARED + " " + prose(52, 9), None, "", "   ", "one", "x" * 6000, prose(60, 4000), SHARED]
    rows = [(k, t, ["en", "de", None][k % 3], f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)]
    return [*rows, rows[4], (None, texts[1], "en", "s0", 3), (None, None, None, None, None)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def rows():
    return corpus()


@pytest.fixture
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
