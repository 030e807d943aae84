"""Fixtures shared by the operators' tests: small tables with every odd case."""

import random

import pytest

WORDS = ["alpha", "beta", "gamma", "delta", "Epsilon", "zeta,", "eta", "theta.", "iota", "kappa", "é", "naïve", "x1", "42"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", str(rng.randrange(30))]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    """(doc_id, text): copies, near copies, shared passages, repeated lines, odd texts."""
    rng = random.Random(3)
    rows = []
    passage = prose(rng, 60)
    base = prose(rng, 120)
    for i in range(60):
        rows.append((i, prose(rng, rng.randrange(1, 150))))
    for i in range(60, 75):
        words = base.split()
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"edit{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    for i in range(75, 90):
        rows.append((i, prose(rng, rng.randrange(0, 40)) + " " + passage + " " + prose(rng, rng.randrange(0, 40))))
    for i in range(90, 96):
        rows.append((i, rows[5][1]))
    rows += [(96, None), (97, ""), (98, " \t\n "), (99, "one two"), (100, "one  two"), (101, "a " * 300), (102, "a b " * 200), (103, "z" * 5000), (104, "日本 " * 50 + "\x00 \x1c \x85 \xa0"), (105, base.upper())]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """With extra columns, one of a clashing name, over several partitions."""
    rows = [(i, t, "en" if i % 2 else "de", i, "x") for i, t in corpus]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, n bigint, score string").repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
