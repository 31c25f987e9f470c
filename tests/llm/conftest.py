from __future__ import annotations

import random

import pytest

SYLLABLES = ("ba", "de", "ki", "lo", "mu", "na", "po", "ra", "se", "ti")


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 4))) for _ in range(words))


@pytest.fixture(scope="session")
def corpus():
    """Texts with every odd case: null, empty, blank, short, repeated, near copies, shared passages, long."""
    rng = random.Random(11)
    texts: list[str | None] = [None, "", " \t\n ", "a", "A b", "a  B", "one two three four", "ONE two\tthree\x0bfour", "é É ß", "x" * 3000, "12 34 --"]
    base = prose(rng, 300).split()
    for i in range(30):
        words = list(base)
        for at in rng.sample(range(300), i % 12):
            words[at] = f"w{i}_{at}"
        texts.append(" ".join(words))
    passage = prose(rng, 90)
    texts += [f"{prose(rng, 100)} {passage} {prose(rng, 60)}" for _ in range(12)]
    texts += [prose(rng, rng.randint(1, 80)) for _ in range(40)]
    texts += ["the same line\n" * 60, "the same line\n" * 75, "ab" * 700, prose(rng, 20_000)]
    texts += [texts[12], texts[12], texts[60], None, ""]
    rng.shuffle(texts)
    return texts


DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, content string, mix string, judged string"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus as a table with a hot source, null labels and columns named like the operators' own."""
    rows = [(i, t, ("en", "de", None)[i % 3], None if i % 17 == 0 else "hot" if i % 2 else f"s{i % 5}", len(t or ""), "id", -1, "c", "m", "j") for i, t in enumerate(corpus)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
