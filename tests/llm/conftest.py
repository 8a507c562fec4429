"""Small documents with everything that may go wrong in a table."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, pos int, rank0 long, size long"


def prose(rng: random.Random, words: int, vocabulary: int = 400) -> str:
    out = []
    for i in range(words):
        out.append(f"w{rng.randrange(vocabulary)}")
        if rng.random() < 0.08:
            out[-1] += "\n"
    return " ".join(out).replace("\n ", "\n")


def hairy_rows() -> list[tuple]:
    rng = random.Random(7)
    passage = prose(rng, 60).replace("\n", " ")
    line = "This line is long enough and stands in a great many documents of this table."
    texts: list[str | None] = [None, "", " \n\t\n ", "one", "one two", "Żółć ŻÓŁĆ\x1cnot a space", "!!! ... 123"]
    texts += [prose(rng, rng.randrange(20, 300)) for _ in range(40)]
    copy = prose(rng, 120)
    texts += [copy] * 12
    words = copy.split(" ")
    for i in range(8):
        changed = list(words)
        changed[i * 3] = f"changed{i}"
        texts.append(" ".join(changed))
    texts += [f"{prose(rng, 50)}\n  {line.upper() if i % 2 else line} \n{prose(rng, 60)}" for i in range(9)]
    texts += [f"{prose(rng, 30)} {passage} {prose(rng, 40)}" for _ in range(5)]
    texts += ["again and " * 40, prose(rng, 20_000, 3000)]
    rows = [
        (i, t, ["en", "de", None][i % 3], [None, "a", "b", "ż", "a"][i % 5], len(t or ""), "x", i, i, i)
        for i, t in enumerate(texts)
    ]
    rows.append(rows[10])  # a repeated row
    rows.append((rows[11][0], "the same id with another text " * 9, "en", "a", 1, None, None, None, None))
    rows.append((None, prose(rng, 80), "en", "a", 1, None, None, None, None))
    rows.append((None, copy, "en", "b", 1, None, None, None, None))
    return rows


@pytest.fixture(scope="session")
def hairy():
    return hairy_rows()


@pytest.fixture(scope="session")
def docs(spark, hairy):
    return spark.createDataFrame(hairy, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
