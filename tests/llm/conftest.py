from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, token long, row long, score double, runs string"


def make_docs() -> list[tuple]:
    """Texts of all sorts: null, empty, blank, short, long, copies, near copies, shared passages, other scripts."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randrange(2, 8))) for _ in range(400)]
    some = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base, passage = some(150), some(60)
    near = base.split(" ")
    near[70] = "changed"
    texts = [None, None, "", "  \n\t ", "one", "one two three four", "one two three four five", "é" * 300, "ab" * 400, "字 " * 150]
    texts += [base, base, " ".join(near), base + " tail", some(4000), some(40) + " " + passage + " " + some(30), passage + " " + some(20), some(10) + "\n" + passage]
    texts += ["Same Line\nSame Line\nother line\n\n\n", some(30) + "<|endoftext|>it's 'll 12³ ½", " | ".join(some(25).split(" ")), "### $$$ " * 30]
    texts += [some(rng.randrange(5, 120)) for _ in range(30)]
    return [(i, x, "en", "s", None, "clash", 1, 2, 0.5, "r") for i, x in enumerate(texts)]


@pytest.fixture(scope="session")
def rows():
    return make_docs()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    marks = [(r[0], int(bool(r[1]) and "###" not in r[1] and " | " not in r[1]), int(r[0] % 5 == 3)) for r in rows if r[0] % 9]
    return spark.createDataFrame([*marks, (None, 1, 1), (99999, 1, 0), (7, None, None)], "doc_id long, quality int, toxic int")
