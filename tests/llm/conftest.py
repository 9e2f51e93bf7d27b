import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_words long, path string"


def prose(seed, n, words="the of and into river stone light quiet window garden morning over under letter shadow".split()):
    r = random.Random(seed)
    return " ".join(r.choice(words) + r.choice("abcdefgh") for _ in range(n))


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in every column, empty and long texts, repeated rows, and columns whose names clash with results."""
    long = prose(5, 30_000)
    base = prose(1, 80)
    return [
        (1, base, "en", "a", 5, "x"),
        (1, base, "en", "a", 5, "x"),
        (2, base, None, None, None, None),
        (3, "", "en", "a", 0, "x"),
        (4, None, "en", "b", None, None),
        (5, long, "en", "b", 1, "y"),
        (6, base + " tail", "en", "b", 1, "y"),
        (7, "...\n\t ", "en", "b", 1, "y"),
        (None, prose(9, 60), "en", "b", 1, "y"),
        (8, "été ß 日本語 \x00 \x1c end", "fr", "c", 1, "z"),
        (9, "word " * 400, "en", "c", 1, "z"),
    ]


@pytest.fixture
def edge_docs(spark, edge_rows):
    return spark.createDataFrame(edge_rows, DOCS)


@pytest.fixture
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
