import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b + c for a in ("an", "re", "ti", "on", "sh") for b in ("the", "ing", "ble", "st") for c in ("a", "er", "ly", "ou", "nd")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, blanks, ties, repeated rows, near copies and a long text."""
    base = prose(1, 300)
    rows = [
        (1, base, "en", "a", 0), (2, base, "en", "a", 0), (2, base, "en", "a", 0), (3, base.replace(base.split()[7], "changed", 1), "en", "b", 0),
        (4, None, "en", None, None), (5, "", None, "b", 0), (6, " \t\n", "fr", "c", 3), (7, "two words", "fr", "c", 9), (8, "TWO Words", "fr", None, 9),
        (9, prose(2, 20000), "de", "a", 0), (10, prose(3, 150) + " " + base, "de", "d", 0), (None, base, "en", "a", 0), (11, "é😀 naïve " * 60, "es", "d", 0),
        (12, "a" * 3000, "es", "d", 0), (13, prose(4, 40), None, "e", 0), (14, prose(5, 120), "en", "a", 0),
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)
