import os
import sys
import random

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n long, key string, row long, size string, kept string, quality string, hash string, part string, _row string, `KIND` string, component string"
EXTRA = ["x"] * 10


def prose(rng, n, kinds=4000):
    return " ".join("w%d" % rng.randrange(kinds) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, repeated rows, ties and clashing names."""
    rng = random.Random(5)
    base = prose(rng, 120)
    rows = [
        (1, base, "en", "a", 5), (2, base, "en", "a", 5), (3, None, "en", "a", 0), (4, "", "en", None, 0), (5, " \t\n ", None, "b", 3), (None, prose(rng, 60), "en", "b", 9), (None, None, None, None, None),
        (6, prose(rng, 30_000), "de", "b", 10), (7, "one two", "fr", "c", 7), (7, "one two", "fr", "c", 7), (8, base + " " + prose(rng, 40), "en", "c", 1), (9, "Ünï çödé \U0001f600 " * 30, "fr", "\U0001f600", 2), (10, "a" * 30_000, "en", "c", 3),
    ]
    return [(*r, *(["x"] + [1] + ["x"] + [2] + ["x"] * 8)) for r in rows]


@pytest.fixture()
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], SCHEMA)
