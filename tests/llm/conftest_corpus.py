"""Awkward rows for the corpus operators."""

import random

import pytest

WORDS = [a + b for a in "ka te mi so ru na lo pe".split() for b in "ra lin tos mek dun".split()]
COLUMNS = ("doc_id long, text string, lang string, source string, n_chars long, score double, node long, gram string, label float, "
           "key int, id string, slice long, block int, `__key` long, h string")


def prose(seed, words):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(words))


def awkward_rows():
    """Nulls, empty and very long texts, ties, repeated rows."""
    base = [
        (1, prose(1, 120), "en", "a"), (2, prose(1, 120), "en", "a"), (3, prose(1, 118) + " new words", "en", "a"), (4, None, None, None),
        (5, "", "en", "b"), (6, " \n\t ", "de", "b"), (7, "one", "de", "b"), (8, "one", "de", None), (8, "one", "de", None), (9, prose(2, 4), "fr", "c"),
        (10, prose(3, 9000), "fr", "c"), (11, prose(4, 60) + "\n\n" + prose(1, 80), "en", "a"), (12, "äöü ß ÉCOLE Ünï " * 30, "de", "d"),
        (None, prose(5, 50), "en", "a"), (None, None, "en", "a"), (13, "x" * 3000, None, "e"), (14, "😀 " * 150 + prose(1, 100), "en", "e"),
        (15, prose(6, 40) + " " + prose(7, 40), "en", "a"), (15, prose(8, 30), "fr", "z"),
    ]
    return [(*row, None if row[1] is None else len(row[1]), 0.5, 7, "gram", 1.0, 3, "id", 4, 2, 5, "h") for row in base]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
