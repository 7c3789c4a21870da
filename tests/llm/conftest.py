from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, label int"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijk") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls in any column, empty and long texts, copies, near copies, repeated rows."""
    rng = random.Random(5)
    base = [words(rng, rng.choice([1, 3, 12, 60, 200])) for _ in range(40)]
    texts = [*base, *base[:6], base[7] + " tail", base[8].upper(), None, "", " \t\n ", "été ÉTÉ Straße", words(rng, 6000), "x " * 300]
    out = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "b", None]), None, 0.5, 1, 0) for i, t in enumerate(texts)]
    return [*out, out[3], (None, "no id here at all", None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs.limit(0)
