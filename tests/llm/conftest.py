import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, f string, n string"


def odd_rows():
    """Nulls, blanks, a very long text, ties, repeated rows and columns with clashing names."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    long = " ".join(rng.choice(words) for _ in range(20_000))
    some = " ".join(rng.choice(words) for _ in range(120))
    texts = [(1, some, "a"), (2, some, "a"), (3, some.upper(), "b"), (4, None, None), (5, "", "b"), (6, " \t\n ", None), (7, "one two", "a"), (8, "one two", "c"), (9, long, "a"), (9, long, "a"), (None, some, "a"), (None, None, None), (10, "x" * 30_000, "b")]
    return [(i, t, "en", s, 0, 1, 0.5, "f", "n") for i, t, s in texts]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")
