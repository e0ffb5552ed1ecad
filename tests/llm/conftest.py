import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, size string, digest string, row string, fp string, node string"

WORDS = "the of and river stone quiet lamp harbour winter copper garden walking seven bright letters window paper under morning glass".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def rows():
    base = prose(1, 120)
    near = base.replace("river", "meadow", 1)
    long_text = prose(2, 30_000)
    texts = [
        (1, base, "a"), (2, base, "a"), (3, near, "b"), (4, None, "b"), (5, "", None), (6, "   \n\t ", "c"), (7, prose(3, 80), "a"),
        (7, prose(3, 80), "a"), (None, prose(4, 90), None), (8, long_text, "a"), (9, "one two three", "b"), (10, "x", "c"),
        (11, "Don't <|endoftext|> stop 日本 café 'tis 10.0.0.1 +1 (301) 555-0346 a.b@c-d.org 4111 1111 1111 1111", "c"),
        (12, "spam spam spam " * 40, "b"), (13, prose(5, 60) + " " + base[:400], "c"), (14, "é" * 60 + " " + base[200:700], "d"),
    ]
    return [(i, t, "en", s, None, "clash", "clash", "clash", "clash", "clash", "clash") for i, t, s in texts]


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls in every column, empty and very long texts, copies, repeated rows, clashing names."""
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sample(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").toPandas()
