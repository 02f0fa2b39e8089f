"""Tables that the tests of this folder share."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARY = [f"w{i}" for i in range(300)]


def documents(spark, rows, extra=None):
    """A documents table of (doc_id, text) rows; ``extra`` names a column that clashes with outputs."""
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    if extra:
        from pyspark.sql import functions as F

        for name in extra:
            df = df.withColumn(name, F.lit("x"))
    return df


def near_copies(seed=5, bases=4, copies=40):
    """Groups of texts with a few words changed, and odd ones."""
    rnd, rows = random.Random(seed), []
    for _ in range(bases):
        base = [rnd.choice(VOCABULARY) for _ in range(rnd.choice([12, 40, 90]))]
        for _ in range(copies):
            words = list(base)
            for _ in range(rnd.randint(0, 5)):
                words[rnd.randrange(len(words))] = rnd.choice(VOCABULARY)
            rows.append((len(rows), " ".join(words)))
    for text in ("", " \n", None, "a b", "A  B", "one two three", "One two\nthree", "x"):
        rows.append((len(rows), text))
    return rows


@pytest.fixture
def docs_of(spark):
    return lambda rows, extra=None: documents(spark, rows, extra)
