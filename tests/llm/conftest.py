import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Null in each column, empty and very long texts, repeated rows, ties, and columns that clash with results."""
    rows = [(1, None, None, None, None), (None, "no id here", "en", "s", 1), (2, "", "en", "s", 0), (3, "the cat sat on the mat " * 4000, "en", "s", 1), (4, "word", "fr", "s", 4), (4, "word", "fr", "s", 4), (5, "word", None, None, None), (6, "\t\n  ", "en", "s", 4), (7, "é😀 password = abcdefghijklmnop a.b@c.de", "en", "s", 3)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("clash") for c in ("fp", "block", "spans", "score", "n_words", "norm", "media", "key", "ids", "clean")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def prose():
    """Made-up documents of two languages, reproducible."""
    rng = random.Random(5)
    parts = {"aa": ["the", "and", "th", "ing", "wh", "ou"], "bb": ["der", "sch", "ei", "ung", "ch", "ie"]}
    docs = []
    for i in range(160):
        lang = "aa" if i % 2 else "bb"
        words = ["".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(20, 60))]
        docs.append((i, " ".join(words), lang, "s", 0))
    return docs
