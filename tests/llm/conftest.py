import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """texts -> a table with the columns of documents; a pair is an id and a text."""

    def make(texts, columns=""):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def prose():
    """(seed, number of words) -> words that hardly repeat."""

    def make(seed, n):
        rng = random.Random(seed)
        return " ".join("".join(rng.choice("abcdefghijklmnoprstuvwz") for _ in range(rng.randint(2, 8))) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def odd_texts(prose):
    """Nulls, empty, blank, one-word, very long and repeated texts."""
    same = prose(1, 60)
    return [(1, None), (2, ""), (3, "  \n\t "), (4, "word"), (5, prose(2, 30_000)), (6, same), (7, same), (7, same), (None, same), (None, None), (8, "Ünïcödé 漢字 \U0001F600 \x00 end"), (9, "a" * 5000)]


@pytest.fixture(scope="session")
def clashing():
    """Columns whose names operators use within."""
    from pyspark.sql import functions as F

    names = ["k", "_k", "h", "n", "key", "id", "part", "found", "mask", "score", "rid", "row", "text_len", "component_id", "kept", "size", "bin", "new", "between", "s"]

    def make(df):
        return df.select("*", *(F.lit(f"x{i}").alias(c) for i, c in enumerate(names)))

    return make
