import random

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int, capital: float = 0.1) -> str:
    out = ["".join(rng.choice("aeioulnrst") for _ in range(rng.randrange(1, 8))) for _ in range(n)]
    return " ".join(w.capitalize() if rng.random() < capital else w for w in out)


@pytest.fixture(scope="session")
def make(spark):
    """docs of a list of texts, or of (doc_id, text) pairs."""

    def run(texts, first=0):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts, first)]
        return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)

    return run


@pytest.fixture(scope="session")
def awkward(spark, make):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns with clashing names."""
    rng = random.Random(5)
    long = words(rng, 30_000)
    texts = [(1, None), (2, ""), (3, " \n\t "), (4, "Ein kurzer Text."), (4, "Ein kurzer Text."), (4, "ein anderer"), (None, "Ein kurzer Text."), (None, None), (5, long), (6, long), (7, "x" * 100_000), (8, "é" * 5000 + "\x0b日本 ß"), (9, " \n" * 700_000 + "Ende")]
    df = make(texts)
    for c in ("fp", "group", "block", "id", "text_key", "score", "length", "rank", "salt", "runs", "n_units", "component_id", "__id", "__key", "__units", "_id", "_key", "h", "w", "row", "hit", "copy", "far", "again", "start", "word", "n", "y", "x", "item_id", "label"):
        df = df.withColumn(c, F.lit("clash"))
    return df.withColumn("lang", F.lit(None).cast("string")).withColumn("n_chars", F.lit(None).cast("long"))


@pytest.fixture(scope="session")
def empty(make):
    return make([])
