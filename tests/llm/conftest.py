import random

import pytest


def words(rng, n, size=400):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns whose names clash."""
    rng = random.Random(7)
    long = " ".join(words(rng, 6000))
    base = " ".join(words(rng, 120))
    near = base.replace(" w1", " v1", 1)
    rows = [
        (1, base, "en", "a", len(base)), (2, base, "en", "a", len(base)), (3, near, None, None, None), (4, "", "en", "b", 0),
        (5, None, "en", "b", None), (None, "one two three", None, "c", 13), (6, long, "de", "c", len(long)), (6, long, "de", "c", len(long)),
        (7, "  \n\t ", "fr", "c", 5), (8, "Só ñandú x \x1c y É 日本語\n\nzwei", "es", "c", 20), (9, "a", "en", "a", 1), (-3, base + " " + long[:900], "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    from pyspark.sql import functions as F

    clash = ["key", "h", "n", "fp", "node", "a", "b", "start", "length", "digest", "kind", "count", "pos", "item_id", "label", "part", "bucket", "gid", "root", "value"]
    return df.select("*", *[F.lit("x").alias(c) for c in clash])


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
