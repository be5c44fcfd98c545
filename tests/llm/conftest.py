import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SMALL = "/root/testdata/sf0.001"

#: rows that every document operator must stand: null and empty texts, null ids, languages
#: and sources, a long text, ties, and a row that is there twice
LONG = " ".join(f"w{k % 977}x{k}" for k in range(30000))
ROWS = [
    (1, "one two three four five six seven\nsecond line here\nthird line", "en", "a"),
    (1, "one two three four five six seven\nsecond line here\nthird line", "en", "a"),
    (2, None, "en", None), (3, "", None, "a"), (4, " \t\n \r\n", "de", "b"), (5, LONG, "en", "b"),
    (6, LONG + " end", None, None), (None, "no id but some words are here", "fr", "a"),
    (None, None, None, None), (7, "solo", "en", "c"), (8, "日本語 ▁ \U0001f642 1234", "xx", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def edge(spark):
    """The rows above with further columns whose names clash with those of operators."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in ("th", "size", "n_words", "target", "rid", "score", "text.x"):
        df = df.withColumn(c, F.lit("keep"))
    return df


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
