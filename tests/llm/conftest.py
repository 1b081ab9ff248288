import pytest
from pyspark.sql import functions as F

LONG = "alpha beta gamma delta " * 8000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, extra and clashing columns."""
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, LONG, "en", "a", len(LONG)), (4, "   \n\t ", "de", None, 6),
            (5, "one two three", None, "b", 13), (5, "one two three", None, "b", 13), (None, "one two three four five", "en", "a", 23),
            (6, "é ü 漢字 ñ 42", "fr", "b", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in ("n_words", "score", "p", "key", "spans", "epoch", "weight", "kept", "prefix", "a", "b", "host", "root", "tag", "_t"):
        df = df.withColumn(c, F.lit("x"))
    return df


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def small(spark):
    """(documents rows as a list of Row) of the smallest test tables."""
    return "/root/testdata/sf0.001"
