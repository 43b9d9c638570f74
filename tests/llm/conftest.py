import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, component string, size int, copies int, __x int"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text, lang, source) rows, with further columns of clashing names."""
    def frame(rows):
        return spark.createDataFrame([(i, t, la, s, None if t is None else len(t), "f", "c", 1, 2, 3) for i, t, la, s in rows], SCHEMA)
    return frame


@pytest.fixture(scope="session")
def odd():
    """Null, empty, blank, repeated, tied and very long texts."""
    long = " ".join(f"word{i % 977} and{i % 13}" for i in range(60_000))
    return [(1, None, None, None), (2, "", "en", "a"), (3, " \t\n", "en", "a"), (4, "one", "en", "b"), (5, "one two", "de", "b"),
            (6, long, "en", "c"), (6, long, "en", "c"), (7, long, "fr", None), (None, "one two three four", "en", "a"),
            (8, "One TWO three\x0bfour", "en", "a"), (9, "Überraschung ist ein Wort", "de", "ä"), (10, "123 456 !!!", "en", "a")]


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def rows():
    def of(df):
        return [r.asDict() for r in df.select(*[F.col(f"`{c}`") for c in df.columns]).collect()]
    return of
