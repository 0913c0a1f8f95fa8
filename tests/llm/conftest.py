import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents table from (doc_id, text, lang, source) rows, with columns that clash with operators' own names."""

    def make(rows, extra=True):
        full = [(i, t, g, s, None if t is None else len(t)) for i, t, g, s in rows]
        df = spark.createDataFrame(full, DOCS)
        if extra:
            from pyspark.sql import functions as F

            names = ["copy", "row", "id", "key", "print", "score", "found", "Rate", "batch", "gram", "words", "bin", "count", "_key", "_rank"]
            df = df.select("*", *[F.lit(None if n == "row" else "x").cast("string").alias(n) for n in names])
        return df

    return make


ODD = [
    (1, None, None, None), (2, "", "en", "a"), (3, "   \n\t ", "en", None), (None, "a text without id", None, "b"), (5, "word " * 30_000, "en", "a"), (6, "same text here again", "en", "a"),
    (6, "same text here again", "en", "a"), (7, "same text here again", "en", "b"), (8, "ñandú — 日本語 \U0001f600 \x00 \x02 end", "es", "a"), (9, "!!!", None, "b"),
]


@pytest.fixture(scope="session")
def odd(docs_of):
    """Nulls, empty and very long texts, ties, repeated rows and clashing columns."""
    return docs_of(ODD)


@pytest.fixture(scope="session")
def empty(docs_of):
    return docs_of([])


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
