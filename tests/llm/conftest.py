import pytest

from pyspark.sql import types as T

DOCS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("_row", T.StringType()), T.StructField("row", T.StringType()), T.StructField("_removed", T.LongType()),
])


@pytest.fixture()
def docs(spark):
    """A table of documents, with two further columns whose names clash with inner ones, from (doc_id, text[, source[, lang]]) rows."""

    def make(rows):
        full = []
        for row in rows:
            doc_id, text, source, lang = (*row, *[None] * (4 - len(row)))[:4]
            full.append((doc_id, text, lang, source, None if text is None else len(text), f"x{doc_id}", "y", 5))
        return spark.createDataFrame(full, DOCS)

    return make
