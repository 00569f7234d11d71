import datetime

import pytest

from pyspark.sql import types as T

#: Schemas of the tables, with a column that clashes with names the operators use.
DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("score", T.StringType()),
        T.StructField("length", T.DateType()),
        T.StructField("component_id", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from texts: ids count from 0; a row may also be (doc_id, text) or (doc_id, text, source)."""

    def make(rows):
        full = []
        for number, row in enumerate(rows):
            doc_id, text, source = (number, row, "src0") if row is None or isinstance(row, str) else (*row, "src0")[:3]
            full.append((doc_id, text, "en", source, None if text is None else len(text), "clash", datetime.date(2020, 1, 1), "clash"))
        return spark.createDataFrame(full, DOCS)

    return make


ODD_TEXTS = [None, "", " ", "\n\n", "a", "A b", "word " * 3000, "x" * 70_000, "same text here now", "same text here now", "naïve ünï ▁ code \U0001f600", " lead", "tail ", "two  spaces"]


@pytest.fixture(scope="session")
def odd_texts():
    return ODD_TEXTS
