"""Fixtures of the training-data operator tests, imported by name (a second
``conftest`` would shadow the first)."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])
# columns that operators use inside, as extra columns of the input
CLASHING = ["score", "predicted", "offending", "fp", "_tk", "_id", "_key", "_n", "_leaks", "todo",
            "spans", "kept", "pii_spans", "_odd", "_text", "mix_topic", "host", "rule", "_ruled", "key"]


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, lang[, source]]) tuples."""
    def make(rows, clash=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0",
                 None if r[1] is None else len(r[1])) for r in rows]
        df = spark.createDataFrame(full, DOCS)
        if clash:
            from pyspark.sql import functions as F
            df = df.select("*", *[F.lit(f"x{i}").alias(c) for i, c in enumerate(CLASHING)])
        return df
    return make


@pytest.fixture
def make_labels(spark):
    def make(rows):
        return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    return make


HARD = [(None, "no id but some words here"), (1, None), (2, ""), (3, " \t\n "), (3, " \t\n "),
        (4, "*** !!! 123"), (5, "word " * 30000), (6, "Ünïcode ßtraße Привет мир 世界 🎉"),
        (7, "same row twice"), (7, "same row twice"), (7, "same id, other text"), (None, None), (None, None)]


@pytest.fixture
def hard_rows():
    """Nulls, empty, long, repeated and odd texts."""
    return list(HARD)
