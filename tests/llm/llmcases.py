"""Rows and a fixture that several tests share."""

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(n, seed):
    """n words that no other seed gives."""
    return " ".join(f"w{seed}x{i * 7919 % 100003}" for i in range(n))


#: Ids and texts with all that is odd: nulls, empty and blank texts, repeated rows, ties, one long text.
ODD = [(None, None), (None, "a b"), (1, None), (2, ""), (3, " \t\n"), (4, "x"), (5, "x"), (5, "x"), (6, "é" * 60 + "\n" + "\U0001f600" * 70), (7, words(30000, 1)), (8, words(30000, 1)), (9, "same same " * 500), (10, "same same " * 400), (10, "other text under the same id")]


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, lang, source), over several partitions."""

    def make(rows, parts=3):
        rows = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "s0", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(rows, DOCS).repartition(parts) if rows else spark.createDataFrame([], DOCS)

    return make
