"""Small documents with every awkward case, shared by the operators' tests."""

from __future__ import annotations

import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
CLASHES = ["id", "ids", "c", "n", "k1", "term", "r", "root", "lines", "spans", "kept", "score", "shard", "slot", "held", "core", "n_lines"]
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), *[T.StructField(c, T.StringType()) for c in CLASHES]])

LONG = " ".join(f"word{i % 701}x{i % 13}" for i in range(30_000))
LINE = "This line of boiler plate stands in several of the documents, word for word."
EDGES = [
    (9000, None), (9001, ""), (9002, " \t\n "), (9003, "one"), (9004, "One two THREE four"), (9005, "one two three four"),
    (9006, LONG), (9007, LONG.replace("word5x", "altered5x", 3)), (9008, "Été à l'école, ÉTÉ ÉTÉ 東京 <|endoftext|> it's 12 ½"),
    (9009, LINE + "\n" + LINE.replace("several", "some") + "\nshort\nshort"), (9010, "Before.\n" + LINE.upper() + "\r\nAfter it."),
    (9011, "12345 67890 !!!"), (9012, "a" * 1500), (None, "A row without an id, but with a text of some words."), (None, None),
    (9013, "the same row twice, the same row twice, for good measure twice"), (9013, "the same row twice, the same row twice, for good measure twice"),
]


def plan_text(df) -> str:
    return df._jdf.queryExecution().toString()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en" if i and i % 2 else None, "s", 0, *["x"] * len(CLASHES)) for i, t in rows], SCHEMA)


@pytest.fixture(scope="session")
def rows(spark):
    """(doc_id, text) of 80 test documents and the edge cases."""
    real = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(80).select("doc_id", "text").collect()
    return [(r.doc_id, r.text) for r in real] + EDGES


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
