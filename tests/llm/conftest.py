import os

import pytest
from pyspark.sql import functions as F

LONG = " ".join(f"word{i % 977} and {i}" for i in range(9000))
SHARED = "this passage stands in several documents and is long enough to be seen by every operator that looks for repeats " * 5
EDGE_TEXTS = [
    None, "", " \t\n", "one two", "ONE two", "one  two", LONG, LONG, LONG + " tail", SHARED, "before " + SHARED + "after", "x" * 1200, "ab" * 700 + "c" + "ab" * 300,
    "mail a.b@c.org or x@y.z.w, call +1 (555) 010-9999, host 10.0.0.1 and 999.1.1.1, card 4111 1111 1111 1111.",
    "nul \x00 and \x1c sign, äöü 中文 \U0001f600 café İstanbul", "a  b   c d", "don't <|endoftext|> we'll 12345   \n\n  end  ", "+" * 50 + "@" * 50 + "1." * 50,
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls, empty and very long texts, repeated rows, a null id, and extra columns with names that operators use inside."""
    rows = [(i, t) for i, t in enumerate(EDGE_TEXTS)] + [(9, SHARED), (None, "a text without an id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    clash = {c: F.lit(c) for c in ("row", "key", "id", "token", "rep", "row_key", "marks", "score", "component_id", "bucket", "position", "suspect", "n", "lang")}
    return docs.withColumns(clash).withColumn("source", F.lit(None).cast("string"))


@pytest.fixture(scope="session")
def empty_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")


@pytest.fixture(scope="session")
def docs(spark, data_dir):
    return spark.read.parquet(os.path.join(data_dir, "documents.parquet"))


@pytest.fixture(scope="session")
def pairs(docs, edge_docs):
    """(id, text) of the small table and the edge cases, the latter under ids of their own."""
    low = docs.selectExpr("doc_id", "text")
    both = low.unionByName(edge_docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text").filter("doc_id is not null"))
    return both


@pytest.fixture(scope="session")
def listed(pairs):
    return [(r["doc_id"], r["text"]) for r in pairs.collect()]
