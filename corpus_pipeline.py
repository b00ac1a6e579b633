"""From documents to packed training sequences: toxicity, exact dedup, near-duplicate join, sanitisation, packing.

Each stage takes and returns the columns of documents, whatever they are, but the last, which returns the pieces of packed sequences.

Defined cases: a null or empty text is no toxic one; of all rows with such texts the one with the smallest id stays, and is packed as one end token. Rows with null ids are documents too. Very long texts
are taken whole. Repeated rows go with the copies. Labels that are missing or of one kind only reject nothing. An empty table gives no pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ondula.llm import exact_dedup, ngram_join, packing, pii, toxicity
from ondula.llm.common import written


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go."""
    return toxicity.drop_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the smallest doc_id stays."""
    return exact_dedup.drop_duplicates_exact(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates stays."""
    return ngram_join.drop_near_duplicates(docs)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and telling words leave the texts."""
    return pii.sanitise(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed token sequences."""
    return packing.pack_documents(docs)


STAGES = [("toxicity", toxicity_stage), ("exact dedup", exact_stage), ("n-gram Jaccard join", near_stage), ("PII", pii_stage), ("packing", packing_stage)]
#: The classifier, the tokenizer and the packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
