"""A training-data pipeline over `documents`: score, deduplicate, join near copies, redact, pack.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomspark.llm import exact_dedup, ngram_join, packing, quality_classifier, secret_ledger
from loomspark.llm.queries import pattern, vocabulary
from loomspark.llm.store import Scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on `labels`, rejects go."""
    return quality_classifier.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal but for white space the one with the smallest doc_id stays."""
    return exact_dedup.keep_rows(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a Jaccard similarity of 0.8 over five-word n-grams the smallest doc_id stays."""
    groups = ngram_join.jaccard_components(docs, k=5, percent=80)
    gone = groups.where("component_id != doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts are replaced by a mark; every document stays."""
    return secret_ledger.redact_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents' token sequences, with their ids."""
    return packing.pack_documents(docs, vocabulary("byte_bpe_50k.json"), vocabulary("byte_bpe_50k.tiktoken"), pattern())


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("n-gram Jaccard join", near), ("secret scans", secrets), ("packing", pack)]

#: Training, connected components and packing by dynamic programming are not expressible in SQL; the tests
#: hold every stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table in the shared checkpoint folder."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
