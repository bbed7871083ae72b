"""The corpus pipeline: stages over ``documents``, each over all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.workers import importable
from millrace.llm import common, exact_dedup, ngram_join, packing, secrets, toxicity


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the model, fitted on ``labels``, takes for toxic."""
    importable(spark)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.drop_toxic(docs, model)


def copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of those with the same text."""
    importable(spark)
    return exact_dedup.drop_exact_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies."""
    importable(spark)
    return ngram_join.drop_near_copies(docs, n=2, theta=0.65)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mask the secrets; every document stays."""
    importable(spark)
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Assign every document's pieces to training sequences."""
    importable(spark)
    return packing.best_fit_pack(docs, capacity=2048)


STAGES = [
    ("toxicity", toxic),
    ("exact dedup", copies),
    ("n-gram Jaccard join", near_copies),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: SQL expresses neither the learnt toxicity model nor best-fit packing.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``, each result written as Parquet and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
