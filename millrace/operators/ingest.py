"""Ingestion state, keyed upserts, and the pipeline from documents to stored chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import estimated_tokens
from millrace.functions.vectors import l2_normalize
from millrace.operators.chunking import chunk_documents, enrich


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def filter_changed(docs: DataFrame, state: DataFrame) -> DataFrame:
    """Documents whose source is new in ``state (source, hash)`` or has another hash there."""
    known = state.select("source", F.col("hash").alias("_known"))
    changed = F.col("_known").isNull() | (F.col("_known") != content_hash(F.col("content")))
    return docs.join(known, "source", "left").where(changed).drop("_known")


def mark_ingested(state: DataFrame, docs: DataFrame, order: Column) -> DataFrame:
    """``state`` with the documents' hashes; of documents with one source the last by ``order`` counts."""
    last = F.row_number().over(Window.partitionBy("source").orderBy(order.desc()))
    new = docs.withColumn("_n", last).where("_n = 1").select("source", content_hash(F.col("content")).alias("hash"), "doc_type")
    return state.join(new.select("source"), "source", "left_anti").select("source", "hash", "doc_type").unionByName(new)


def forget(state: DataFrame, sources: DataFrame) -> DataFrame:
    return state.join(sources.select("source").distinct(), "source", "left_anti")


def tracked(state: DataFrame) -> DataFrame:
    return state.agg(F.count(F.lit(1)).alias("tracked"))


def upsert(store: DataFrame, rows: DataFrame, order: Column | None = None) -> DataFrame:
    """``store`` with ``rows`` in place of those with the same ``chunk_id``; vectors are normalised on the way in."""
    new = rows.withColumn("embedding", l2_normalize(F.col("embedding")))
    if order is not None:
        last = F.row_number().over(Window.partitionBy("chunk_id").orderBy(order.desc()))
        new = new.withColumn("_n", last).where("_n = 1").drop("_n")
    old = store.withColumn("embedding", F.col("embedding").cast("array<double>")).join(new.select("chunk_id"), "chunk_id", "left_anti")
    return old.unionByName(new.select(old.columns))


def delete(store: DataFrame, ids: DataFrame) -> DataFrame:
    return store.join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti")


def stored_metadata(source: Column, metadata: Column) -> Column:
    """The source and the chunk's own entries, of which one named source wins."""
    return F.map_concat(F.map_filter(F.create_map(F.lit("source"), source), lambda k, v: ~F.map_contains_key(metadata, k)), metadata)


def batches(chunks: DataFrame, size: int = 100, order: tuple[str, ...] = ("source", "pos")) -> DataFrame:
    """Embedding calls of at most ``size`` chunks of one source: ``batch_no`` and ``batch_id``."""
    n = F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:])) - 1
    return chunks.withColumn("batch_no", F.floor(n / size))


def ingest_chunks(docs: DataFrame, strategy: str = "auto", size: int = 512, overlap: int = 50) -> DataFrame:
    """Chunked and described; documents without content or source are set aside by ``ingest_stats`` as errors."""
    valid = docs.where(F.col("content").isNotNull() & F.col("source").isNotNull())
    return enrich(chunk_documents(valid, strategy, size, overlap))


def ingest_stats(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents processed, chunks, embeddings, tokens and errors."""
    bad = F.col("content").isNull() | F.col("source").isNull()
    d = docs.agg(F.count_if(~bad).alias("documents_processed"), F.count_if(bad).alias("errors"))
    c = chunks.agg(F.count(F.lit(1)).alias("chunks_created"), F.coalesce(F.sum(estimated_tokens(F.col("content"))), F.lit(0)).alias("tokens"))
    return d.crossJoin(c).withColumn("embeddings_generated", F.col("chunks_created"))


def ingest_incremental(docs: DataFrame, state: DataFrame, strategy: str = "auto", size: int = 512, overlap: int = 50) -> DataFrame:
    """Statistics of ingesting only what changed, with how many documents were skipped."""
    changed = filter_changed(docs, state)
    stats = ingest_stats(changed, ingest_chunks(changed, strategy, size, overlap))
    counts = docs.agg(F.count(F.lit(1)).alias("_all")).crossJoin(changed.agg(F.count(F.lit(1)).alias("documents_changed")))
    return stats.crossJoin(counts.select((F.col("_all") - F.col("documents_changed")).alias("documents_skipped"), "documents_changed"))


def replace_source(store: DataFrame, chunks: DataFrame) -> DataFrame:
    """A changed document's chunks take the place of all it had before."""
    return store.join(chunks.select("source").distinct(), "source", "left_anti").unionByName(chunks.select(store.columns))
