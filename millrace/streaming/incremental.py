"""Streams: incremental ingestion of files, trailing totals of logs, and the same logic replayed in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.chunking import chunk_documents
from millrace.operators.ingest import content_hash, filter_changed, mark_ingested

CHUNKS = "source string, strategy string, pos int, content string, start_index int, end_index int, chunk_id string"
STATE = "source string, hash string, doc_type string"


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    exists = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return spark.read.schema(schema).parquet(path) if exists else spark.createDataFrame([], schema)


def ingest_batch(docs: DataFrame, folder: str, batch_id: int) -> None:
    """Chunk what changed in ``docs (content, source, doc_type)``.

    Chunks and state of a batch are written below its number, replacing an earlier try of the same batch, so
    that a batch that is repeated after a failure doesn't count twice.
    """
    spark = docs.sparkSession
    state = _read(spark, f"{folder}/state", STATE + ", batch bigint").where(F.col("batch") < batch_id)
    latest = state.groupBy("source").agg(F.max_by(F.struct("hash", "doc_type"), "batch").alias("s")).select("source", "s.*")
    changed = filter_changed(docs, latest)
    chunk_documents(changed).write.mode("overwrite").parquet(f"{folder}/chunks/batch={batch_id}")
    new = changed.groupBy("source").agg(F.max_by(F.struct(content_hash(F.col("content")).alias("hash"), "doc_type"), content_hash(F.col("content"))).alias("s")).select("source", "s.*")
    new.write.mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")


def current_chunks(spark: SparkSession, folder: str) -> DataFrame:
    """The chunks of every source's last ingested version."""
    chunks = _read(spark, f"{folder}/chunks", CHUNKS + ", batch bigint")
    last = _read(spark, f"{folder}/state", STATE + ", batch bigint").groupBy("source").agg(F.max("batch").alias("batch"))
    return chunks.join(last, ["source", "batch"]).drop("batch")


def ingest_stream(stream: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the incremental ingestion of a stream of documents."""
    return stream.writeStream.foreachBatch(lambda docs, n: ingest_batch(docs, folder, n)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def daily_totals(events: DataFrame, lateness: str = "1 day") -> DataFrame:
    """Count and sum of ``value`` per day and type; on a stream, days close once the watermark has passed them."""
    return events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


def drop_repeats(stream: DataFrame, key: str, lateness: str = "1 day") -> DataFrame:
    """First of the rows with one key within the lateness."""
    return stream.withWatermark("ts", lateness).dropDuplicatesWithinWatermark([key])


def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What two batches bring when the second holds all documents and the first all but the French ones: the state after both."""
    from millrace.plans.inputs import documents

    docs = documents(spark, sf_dir)
    empty = spark.createDataFrame([], STATE)
    state = mark_ingested(empty, docs.where("lang <> 'fr'"), F.col("doc_id"))
    return filter_changed(docs, state).select("doc_id", "source")
