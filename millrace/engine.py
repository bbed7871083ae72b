"""The pipeline as one object: ingest documents, answer queries, evaluate, account.

All state is Parquet below one folder.  Every method takes or returns DataFrames; only budgets are
looked at on the driver, before work starts.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.config import Config
from millrace.functions.text import estimated_tokens
from millrace.functions.workers import importable
from millrace.operators import embed, evaluate, ingest, oplog, rewrite, search
from millrace.sources import documents

_COSTS = "category string, amount double, ts timestamp, model string, units bigint"


class Engine:
    def __init__(self, spark: SparkSession, config: Config, folder: str) -> None:
        self.spark, self.config, self.folder = importable(spark), config, folder.rstrip("/")

    # tables

    def _table(self, name: str, schema: str) -> DataFrame:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{name}") if there else self.spark.createDataFrame([], schema)

    def _replace(self, name: str, rows: DataFrame) -> None:
        """Write beside, then swap, as the new table is made from the old."""
        new = f"{self.folder}/.{name}-{uuid.uuid4().hex}"
        rows.write.parquet(new)
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        system = target.getFileSystem(conf)
        system.delete(target, True)
        system.rename(jvm.org.apache.hadoop.fs.Path(new), target)

    def store(self) -> DataFrame:
        return self._table("store", "chunk_id string, content string, source string, doc_type string, embedding array<double>")

    def state(self) -> DataFrame:
        return self._table("state", "source string, hash string, doc_type string")

    def costs(self) -> DataFrame:
        return self._table("costs", _COSTS)

    def query_log(self) -> DataFrame:
        return self._table("queries", "query string, num_results bigint, max_score double, latency_ms double, ts timestamp, sources array<string>")

    def audit(self) -> DataFrame:
        result = "array<struct<chunk_id:string,source:string,score:double,content_preview:string>>"
        return self._table("audit", f"ts timestamp, tenant_id string, query string, num_results int, results {result}")

    # parts of the configuration

    def load_sources(self) -> DataFrame:
        return documents.scan_sources(self.spark, [{"type": s.type, "file_types": s.file_types, **s.config} for s in self.config.data_sources])

    def _embedder(self, remote=None):
        return embed.embedder_for(self.config.embedding.model, self.config.embedding.dimensions, remote)

    def _budget(self, as_of: str) -> str:
        budget = self.config.cost.budget
        status = oplog.budget_status(self.costs(), as_of, budget.get("daily", 10.0), budget.get("monthly_total", 100.0))
        return oplog.check_budget(status, self.config.cost.optimization.get("action_on_exceed", "alert"))

    def _spent(self, category: str, units, rows: DataFrame, as_of: str, model: str) -> None:
        cost = rows.agg(F.coalesce(F.sum(units), F.lit(0)).cast("bigint").alias("units"))
        cost = cost.select(F.lit(category).alias("category"), oplog.embedding_cost(F.col("units"), F.lit(model)).alias("amount"), F.lit(as_of).cast("timestamp").alias("ts"), F.lit(model).alias("model"), "units")
        cost.write.mode("append").parquet(f"{self.folder}/costs")

    # ingestion

    def ingest(self, docs: DataFrame | None, as_of: str, remote=None) -> DataFrame:
        """Chunk, embed and store ``docs (content, source, doc_type)``, or the configured sources; statistics in one row.

        All earlier chunks of a source that comes again are replaced.
        """
        docs = self.load_sources() if docs is None else docs
        self._budget(as_of)
        c, e = self.config.chunking, self.config.embedding
        chunks = ingest.ingest_chunks(docs, c.strategy, c.max_chunk_size, c.overlap)
        kinds = docs.groupBy("source").agg(F.max("doc_type").alias("doc_type"))
        rows = chunks.join(kinds, "source").select("chunk_id", "content", "source", "doc_type")
        vectors = embed.embed(rows, "content", self._embedder(remote), e.batch_size)
        self._replace("store", ingest.replace_source(self.store(), vectors))
        self._spent("embedding", estimated_tokens(F.col("content")), rows, as_of, e.model)
        return ingest.ingest_stats(docs, chunks)

    def ingest_changed(self, docs: DataFrame, as_of: str, remote=None) -> DataFrame:
        """Only what is new or different; the state then knows it."""
        c = self.config.chunking
        counts = ingest.ingest_incremental(docs, self.state(), c.strategy, c.max_chunk_size, c.overlap)
        row = counts.collect()
        changed = ingest.filter_changed(docs, self.state())
        self.ingest(changed, as_of, remote)
        self._replace("state", ingest.mark_ingested(self.state(), changed.where("content is not null"), F.col("content")))
        return self.spark.createDataFrame(row, counts.schema)

    # queries

    def query(self, queries: DataFrame, as_of: str, k: int = 0, where=None, expand: bool = False, remote=None) -> DataFrame:
        """``queries (query_id, query)`` to ``(query_id, rank, chunk_id, score, content, source)``.

        Twice as many candidates as wanted come from the vectors and are ranked again with the keywords.
        """
        k = k or self.config.retrieval.top_k
        self._budget(as_of)
        variants = rewrite.expand(F.col("query")) if expand else F.array("query")
        asked = queries.select("query_id", F.posexplode(variants).alias("variant", "query"))
        asked = asked.withColumn("variant_id", F.concat_ws("|", "variant", "query_id"))
        vectors = embed.embed(asked, "query", self._embedder(remote), self.config.embedding.batch_size)
        store = self.store() if where is None else self.store().where(where)
        text = store.select("chunk_id", "content", "source")
        found = search.vector_search(store, vectors.select(F.col("variant_id").alias("query_id"), "embedding"), 2 * k).join(text, "chunk_id")
        r = self.config.retrieval
        ranked = search.hybrid_rank(found, asked.select(F.col("variant_id").alias("query_id"), "query"), k, *search.method_weights(r.method, r.semantic_weight, r.keyword_weight))
        back = asked.select(F.col("variant_id").alias("_v"), F.col("query_id").alias("_q"), "variant")
        merged = search.merge_variants(ranked.join(back, ranked.query_id == back["_v"]).select(F.col("_q").alias("query_id"), "variant", "chunk_id", "score"), k)
        self._spent("retrieval", estimated_tokens(F.col("query")), asked, as_of, self.config.embedding.model)
        return merged.join(text, "chunk_id").select("query_id", "rank", "chunk_id", "score", "content", "source")

    def query_logged(self, queries: DataFrame, as_of: str, latency_ms: float = 0.0, **options) -> DataFrame:
        found = self.query(queries, as_of, **options)
        asked = queries.select("query_id", "query", F.lit(float(latency_ms)).alias("latency_ms"), F.lit(as_of).cast("timestamp").alias("ts"))
        oplog.record_queries(found, asked).write.mode("append").parquet(f"{self.folder}/queries")
        return found

    def query_audited(self, queries: DataFrame, tenant: str, as_of: str, policies: DataFrame | None = None, **options) -> DataFrame:
        """Query and write the audit log; with ``policies`` only what the tenant may see."""
        found = self.query(queries, as_of, **options)
        if policies is not None:
            found = oplog.access_filter(found.withColumn("tenant_id", F.lit(tenant)), policies).drop("tenant_id")
        asked = queries.select("query_id", "query", F.lit(tenant).alias("tenant_id"), F.lit(as_of).cast("timestamp").alias("ts"))
        oplog.audit_records(found.withColumn("chunk_id", F.col("chunk_id").cast("string")), asked).write.mode("append").parquet(f"{self.folder}/audit")
        return found

    def evaluate(self, golden_path: str, as_of: str, k: int = 0) -> DataFrame:
        k = k or self.config.quality.evaluation.get("k") or self.config.retrieval.top_k
        golden = documents.scan_golden(self.spark, golden_path).withColumn("query_id", F.col("query"))
        relevant = golden.select("query_id", F.explode("relevant_ids").alias("chunk_id")).join(self.store().select("chunk_id"), "chunk_id")
        return evaluate.evaluate_run(self.query(golden.select("query_id", "query").distinct(), as_of, k), relevant.select("query_id", "chunk_id"), k)

    def cost_report(self, as_of: str) -> DataFrame:
        budget = self.config.cost.budget
        return oplog.cost_report(self.costs(), as_of, budget.get("daily", 10.0), budget.get("monthly_total", 100.0))
