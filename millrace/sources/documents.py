"""Sources and sinks: document files, golden sets, state and audit logs, the vector table, webhooks."""

from __future__ import annotations

import json
import urllib.request
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "content string, source string, metadata map<string,string>, doc_type string"
EVENTS = tuple("ingestion_complete quality_alert budget_exceeded error".split())


def scan_files(spark: SparkSession, root: str, types: tuple[str, ...] = ("md", "txt", "pdf")) -> DataFrame:
    """All files of the given types below ``root`` (any file system Spark knows), read as UTF-8; others are left out.

    A root that doesn't exist is an empty table.
    """
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], DOCUMENT)
    glob = "*.{" + ",".join(types) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    name = F.element_at(F.split("path", "/"), -1)
    text = F.expr("try_validate_utf8(cast(content as string))")
    return (
        files.select(text.alias("content"), F.col("path").alias("source"), F.create_map(F.lit("filename"), name).alias("metadata"), F.lower(F.element_at(F.split(name, r"\."), -1)).alias("doc_type"))
        .where("content is not null")
    )


def scan_sources(spark: SparkSession, sources: list[dict]) -> DataFrame:
    """The union of all configured sources; those of a type without a reader give nothing."""
    out = spark.createDataFrame([], DOCUMENT)
    for s in sources:
        types = tuple(s.get("file_types", ("md", "txt", "pdf")))
        if s["type"] == "local":
            out = out.unionByName(scan_files(spark, s["path"], types))
        elif s["type"] == "s3":
            out = out.unionByName(scan_files(spark, f"s3a://{s['bucket']}/{s.get('prefix', '')}", types))
    return out


def from_rows(df: DataFrame, content: str, source: str, doc_type: str = "text") -> DataFrame:
    return df.select(F.col(content).alias("content"), F.col(source).cast("string").alias("source"), F.create_map().cast("map<string,string>").alias("metadata"), F.lit(doc_type).alias("doc_type"))


def scan_golden(spark: SparkSession, path: str) -> DataFrame:
    """``(query, relevant_ids, expected_answer)`` of a JSON list; a missing file or another root is an error."""
    if not Path(path).exists():
        raise FileNotFoundError(path)
    if not isinstance(json.loads(Path(path).read_text("utf-8")), list):
        raise ValueError("a golden set is a list")
    return spark.read.schema("query string, relevant_ids array<string>, expected_answer string").option("multiLine", True).json(path)


def scan_audit(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; blank and malformed ones are left out."""
    result = "array<struct<chunk_id:string,source:string,score:double,content_preview:string>>"
    return spark.read.schema(f"ts timestamp, tenant_id string, query string, num_results int, results {result}").option("mode", "DROPMALFORMED").json(path)


def scan_state(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file of records; a missing or damaged one is an empty table."""
    try:
        json.loads(Path(path).read_text("utf-8"))
    except (OSError, ValueError):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def save_store(store: DataFrame, path: str) -> None:
    store.write.mode("overwrite").parquet(path)


def load_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def append_audit(records: DataFrame, path: str) -> None:
    records.write.mode("append").json(path)


def export_csv(rows: DataFrame, path: str) -> int:
    rows.write.mode("overwrite").option("header", True).csv(path)
    return rows.count()


class Webhooks:
    """Subscribers in a JSON file; called from the driver only."""

    def __init__(self, path: str) -> None:
        self._path = Path(path)

    def all(self) -> list[dict]:
        try:
            return json.loads(self._path.read_text("utf-8"))
        except (OSError, ValueError):
            return []

    def _save(self, hooks: list[dict]) -> None:
        self._path.write_text(json.dumps(hooks), "utf-8")

    def register(self, url: str, events: list[str]) -> None:
        unknown = set(events) - set(EVENTS)
        if unknown:
            raise ValueError(f"unknown events {sorted(unknown)}; known are {', '.join(EVENTS)}")
        self._save([h for h in self.all() if h["url"] != url] + [{"url": url, "events": list(events)}])

    def unregister(self, url: str) -> bool:
        hooks = self.all()
        rest = [h for h in hooks if h["url"] != url]
        self._save(rest)
        return len(rest) < len(hooks)

    def notify(self, event: str, payload: dict, timeout: float = 10) -> list[dict]:
        """Post to all subscribers of the event; one result per URL, failures included."""
        out = []
        for hook in self.all():
            if event not in hook["events"]:
                continue
            body = json.dumps({"event": event, "payload": payload}).encode()
            try:
                with urllib.request.urlopen(urllib.request.Request(hook["url"], body, {"Content-Type": "application/json"}), timeout=timeout) as reply:
                    out.append({"url": hook["url"], "success": True, "status": reply.status})
            except OSError as failure:
                out.append({"url": hook["url"], "success": False, "error": str(failure)})
        return out
