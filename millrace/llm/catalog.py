"""Queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.functions.workers import importable
from millrace.llm import bpe_codec, exact_dedup, lm_scoring, media, ngram_join, packing, secrets, suffix_dedup, token_counts, toxicity

WORDS_SQL = r"""
words AS (
  SELECT doc_id, list_filter(string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' '), lambda x: x <> '') AS ws
  FROM documents WHERE text IS NOT NULL
)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importable(spark).read.parquet(f"{sf_dir}/documents.parquet")


def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_payloads(_documents(spark, sf_dir))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(_documents(spark, sf_dir), capacity=2048)


def op3_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_codec.encode(_documents(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(_documents(spark, sf_dir))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(_documents(spark, sf_dir), n=2, theta=0.65)


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.train_and_score(_documents(spark, sf_dir))


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_passages(_documents(spark, sf_dir), min_words=50)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(_documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return toxicity.score(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_media_columns, op2_best_fit_packing, op3_bpe_codec, op4_token_counts, op5_secret_scans,
        op6_ngram_jaccard_join, op7_lm_scoring, op8_suffix_array_dedup, op9_exact_dedup, op10_toxicity,
    )
}

ORACLES = {
    "op1_media_columns": """
SELECT doc_id, CASE WHEN regexp_matches(lower(ltrim(left(text, 256))), '^(<!doctype html|<html)') THEN 'text/html' ELSE 'text/plain' END AS media_type,
  octet_length(encode(text))::BIGINT AS n_bytes, 1::INTEGER AS attempts, NULL::VARCHAR AS error, sha256(text) AS sha256, text
FROM documents WHERE text IS NOT NULL
""",
    "op8_suffix_array_dedup": rf"""
WITH {WORDS_SQL},
places AS (SELECT doc_id, ws, unnest(range(0, len(ws) - 49)) AS pos FROM words WHERE len(ws) >= 50),
stretches AS (SELECT doc_id, pos, array_to_string(ws[pos + 1:pos + 50], ' ') AS stretch FROM places),
firsts AS (
  SELECT doc_id, pos, first_value(doc_id) OVER w AS source, first_value(pos) OVER w - pos AS shift
  FROM stretches WINDOW w AS (PARTITION BY stretch ORDER BY doc_id, pos)
),
repeats AS (SELECT * FROM firsts WHERE source <> doc_id),
runs AS (
  SELECT *, CASE WHEN pos = lag(pos) OVER w + 1 AND source = lag(source) OVER w AND shift = lag(shift) OVER w THEN 0 ELSE 1 END AS new
  FROM repeats WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
),
passages AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS passage FROM runs)
SELECT doc_id, min(pos)::INTEGER AS start, count(*) + 49 AS n_words, source AS source_id, (min(pos) + shift)::INTEGER AS source_start
FROM passages GROUP BY doc_id, passage, source, shift
""",
    "op9_exact_dedup": """
SELECT doc_id, kept_id FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept_id FROM documents WHERE text IS NOT NULL) WHERE doc_id <> kept_id
""",
    "op6_ngram_jaccard_join": rf"""
WITH RECURSIVE {WORDS_SQL},
grams AS (
  SELECT DISTINCT doc_id, gram FROM (
    SELECT doc_id, unnest(CASE WHEN len(ws) >= 2 THEN list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) ELSE ws END) AS gram FROM words)
),
sets AS (SELECT doc_id, count(*) AS size FROM grams GROUP BY doc_id),
shared AS (
  SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS common FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL
),
near AS MATERIALIZED (
  SELECT doc_a, doc_b FROM shared JOIN sets x ON x.doc_id = doc_a JOIN sets y ON y.doc_id = doc_b
  WHERE common::DOUBLE / (x.size + y.size - common) >= 0.65 - 1e-12
),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, n.doc_b AS other FROM reached r JOIN near n ON n.doc_a = r.other
),
classes AS (SELECT doc_id, min(other) AS class_id FROM reached GROUP BY doc_id),
links AS (SELECT doc_a, count(*) AS n FROM near GROUP BY doc_a)
SELECT c.doc_id, c.class_id, coalesce(n, 0)::BIGINT AS n_links FROM classes c LEFT JOIN links ON doc_a = c.doc_id
""",
}
