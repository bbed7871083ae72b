"""Registered queries and the SQL that they are checked against."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.text import estimated_tokens, sentences, strip, tokens
from millrace.functions.vectors import l2_normalize, rounded
from millrace.operators import chunking, embed, evaluate, ingest, oplog, quantize, rewrite, schedule, search
from millrace.plans import inputs as i
from millrace.streaming import incremental

QUERIES: dict = {}
ORACLES: dict = {}

T = i.TOKENS.format


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql is not None:
            ORACLES[key] = sql
        return f

    return add


# vector search


def candidates(spark, d, k: int = 10, where=None, **made):
    """``made``: columns made of the store's before its rows are multiplied."""
    s = i.store(spark, d)
    return search.vector_search(s, i.queries(spark, d), k, where).join(s.select("chunk_id", "content", "source", "label", "lang").withColumns(made), "chunk_id")


def _words():
    return {"terms": search.term_text(F.col("content"))}


@query(f"WITH {i.RANKED_SQL} SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM cand")
def vector_search(spark, d):
    return candidates(spark, d).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {i.RANKED_SQL} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, chunk_id, round(score, 6) AS score FROM scored JOIN store USING (chunk_id) WHERE lang = 'en' QUALIFY rank <= 5")
def metadata_filter(spark, d):
    return candidates(spark, d, 5, search.metadata_filter(lang="en")).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


@query(f"WITH {i.STORE_SQL} SELECT chunk_id, list_transform(u, lambda x: round(x, 6)) AS unit FROM store")
def l2_normalized(spark, d):
    return i.store(spark, d).select("chunk_id", rounded(l2_normalize(F.col("embedding")), 6).alias("unit"))


# keywords and hybrid ranking


@query(f"SELECT doc_id, len({T('text')})::INT AS n, array_to_string({T('text')}, ' ') AS terms FROM documents")
def tokenize(spark, d):
    t = tokens(F.col("text"))
    return i.table(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.array_join(t, " ").alias("terms"))


@query(f"WITH {i.BM25_SQL} SELECT query_id, term, d AS df FROM df")
def doc_frequency(spark, d):
    return search.document_frequency(candidates(spark, d, terms=F.array_join(F.array_distinct(tokens(F.col("content"))), " ")), i.queries(spark, d))


@query(f"WITH {i.BM25_SQL} SELECT query_id, round(avg(n_tokens), 6) AS avg_length FROM len GROUP BY query_id")
def avg_doc_length(spark, d):
    return search.average_length(candidates(spark, d, length=F.size(tokens(F.col("content"))))).select("query_id", F.round("avg_length", 6).alias("avg_length"))


@query(f"WITH {i.BM25_SQL} SELECT query_id, chunk_id, round(bm25, 6) AS bm25 FROM bm")
def bm25_score(spark, d):
    return search.bm25(candidates(spark, d, **_words()), i.queries(spark, d)).select("query_id", "chunk_id", F.round("bm25", 6).alias("bm25"))


def _hybrid_sql(semantic: float, keyword: float) -> str:
    return f"""WITH {i.BM25_SQL},
fused AS (SELECT query_id, chunk_id, c.rank AS before, round({semantic}::DOUBLE * greatest(0.0::DOUBLE, least(1.0::DOUBLE, score)) + {keyword}::DOUBLE * bm25, 6) AS score FROM cand c JOIN bm USING (query_id, chunk_id))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before)::INT AS rank, chunk_id, score FROM fused QUALIFY rank <= 5"""


def _hybrid(method):
    def run(spark, d):
        return search.hybrid_rank(candidates(spark, d, **_words()), i.queries(spark, d), 5, *search.method_weights(method))

    return run


for _name, _method in (("hybrid_rank", "hybrid"), ("hybrid_semantic_only", "semantic"), ("hybrid_keyword_only", "keyword")):
    query(_hybrid_sql(*search.method_weights(_method)), _name)(_hybrid(_method))


# federation: the store's English part and the rest

_SPLIT = i.RANKED_SQL + """,
part AS (SELECT s.query_id, s.chunk_id, s.score, t.content, CASE WHEN lang = 'en' THEN 0 ELSE 1 END AS source_no FROM scored s JOIN store t USING (chunk_id)),
two AS (SELECT *, row_number() OVER (PARTITION BY query_id, source_no ORDER BY score DESC, chunk_id)::INT AS rank FROM part QUALIFY rank <= 10),
fused AS (SELECT query_id, chunk_id, any_value(content) AS content, min(source_no) AS first_source, min(rank) AS seen, round(sum(CASE WHEN source_no = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END / (60 + rank)), 12) AS score FROM two GROUP BY query_id, chunk_id),
single AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY query_id, regexp_replace(content, '^\\s+|\\s+$', '', 'g') ORDER BY score DESC, first_source, seen, chunk_id) = 1)""".replace("\\\\", "\\")


def _stores(spark, d):
    s = i.store(spark, d)
    return [s.where("lang = 'en'"), s.where("lang <> 'en'")]


def _fused(spark, d):
    q = i.queries(spark, d)
    return search.rrf_fuse([search.vector_search(s, q, 10).join(s.select("chunk_id", search.same_content().alias("content")), "chunk_id") for s in _stores(spark, d)], [1.0, 2.0])


@query(f"WITH {_SPLIT} SELECT query_id, chunk_id, first_source, round(score, 9) AS score FROM fused")
def rrf_fuse(spark, d):
    return _fused(spark, d).select("query_id", "chunk_id", "first_source", F.round("score", 9).alias("score"))


@query(f"WITH {_SPLIT} SELECT query_id, chunk_id, round(score, 9) AS score FROM single")
def rrf_dedup(spark, d):
    return search.rrf_dedup(_fused(spark, d)).select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query(f"WITH {_SPLIT} SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id)::INT AS rank, chunk_id, round(score, 9) AS score FROM single QUALIFY rank <= 5")
def federated_search(spark, d):
    return search.federated_search(_stores(spark, d), i.queries(spark, d), 5, [1.0, 2.0]).withColumn("score", F.round("score", 9))


@query(f"WITH {i.RANKED_SQL} SELECT query_id, rank, chunk_id FROM cand WHERE rank <= 3")
def passthrough_topk(spark, d):
    return candidates(spark, d).where("rank <= 3").select("query_id", "rank", "chunk_id")


@query(f"""WITH {_SPLIT}, first AS (SELECT query_id, source_no, chunk_id, score FROM two QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY source_no) = 1)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_no, chunk_id)::INT AS rank, chunk_id, round(score, 6) AS score FROM first QUALIFY rank <= 5""")
def multi_variant_merge(spark, d):
    q = i.queries(spark, d)
    rows = None
    for n, s in enumerate(_stores(spark, d)):
        part = search.vector_search(s, q, 10).withColumn("variant", F.lit(n))
        rows = part if rows is None else rows.unionByName(part)
    return search.merge_variants(rows, 5).withColumn("score", F.round("score", 6))


# evaluation

_EVAL = i.RANKED_SQL + i.GOLDEN_SQL + """,
hits AS (SELECT c.query_id, c.rank, c.chunk_id, CASE WHEN g.chunk_id IS NULL THEN 0 ELSE 1 END AS hit FROM cand c LEFT JOIN golden g ON c.query_id = g.query_id AND c.chunk_id = g.chunk_id),
rel AS (SELECT query_id, count(*) AS relevant FROM golden GROUP BY query_id),
found AS (SELECT query_id, sum(CASE WHEN rank <= 5 THEN hit ELSE 0 END) AS n, min(CASE WHEN hit = 1 THEN rank END) AS first FROM hits GROUP BY query_id),
ideal AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY hit DESC, rank) AS place FROM hits),
gains AS (SELECT query_id, sum(CASE WHEN rank <= 5 THEN hit / log2(rank + 1.0) ELSE 0 END) AS dcg, sum(CASE WHEN place <= 5 THEN hit / log2(place + 1.0) ELSE 0 END) AS best FROM ideal GROUP BY query_id),
per AS (SELECT query_id, coalesce(n, 0) / 5.0::DOUBLE AS precision, coalesce(n, 0)::DOUBLE / relevant AS recall, coalesce(1.0::DOUBLE / first, 0) AS mrr, coalesce(CASE WHEN best > 0 THEN dcg / best ELSE 0 END, 0) AS ndcg FROM rel LEFT JOIN found USING (query_id) LEFT JOIN gains USING (query_id))"""


def _metric(key, compute):
    @query(f"WITH {_EVAL} SELECT query_id, round({key}, 6)::DOUBLE AS {key} FROM per", {"precision": "precision_at_k", "recall": "recall_at_k", "mrr": "mrr", "ndcg": "ndcg_at_k"}[key])
    def run(spark, d):
        return compute(candidates(spark, d).select("query_id", "rank", "chunk_id"), i.golden(spark, d)).select("query_id", F.round(key, 6).alias(key))


_metric("precision", lambda r, g: evaluate.precision_at_k(r, g, 5))
_metric("recall", lambda r, g: evaluate.recall_at_k(r, g, 5))
_metric("mrr", evaluate.reciprocal_rank)
_metric("ndcg", lambda r, g: evaluate.ndcg_at_k(r, g, 5))


@query(f"WITH {_EVAL} SELECT round(avg(precision), 6)::DOUBLE AS precision, round(avg(recall), 6)::DOUBLE AS recall, round(avg(mrr), 6)::DOUBLE AS mrr, round(avg(ndcg), 6)::DOUBLE AS ndcg, count(*) AS num_queries, 5::INT AS k FROM per")
def evaluate_run(spark, d):
    return evaluate.evaluate_run(candidates(spark, d).select("query_id", "rank", "chunk_id"), i.golden(spark, d), 5)


_TURNS = "users AS (SELECT conv_id, string_agg(text, ' ' ORDER BY turn) AS q FROM conversations WHERE role = 'user' GROUP BY conv_id)"


@query(rf"""WITH {_TURNS}, sets AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(q), '\S+')) AS qs, list_distinct(regexp_extract_all(lower(text), '\S+')) AS a FROM conversations JOIN users USING (conv_id) WHERE role = 'assistant')
SELECT conv_id, turn, round(CASE WHEN len(qs) > 0 THEN len(list_intersect(qs, a))::DOUBLE / len(qs) ELSE 0 END, 6) AS relevancy FROM sets""")
def answer_relevancy(spark, d):
    c = i.table(spark, d, "conversations")
    q = c.where("role = 'user'").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]), " ").alias("q"))
    return c.where("role = 'assistant'").join(q, "conv_id").select("conv_id", "turn", F.round(evaluate.answer_relevancy(F.col("q"), F.col("text")), 6).alias("relevancy"))


@query(f"""WITH {i.EVENTS_SQL},
b AS (SELECT event_type AS metric, round(avg(value), 6) AS baseline_value FROM ev WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1),
c AS (SELECT event_type AS metric, round(avg(value) * CASE WHEN event_type = 'view' THEN 0.8::DOUBLE ELSE 1.0::DOUBLE END, 6) AS current_value FROM ev WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY 1, event_type)
SELECT metric, baseline_value, current_value, round(CASE WHEN baseline_value > 0 THEN (baseline_value - current_value) / baseline_value ELSE 0 END, 6) AS drop, CASE WHEN baseline_value > 0 THEN (baseline_value - current_value) / baseline_value ELSE 0 END >= 0.10 AS is_drifted FROM b JOIN c USING (metric)""")
def check_drift(spark, d):
    return evaluate.check_drift(i.baseline(spark, d), i.current(spark, d)).withColumn("drop", F.round("drop", 6))


# ingestion


@query("SELECT doc_id, sha256(text) AS hash FROM documents")
def content_hash(spark, d):
    return i.table(spark, d, "documents").select("doc_id", ingest.content_hash(F.col("text")).alias("hash"))


def _state(spark, d):
    """What was ingested before: the French documents are unknown, the German ones were different."""
    docs = i.documents(spark, d)
    return docs.where("lang <> 'fr'").select("source", ingest.content_hash(F.when(F.col("lang") == "de", F.concat("content", F.lit("x"))).otherwise(F.col("content"))).alias("hash"), "doc_type")


@query(f"WITH {i.DOCUMENTS_SQL} SELECT doc_id, source FROM docs WHERE lang IN ('fr', 'de')")
def filter_changed(spark, d):
    return ingest.filter_changed(i.documents(spark, d), _state(spark, d)).select("doc_id", "source")


@query(f"WITH {i.DOCUMENTS_SQL} SELECT source, sha256(content) AS hash, doc_type FROM docs")
def mark_ingested(spark, d):
    return ingest.mark_ingested(_state(spark, d), i.documents(spark, d), F.col("doc_id"))


@query(f"WITH {i.DOCUMENTS_SQL} SELECT source FROM docs WHERE lang NOT IN ('fr', 'es')")
def tracker_remove(spark, d):
    return ingest.forget(_state(spark, d), i.documents(spark, d).where("lang = 'es'")).select("source")


@query(f"WITH {i.DOCUMENTS_SQL} SELECT count(*) AS tracked FROM docs WHERE lang <> 'fr'")
def tracked_count(spark, d):
    return ingest.tracked(_state(spark, d))


@query(f"WITH {i.STORE_SQL} SELECT chunk_id, list_transform(CASE WHEN lang = 'en' THEN list_transform(u, lambda x: x) ELSE v END, lambda x: round(x, 6)) AS embedding, lang FROM store")
def upsert(spark, d):
    s = i.store(spark, d).select("chunk_id", "embedding", "lang")
    new = s.where("lang = 'en'").withColumn("embedding", F.transform("embedding", lambda x: x * 3))
    out = ingest.upsert(s, new, F.col("chunk_id"))
    return out.select("chunk_id", rounded(F.col("embedding"), 6).alias("embedding"), "lang")


@query(f"WITH {i.STORE_SQL} SELECT chunk_id, lang FROM store WHERE lang <> 'en'")
def delete(spark, d):
    s = i.store(spark, d).select("chunk_id", "lang")
    return ingest.delete(s, s.where("lang = 'en'"))


@query(r"SELECT doc_id, floor(len(regexp_extract_all(text, '\S+')) * 1.3::DOUBLE)::BIGINT AS tokens FROM documents")
def token_estimate(spark, d):
    return i.table(spark, d, "documents").select("doc_id", estimated_tokens(F.col("text")).alias("tokens"))


@query(f"WITH {i.DOCUMENTS_SQL} SELECT doc_id, origin AS source, ((row_number() OVER (PARTITION BY origin ORDER BY doc_id) - 1) // 100)::BIGINT AS batch_no FROM docs")
def batching(spark, d):
    rows = i.documents(spark, d).select("doc_id", F.col("origin").alias("source"))
    return ingest.batches(rows, 100, ("source", "doc_id"))


@query(f"WITH {i.DOCUMENTS_SQL} SELECT count(*) AS documents_changed, (SELECT count(*) FROM docs) - count(*) AS documents_skipped, 0::BIGINT AS errors FROM docs WHERE lang IN ('fr', 'de')")
def ingest_incremental(spark, d):
    return ingest.ingest_incremental(i.documents(spark, d), _state(spark, d)).select("documents_changed", "documents_skipped", "errors")


# chunking


def _chunks(name, column, source=i.documents, key="doc_id", sql=None):
    def run(spark, d):
        rows = source(spark, d).select(key, F.posexplode(column()).alias("pos", "c"))
        return rows.select(key, "pos", F.col("c.content").alias("content"), F.col("c.start_index").alias("start_index"), F.col("c.end_index").alias("end_index"))

    query(sql, name)(run)


def _fold(parts: str, glue: str, size: int) -> str:
    """Greedy packing in SQL, as a fold over structs; a part that is too long stands alone."""
    cand = f"(CASE WHEN acc.o = '' THEN x.o ELSE acc.o || '{glue}' || x.o END)"
    closed = "(CASE WHEN acc.o = '' THEN acc.d ELSE list_append(acc.d, acc.o) END)"
    fold = f"""list_reduce(list_transform({parts}, lambda p: {{'d': []::VARCHAR[], 'o': p}}), lambda acc, x:
      CASE WHEN length({cand}) <= {size} THEN {{'d': acc.d, 'o': {cand}}}
           WHEN length(x.o) > {size} THEN {{'d': list_append({closed}, x.o), 'o': ''}}
           ELSE {{'d': {closed}, 'o': x.o}} END, {{'d': []::VARCHAR[], 'o': ''}})"""
    return f"(SELECT CASE WHEN r.o = '' THEN r.d ELSE list_append(r.d, r.o) END FROM (SELECT {fold} AS r))"


_LEVELS = (("chr(10) || chr(10)", "\n\n"), ("chr(10)", "\n"), ("'. '", ". "), ("' '", " "))


def _recursive_sql(size: int) -> str:
    """Level by level: pieces that are too long are split at the next separator and packed."""
    steps, last = ["l0 AS (SELECT doc_id, [0] AS path, text AS piece FROM documents WHERE length(text) > 0)"], "l0"
    for n, (separator, glue) in enumerate(_LEVELS, 1):
        packed = _fold(f"string_split(piece, {separator})", glue, size)
        steps.append(
            f"s{n} AS (SELECT doc_id, path, CASE WHEN length(piece) <= {size} THEN [piece] ELSE {packed} END AS pieces FROM {last}), "
            f"l{n} AS (SELECT doc_id, list_append(path, p) AS path, pieces[p] AS piece FROM (SELECT *, unnest(range(1, len(pieces) + 1)) AS p FROM s{n}))"
        )
        last = f"l{n}"
    steps.append(f"cut AS (SELECT doc_id, list_append(path, c) AS path, substr(piece, c * {size} + 1, {size}) AS piece FROM (SELECT *, unnest(range(0, (length(piece) - 1) // {size} + 1)) AS c FROM {last}))")
    return "WITH " + ",\n".join(steps) + ",\npieces AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY path) - 1)::INT AS pos, piece AS content FROM cut)\n"


@query(_recursive_sql(200) + "SELECT * FROM pieces")
def chunk_recursive_pieces(spark, d):
    return i.table(spark, d, "documents").select("doc_id", F.posexplode(chunking.recursive_pieces(F.col("text"), 200)).alias("pos", "content"))


_OFFSETS = """, lapped AS (SELECT doc_id, pos, CASE WHEN pos = 0 THEN content ELSE substr(right(lag(content) OVER (PARTITION BY doc_id ORDER BY pos), 50) || content, 1, 512) END AS content FROM pieces),
grouped AS (SELECT doc_id, text, list({'c': 0::BIGINT, 's': []::BIGINT[], 'p': content} ORDER BY pos) AS l FROM lapped JOIN documents USING (doc_id) GROUP BY ALL),
found AS (SELECT doc_id, l, list_reduce(l, lambda acc, x: {
    'c': (CASE WHEN instr(substr(text, greatest(0, acc.c - 50) + 1), x.p) > 0 THEN greatest(0, acc.c - 50) + instr(substr(text, greatest(0, acc.c - 50) + 1), x.p) - 1 ELSE acc.c END + length(x.p))::BIGINT,
    's': list_append(acc.s, (CASE WHEN instr(substr(text, greatest(0, acc.c - 50) + 1), x.p) > 0 THEN greatest(0, acc.c - 50) + instr(substr(text, greatest(0, acc.c - 50) + 1), x.p) - 1 ELSE acc.c END)::BIGINT),
    'p': x.p}, {'c': 0::BIGINT, 's': []::BIGINT[], 'p': ''}) AS r FROM grouped)
SELECT doc_id, (k - 1)::INT AS pos, l[k].p AS content, r.s[k]::INT AS start_index, (r.s[k] + length(l[k].p))::INT AS end_index FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM found)"""
_chunks("chunk_recursive", lambda: chunking.chunk_recursive(F.col("content"), 512, 50), sql=_recursive_sql(512).rstrip() + _OFFSETS)
_chunks("chunk_semantic", lambda: chunking.chunk_semantic(F.col("content"), 512, 50), i.markdown, "doc_key")
_chunks("chunk_code", lambda: chunking.chunk_code(F.regexp_replace("content", r"(?m)^([A-Z]\w+) ", "def $1 "), F.col("source"), 512))
_PACKED = rf"""WITH s AS (SELECT doc_id, p, l[p] AS sentence FROM (SELECT *, unnest(range(1, len(l) + 1)) AS p FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) AS l FROM documents))),
w AS (SELECT doc_id, p, sentence, CASE WHEN length(sentence) > 512 THEN {_fold(r"regexp_extract_all(sentence, '\S+')", " ", 512)} ELSE []::VARCHAR[] END AS ws FROM s),
g AS (SELECT doc_id, list({{'d': []::VARCHAR[], 'o': sentence, 'w': ws}} ORDER BY p) AS l FROM w GROUP BY doc_id),
f AS (SELECT doc_id, list_reduce(l, lambda acc, x: CASE
  WHEN length(CASE WHEN acc.o = '' THEN x.o ELSE acc.o || ' ' || x.o END) <= 512 THEN {{'d': acc.d, 'o': CASE WHEN acc.o = '' THEN x.o ELSE acc.o || ' ' || x.o END, 'w': x.w}}
  WHEN length(x.o) > 512 THEN {{'d': list_concat(CASE WHEN acc.o = '' THEN acc.d ELSE list_append(acc.d, acc.o) END, x.w[:len(x.w) - 1]), 'o': coalesce(x.w[len(x.w)], ''), 'w': x.w}}
  ELSE {{'d': CASE WHEN acc.o = '' THEN acc.d ELSE list_append(acc.d, acc.o) END, 'o': x.o, 'w': x.w}} END, {{'d': []::VARCHAR[], 'o': '', 'w': []::VARCHAR[]}}) AS r FROM g),
c AS (SELECT doc_id, CASE WHEN r.o = '' THEN r.d ELSE list_append(r.d, r.o) END AS l FROM f)
SELECT doc_id, (k - 1)::INT AS pos, l[k] AS content FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM c)"""
query(_PACKED, "chunk_sentence_pack")(lambda spark, d: i.table(spark, d, "documents").select("doc_id", F.posexplode(chunking.sentence_pieces(F.col("text"), 512)).alias("pos", "content")))
query(name="chunk_hierarchical_parents")(lambda spark, d: chunking.chunk_hierarchical(i.markdown(spark, d)).where("chunk_type = 'parent'"))
query(name="chunk_hierarchical_children")(lambda spark, d: chunking.chunk_hierarchical(i.markdown(spark, d)).where("chunk_type = 'child'"))


@query(f"""WITH {i.DOCUMENTS_SQL}, l AS (SELECT doc_id, string_split(content, chr(10)) AS ls FROM docs)
SELECT doc_id, (p - 1)::INT AS pos, CASE WHEN p = 1 THEN ls[1] ELSE substr(right(ls[p - 1], 20) || ls[p], 1, 200) END AS content FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS p FROM l)""")
def chunk_overlap(spark, d):
    return i.documents(spark, d).select("doc_id", F.posexplode(chunking.with_overlap(F.split("content", "\n", -1), 200, 20)).alias("pos", "content"))


@query(f"""WITH {i.DOCUMENTS_SQL} SELECT doc_id, CASE doc_type WHEN 'md' THEN 'semantic' WHEN 'py' THEN 'code_aware' WHEN 'csv' THEN 'table' ELSE 'recursive' END AS strategy FROM docs""")
def chunk_registry(spark, d):
    return i.documents(spark, d).select("doc_id", chunking.strategy_for(F.col("doc_type")).alias("strategy"))


@query(f"WITH {i.DOCUMENTS_SQL} SELECT doc_id, doc_type AS language FROM (SELECT doc_id, CASE WHEN doc_type = 'py' THEN 'py' ELSE 'js' END AS doc_type FROM docs)")
def chunk_code_lang(spark, d):
    return i.documents(spark, d).select("doc_id", chunking.code_language(F.col("source"), "js").alias("language"))


_CSV = """csv AS (SELECT l_orderkey AS doc_key, 'line,part,supplier,quantity' || chr(10) || string_agg(l_linenumber || ',' || l_partkey || ',' || l_suppkey || ',' || l_quantity::INT, chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS content FROM lineitem GROUP BY l_orderkey)"""
_CSV_ROWS = rf"""{_CSV}, ls AS (SELECT doc_key, string_split(regexp_replace(content, '^\s+|\s+$', '', 'g'), chr(10)) AS l FROM csv),
n AS (SELECT doc_key, l[1] AS header, l[2:] AS rows, least(20, greatest(1, floor((60 - length(l[1]) - 1) / (list_sum(list_transform(l[2:11], lambda x: length(x) + 1))::DOUBLE / len(l[2:11])))::INT))::INT AS per FROM ls)"""


def _csv(spark, d):
    row = F.concat_ws(",", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))
    rows = i.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_key")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", row.alias("row")))).alias("r"))
    return rows.select("doc_key", F.concat(F.lit("line,part,supplier,quantity\n"), F.array_join(F.transform("r", lambda x: x["row"]), "\n")).alias("content"))


@query(f"""WITH {_CSV_ROWS} SELECT doc_key, p::INT AS pos, header || chr(10) || array_to_string(rows[p * per + 1:p * per + per], chr(10)) AS content, (p * per)::INT AS row_start, least(p * per + per, len(rows))::INT AS row_end, 4::INT AS column_count
FROM (SELECT *, unnest(range(0, (len(rows) - 1) // per + 1)) AS p FROM n)""")
def chunk_table(spark, d):
    return chunking.chunk_table(_csv(spark, d), size=60).select("doc_key", "pos", "content", "row_start", "row_end", "column_count")


@query(f"WITH {_CSV_ROWS} SELECT doc_key, per AS rows_per_chunk FROM n")
def chunk_table_rows(spark, d):
    lines = F.split(strip(F.col("content")), "\n", -1)
    return _csv(spark, d).select("doc_key", chunking.table_rows_per_chunk(F.get(lines, F.lit(0)), F.slice(lines, F.lit(2), F.size(lines)), 60).alias("rows_per_chunk"))


@query(rf"""WITH {i.MARKDOWN_SQL}, t AS (SELECT doc_key, content, list_filter(list_transform(string_split(content, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1] AS line FROM md)
SELECT doc_key, coalesce(nullif(regexp_replace(regexp_extract(content, '(?m)^#{{1,6}}\s+(.+)$', 1), '^\s+|\s+$', '', 'g'), ''), CASE WHEN length(line) > 100 THEN left(line, 100) || '...' ELSE line END) AS title FROM t""")
def enrich_title(spark, d):
    return i.markdown(spark, d).select("doc_key", chunking.title(F.col("content")).alias("title"))


_DATED = "dated AS (SELECT o_custkey AS doc_key, string_agg(CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y/%m/%d') ELSE strftime(o_orderdate, '%d-%m-%Y') END, ' on ' ORDER BY o_orderkey) AS content FROM orders GROUP BY o_custkey)"


@query(rf"""WITH {_DATED}, f AS (SELECT doc_key, list_concat(list_concat(regexp_extract_all(content, '\b\d{{4}}-\d{{2}}-\d{{2}}\b'), regexp_extract_all(content, '\b\d{{4}}/\d{{2}}/\d{{2}}\b')), regexp_extract_all(content, '\b\d{{2}}-\d{{2}}-\d{{4}}\b')) AS l FROM dated)
SELECT doc_key, array_to_string(list_filter(l, lambda x, n: list_position(l, x) = n), ' ') AS dates FROM f""")
def enrich_dates(spark, d):
    o = i.table(spark, d, "orders")
    day = F.expr("case o_orderkey % 3 when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, 'yyyy/MM/dd') else date_format(o_orderdate, 'dd-MM-yyyy') end")
    rows = o.groupBy(F.col("o_custkey").alias("doc_key")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", day.alias("day")))), lambda x: x["day"]), " on ").alias("content"))
    return rows.select("doc_key", F.array_join(chunking.dates(F.col("content")), " ").alias("dates"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '[\p{L}\p{N}_]+'))::INT AS word_count FROM documents")
def enrich_word_count(spark, d):
    return i.table(spark, d, "documents").select("doc_id", chunking.word_count(F.col("text")).alias("word_count"))


# embedding


@query()
def embed_local(spark, d):
    return embed.embed_local(i.table(spark, d, "benchmark").select("item_id", F.col("text").alias("content")), "content", 64).select("item_id", "embedding")


@query()
def ingest_end_to_end(spark, d):
    docs = i.documents(spark, d)
    return embed.embed_local(ingest.ingest_chunks(docs).select("source", "pos", "chunk_id", "content", "word_count"), "content", 32).select("source", "pos", "chunk_id", "word_count", "embedding")


# rewriting

_QUESTIONS = "q AS (SELECT conv_id, turn, text || ' How to fix an API error and run fast SQL?' AS query FROM conversations WHERE role = 'user')"


def _questions(spark, d):
    return i.table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat("text", F.lit(" How to fix an API error and run fast SQL?")).alias("query"))


def _values(table: dict) -> str:
    rows = [(w, n, s) for w, v in table.items() for n, s in enumerate(v if isinstance(v, list) else [v])]
    return "(VALUES " + ", ".join(f"('{w}', {n}, '{s}')" for w, n, s in rows) + ") AS t(word, n, sub)"


def _expand_sql() -> str:
    part = r"""SELECT conv_id, turn, {k} AS k, p, n, array_to_string(list_transform(ws, lambda x, j: CASE WHEN j = p THEN sub ELSE x END), ' ') AS variant FROM e JOIN {values} ON regexp_replace(ws[p], '[^\p{{L}}\p{{N}}_]', '', 'g') = word"""
    return rf"""WITH {_QUESTIONS}, w AS (SELECT *, regexp_extract_all(lower(query), '\S+') AS ws FROM q), e AS (SELECT *, unnest(range(1, len(ws) + 1)) AS p FROM w),
l AS (SELECT conv_id, turn, string_split(regexp_replace(query, '(?i)\s+(?:and|or)\s+', chr(1), 'g'), chr(1)) AS ps FROM q),
a AS (SELECT conv_id, turn, 0 AS k, 0 AS p, 0 AS n, query AS variant FROM q
  UNION ALL {part.format(k=1, values=_values(rewrite.SYNONYMS))}
  UNION ALL {part.format(k=2, values=_values(rewrite.ACRONYMS))}
  UNION ALL SELECT conv_id, turn, 3, p, 0, regexp_replace(ps[p], '^\s+|\s+$', '', 'g') FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS p FROM l) WHERE len(ps) > 1),
o AS (SELECT conv_id, turn, variant, min(k * 1000000 + p * 1000 + n) AS place FROM a WHERE variant <> '' OR k = 0 GROUP BY ALL)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY place) - 1)::INT AS variant_idx, variant FROM o"""


def _variants_sql(table: dict) -> str:
    return rf"""WITH {_QUESTIONS}, w AS (SELECT *, regexp_extract_all(lower(query), '\S+') AS ws FROM q), e AS (SELECT *, unnest(range(1, len(ws) + 1)) AS p FROM w),
v AS (SELECT conv_id, turn, p, n, array_to_string(list_transform(ws, lambda x, j: CASE WHEN j = p THEN sub ELSE x END), ' ') AS variant FROM e JOIN {_values(table)} ON regexp_replace(ws[p], '[^\p{{L}}\p{{N}}_]', '', 'g') = word),
a AS (SELECT conv_id, turn, 0 AS p, 0 AS n, query AS variant FROM q UNION ALL SELECT * FROM v),
o AS (SELECT conv_id, turn, variant, min(p * 1000 + n) AS place FROM a GROUP BY ALL)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY place) - 1)::INT AS variant_idx, variant FROM o"""


@query(_variants_sql(rewrite.SYNONYMS))
def expand_synonyms(spark, d):
    return _questions(spark, d).select("conv_id", "turn", F.posexplode(rewrite.expand_synonyms(F.col("query"))).alias("variant_idx", "variant"))


@query(_variants_sql(rewrite.ACRONYMS))
def expand_acronyms(spark, d):
    return _questions(spark, d).select("conv_id", "turn", F.posexplode(rewrite.expand_acronyms(F.col("query"))).alias("variant_idx", "variant"))


@query(rf"""WITH {_QUESTIONS}, l AS (SELECT conv_id, turn, query, string_split(regexp_replace(query, '(?i)\s+(?:and|or)\s+', chr(1), 'g'), chr(1)) AS ps FROM q),
a AS (SELECT conv_id, turn, 0 AS p, query AS variant FROM l UNION ALL SELECT conv_id, turn, p, regexp_replace(ps[p], '^\s+|\s+$', '', 'g') FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS p FROM l) WHERE len(ps) > 1),
o AS (SELECT conv_id, turn, variant, min(p) AS place FROM a WHERE variant <> '' OR p = 0 GROUP BY ALL)
SELECT conv_id, turn, (row_number() OVER (PARTITION BY conv_id, turn ORDER BY place) - 1)::INT AS variant_idx, variant FROM o""")
def sub_queries(spark, d):
    return _questions(spark, d).select("conv_id", "turn", F.posexplode(rewrite.sub_queries(F.col("query"))).alias("variant_idx", "variant"))


@query(_expand_sql())
def expand(spark, d):
    return _questions(spark, d).select("conv_id", "turn", F.posexplode(rewrite.expand(F.col("query"))).alias("variant_idx", "variant"))


_COMPLEX = rf"""{_QUESTIONS}, w AS (SELECT *, regexp_extract_all(query, '\S+') AS ws FROM q),
c AS (SELECT conv_id, turn, greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.3::DOUBLE * least(len(ws) / 20.0::DOUBLE, 1.0::DOUBLE) + 0.2::DOUBLE * CASE WHEN contains(query, '?') THEN 1 ELSE 0 END
  + 0.2::DOUBLE * (length(regexp_replace(query, '[\p{{L}}\p{{N}}\s]', '', 'g'))::DOUBLE / length(query)) + 0.3::DOUBLE * least(list_sum(list_transform(ws, lambda x: length(x)))::DOUBLE / len(ws) / 10.0::DOUBLE, 1.0::DOUBLE))) AS complexity FROM w)"""


@query(f"WITH {_COMPLEX} SELECT conv_id, turn, round(complexity, 6) AS complexity FROM c")
def route_complexity(spark, d):
    return _questions(spark, d).select("conv_id", "turn", F.round(rewrite.complexity(F.col("query")), 6).alias("complexity"))


@query(f"WITH {_COMPLEX} SELECT conv_id, turn, CASE WHEN complexity < 0.7 THEN 'lite' ELSE 'full' END AS model FROM c")
def route_model(spark, d):
    return _questions(spark, d).select("conv_id", "turn", rewrite.route(F.col("query"), threshold=0.7).alias("model"))


@query(f"WITH {_COMPLEX} SELECT conv_id, turn, CASE WHEN complexity < 0.7 THEN 'lite' ELSE 'full' END AS model, round(complexity, 6) AS complexity FROM c")
def route_details(spark, d):
    return _questions(spark, d).select("conv_id", "turn", rewrite.route_details(F.col("query"), threshold=0.7).alias("r")).select("conv_id", "turn", "r.model", "r.complexity")


# compression

_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace({}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')"


@query(f"SELECT doc_id, (p - 1)::INT AS pos, s[p] AS sentence FROM (SELECT *, unnest(range(1, len(s) + 1)) AS p FROM (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents))")
def split_sentences(spark, d):
    return i.table(spark, d, "documents").select("doc_id", F.posexplode(sentences(F.col("text"))).alias("pos", "sentence"))


_SCORED = rf"""{_TURNS}, c AS (SELECT conv_id, turn, text FROM conversations WHERE role <> 'user'),
e AS (SELECT conv_id, turn, p, s[p] AS sentence FROM (SELECT *, unnest(range(1, len(s) + 1)) AS p FROM (SELECT conv_id, turn, {_SENTENCES.format('text')} AS s FROM c))),
t AS (SELECT e.*, list_distinct({T('q')}) AS qs, list_distinct({T('sentence')}) AS ss, len(regexp_extract_all(sentence, '\S+')) AS n FROM e JOIN users USING (conv_id)),
scored AS (SELECT *, round(CASE WHEN len(qs) > 0 AND len(ss) > 0 THEN 0.7::DOUBLE * len(list_intersect(qs, ss)) / len(qs) + 0.3::DOUBLE * len(list_intersect(qs, ss)) / len(ss) ELSE 0 END, 9) AS score FROM t)"""


def _turns(spark, d):
    c = i.table(spark, d, "conversations")
    q = c.where("role = 'user'").groupBy(F.col("conv_id").alias("query_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r["text"]), " ").alias("query"))
    return c.where("role <> 'user'").select(F.col("conv_id").alias("query_id"), F.col("turn").alias("chunk_no"), F.col("text").alias("content")), q


@query(f"WITH {_SCORED} SELECT conv_id, turn, (p - 1)::INT AS pos, round(score, 6) AS score FROM scored")
def score_sentence(spark, d):
    chunks, q = _turns(spark, d)
    each = chunks.join(q, "query_id").select(F.col("query_id").alias("conv_id"), F.col("chunk_no").alias("turn"), F.array_distinct(tokens(F.col("query"))).alias("terms"), F.posexplode(sentences(F.col("content"))).alias("pos", "s"))
    return each.select("conv_id", "turn", "pos", F.round(F.round(rewrite.sentence_score(F.col("terms"), F.col("s")), 9), 6).alias("score"))


@query(rf"""WITH {_SCORED}, k AS (SELECT *, row_number() OVER o AS place, sum(n) OVER (o ROWS UNBOUNDED PRECEDING) AS so_far FROM scored WHERE score >= 0.1 WINDOW o AS (PARTITION BY conv_id ORDER BY score DESC, turn, p)),
x AS (SELECT conv_id, string_agg(sentence, ' ' ORDER BY place) AS text, count(*) AS kept, sum(n) AS kw FROM k WHERE so_far <= 46 GROUP BY conv_id),
w AS (SELECT conv_id, count(*) AS chunks, sum(len(regexp_extract_all(text, '\S+'))) AS words FROM c WHERE conv_id IN (SELECT conv_id FROM users) GROUP BY conv_id), tt AS (SELECT conv_id, count(*) AS total FROM scored GROUP BY conv_id)
SELECT conv_id AS query_id, coalesce(text, '') AS text, chunks AS original_chunks, coalesce(kept, 0) AS sentences_kept, coalesce(total, 0) AS sentences_total, CASE WHEN words > 0 THEN round(1 - coalesce(kw, 0)::DOUBLE / words, 3) ELSE 0.0::DOUBLE END AS compression_ratio
FROM w LEFT JOIN tt USING (conv_id) LEFT JOIN x USING (conv_id)""")
def compress(spark, d):
    chunks, q = _turns(spark, d)
    return rewrite.compress(chunks.join(q.select("query_id"), "query_id", "left_semi"), q, max_tokens=60)


# quantisation

_INT8 = """lim AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_min(embedding::DOUBLE[]) AS lo, list_max(embedding::DOUBLE[]) AS hi FROM embeddings),
q AS (SELECT vec_id, lo, (hi - lo) / 255.0::DOUBLE AS scale, list_transform(v, lambda x: greatest(-128, least(127, round_even((x - lo) / ((hi - lo) / 255.0::DOUBLE), 0)::INT - 128))) AS codes FROM lim)"""


@query(f"WITH {_INT8} SELECT vec_id, array_to_string(codes, ' ') AS codes, round(scale, 9) AS scale, round(lo, 9) AS lowest FROM q")
def quantize_int8(spark, d):
    return i.table(spark, d, "embeddings").select("vec_id", quantize.quantize(F.col("embedding"), "int8").alias("q")).select("vec_id", F.array_join(F.col("q.codes").cast("array<string>"), " ").alias("codes"), F.round("q.scale", 9).alias("scale"), F.round("q.offset", 9).alias("lowest"))


@query(f"WITH {_INT8} SELECT vec_id, list_transform(codes, lambda x: round((x + 128) * scale + lo, 6)) AS v FROM q")
def dequantize_int8(spark, d):
    q = i.table(spark, d, "embeddings").select("vec_id", quantize.quantize_int8(F.col("embedding")).alias("q"))
    return q.select("vec_id", rounded(quantize.dequantize_int8(F.col("q")), 6).alias("v"))


@query("""SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN x = 0 THEN x ELSE sign(x) * round_even(abs(x) / pow(2.0, greatest(floor(log2(abs(x))), -14) - 10), 0) * pow(2.0, greatest(floor(log2(abs(x))), -14) - 10) END) AS v FROM embeddings""")
def quantize_float16(spark, d):
    return i.table(spark, d, "embeddings").select("vec_id", quantize.quantize(F.col("embedding"), "float16").alias("v"))


@query("""WITH n AS (SELECT label, count(*) AS n, max(len(embedding)) AS dims FROM embeddings GROUP BY label)
SELECT label, (4 * n * dims)::BIGINT AS original_bytes, (n * (dims + 8))::BIGINT AS quantized_bytes, round((1 - (n * (dims + 8))::DOUBLE / (4 * n * dims)) * 100, 1) AS savings_percent FROM n""")
def estimate_savings(spark, d):
    n = i.table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dims"))
    return n.select("label", quantize.estimate_savings(F.col("n"), F.col("dims"), "int8").alias("s")).select("label", "s.*")


# query analytics and feedback


@query(f"WITH {i.LOG_SQL} SELECT count(*) AS total_queries, round(avg(latency_ms), 2) AS avg_latency_ms, count(*) FILTER (num_results = 0) AS zero_result_count, count(*) FILTER (max_score < 0.5 AND num_results > 0) AS low_confidence_count FROM log")
def analytics_summary(spark, d):
    return oplog.analytics_summary(i.query_log(spark, d))


@query(f"WITH {i.LOG_SQL} SELECT source, count(*) AS queries FROM (SELECT unnest(list_distinct(sources)) AS source FROM log) GROUP BY source")
def queries_per_source(spark, d):
    return oplog.queries_per_source(i.query_log(spark, d))


@query(f"WITH {i.LOG_SQL} SELECT query, latency_ms FROM log WHERE num_results = 0")
def zero_result_queries(spark, d):
    return oplog.zero_results(i.query_log(spark, d)).select("query", "latency_ms")


@query(f"WITH {i.LOG_SQL} SELECT query, num_results, round(max_score, 6) AS max_score FROM log WHERE max_score < 0.3 AND num_results > 0")
def low_confidence_queries(spark, d):
    return oplog.low_confidence(i.query_log(spark, d), 0.3).select("query", "num_results", F.round("max_score", 6).alias("max_score"))


@query(f"WITH {i.LOG_SQL}, n AS (SELECT query, count(*) AS n, min(ts) AS first_seen FROM log GROUP BY query) SELECT query, n FROM n ORDER BY n DESC, first_seen, query")
def query_frequency(spark, d):
    return oplog.query_frequency(i.query_log(spark, d)).select("query", "n")


@query(f"""WITH {i.RANKED_SQL}, f AS (SELECT query_id, count(*) AS num_results, greatest(0.0::DOUBLE, max(score)) AS max_score, array_to_string(list_distinct_ordered, ',') AS sources FROM (SELECT query_id, score, list_filter(list(source) OVER w, lambda x, n: list_position(list(source) OVER w, x) = n) AS list_distinct_ordered FROM cand WINDOW w AS (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY query_id, list_distinct_ordered)
SELECT query_id, num_results, round(max_score, 6) AS max_score, sources FROM f""".replace("list_filter(list(source) OVER w, lambda x, n: list_position(list(source) OVER w, x) = n) AS list_distinct_ordered", "list(source) OVER w AS all_sources").replace("SELECT query_id, count(*) AS num_results, greatest(0.0::DOUBLE, max(score)) AS max_score, array_to_string(list_distinct_ordered, ',') AS sources", "SELECT query_id, count(*) AS num_results, greatest(0.0::DOUBLE, max(score)) AS max_score, array_to_string(list_filter(all_sources, lambda x, n: list_position(all_sources, x) = n), ',') AS sources").replace("GROUP BY query_id, list_distinct_ordered", "GROUP BY query_id, all_sources"))
def record_query(spark, d):
    q = i.queries(spark, d).select("query_id", F.col("query_id").alias("query"), F.lit(1.0).alias("latency_ms"), F.lit(i.AS_OF).cast("timestamp").alias("ts"))
    return oplog.record_queries(candidates(spark, d), q).select(F.col("query").alias("query_id"), F.col("num_results"), F.round("max_score", 6).alias("max_score"), F.array_join("sources", ",").alias("sources"))


@query(f"WITH {i.EVENTS_SQL} SELECT DISTINCT user_id AS chunk_id FROM ev WHERE event_type = 'purchase'")
def positive_chunks(spark, d):
    return oplog.positive_chunks(i.feedback(spark, d))


@query(f"WITH {i.EVENTS_SQL} SELECT user_id AS chunk_id, event_type = 'purchase' AS relevant, k FROM ev WHERE event_type = 'click'")
def feedback_for_query(spark, d):
    return i.feedback(spark, d).where("query = 'click'").select("chunk_id", "relevant", "k")


@query(f"""WITH {i.RANKED_SQL}, {i.EVENTS_SQL}, liked AS (SELECT DISTINCT user_id AS chunk_id FROM ev WHERE event_type = 'purchase' AND k > 50),
b AS (SELECT query_id, c.rank AS before, c.chunk_id, round(score + CASE WHEN l.chunk_id IS NULL THEN 0 ELSE 0.1::DOUBLE END, 9) AS score FROM cand c LEFT JOIN liked l ON c.chunk_id = l.chunk_id)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before)::INT AS rank, chunk_id, round(score, 6) AS score FROM b""")
def feedback_boost(spark, d):
    f = i.feedback(spark, d).withColumn("relevant", F.col("relevant") & (F.col("k") > 50))
    return oplog.feedback_boost(candidates(spark, d).select("query_id", "rank", "chunk_id", "score"), f).withColumn("score", F.round("score", 6))


# costs and budgets


@query("""WITH m AS (SELECT unnest(['titan-embed-v2', 'aws/titan-embed-v2', 'local/dev', 'unknown', 'x/y/cohere-embed-english']) AS model)
SELECT model, CASE WHEN string_split(model, '/')[-1] = 'dev' THEN 0.0::DOUBLE ELSE 0.0001::DOUBLE END AS price FROM m""")
def price_lookup(spark, d):
    m = spark.createDataFrame([(x,) for x in ("titan-embed-v2", "aws/titan-embed-v2", "local/dev", "unknown", "x/y/cohere-embed-english")], "model string")
    return m.select("model", oplog.price(F.col("model")).alias("price"))


@query(r"SELECT doc_id, round(floor(len(regexp_extract_all(text, '\S+')) * 1.3::DOUBLE) / 1000.0::DOUBLE * 0.0001::DOUBLE, 9) AS cost FROM documents")
def cost_embedding(spark, d):
    return i.table(spark, d, "documents").select("doc_id", F.round(oplog.embedding_cost(estimated_tokens(F.col("text")), F.lit("titan-embed-v2")), 9).alias("cost"))


@query("SELECT label, round(count(*) * max(len(embedding)) * 4.0::DOUBLE / 1073741824 * 0.25::DOUBLE, 12) AS cost FROM embeddings GROUP BY label")
def cost_storage(spark, d):
    n = i.table(spark, d, "embeddings").groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("embedding")).alias("dims"))
    return n.select("label", F.round(oplog.storage_cost(F.col("n"), F.col("dims")), 12).alias("cost"))


@query(r"SELECT item_id, round(floor(len(regexp_extract_all(text, '\S+')) * 1.3::DOUBLE) / 1000.0::DOUBLE * 0.0001::DOUBLE, 9) AS cost FROM benchmark")
def cost_retrieval(spark, d):
    return i.table(spark, d, "benchmark").select("item_id", F.round(oplog.retrieval_cost(F.col("text"), F.lit("titan-embed-v2")), 9).alias("cost"))


@query(f"WITH {i.COSTS_SQL} SELECT round(sum(amount), 6) AS total FROM costs")
def cost_total(spark, d):
    return oplog.cost_total(i.costs(spark, d)).select(F.round("total", 6).alias("total"))


@query(f"WITH {i.COSTS_SQL} SELECT category, round(sum(amount), 6) AS amount FROM costs GROUP BY category")
def cost_breakdown(spark, d):
    return oplog.cost_breakdown(i.costs(spark, d)).withColumn("amount", F.round("amount", 6))


@query(f"WITH {i.COSTS_SQL} SELECT round(sum(amount), 6) AS total FROM costs WHERE ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-16'")
def cost_daily(spark, d):
    return oplog.cost_daily(i.costs(spark, d), "2024-01-15").select(F.round("total", 6).alias("total"))


@query(f"WITH {i.COSTS_SQL} SELECT round(sum(amount) / 7 * 30, 6) AS forecast FROM costs WHERE ts >= TIMESTAMP '2024-01-23 12:00:00' AND ts <= TIMESTAMP '2024-01-30 12:00:00'")
def cost_forecast(spark, d):
    return oplog.cost_forecast(i.costs(spark, d), i.AS_OF).select(F.round("forecast", 6).alias("forecast"))


@query(f"WITH {i.COSTS_SQL} SELECT event_id, amount FROM costs WHERE category = 'storage'")
def cost_records(spark, d):
    return oplog.cost_records(i.costs(spark, d), "storage").select("event_id", "amount")


_BUDGET = f"""WITH {i.COSTS_SQL}, s AS (SELECT coalesce(sum(amount) FILTER (ts >= TIMESTAMP '2024-01-30' AND ts < TIMESTAMP '2024-01-31'), 0) AS d, coalesce(sum(amount) FILTER (ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-31'), 0) AS m FROM costs)"""


@query(f"{_BUDGET} SELECT 10.0::DOUBLE AS daily_limit, round(d, 6) AS daily_spent, round(greatest(0.0::DOUBLE, 10 - d), 6) AS daily_remaining, 100.0::DOUBLE AS monthly_limit, round(m, 6) AS monthly_spent, round(greatest(0.0::DOUBLE, 100 - m), 6) AS monthly_remaining, d >= 10 OR m >= 100 AS is_exceeded, CASE WHEN d >= 10 THEN 'daily' WHEN m >= 100 THEN 'monthly' END AS exceeded_type FROM s")
def budget_status(spark, d):
    status = oplog.budget_status(i.costs(spark, d), i.AS_OF)
    return status.select(*[F.round(c, 6).alias(c) if c.endswith(("spent", "remaining")) else F.col(c) for c in status.columns])


@query(f"{_BUDGET} SELECT round(greatest(0.0::DOUBLE, 10 - d), 6) AS daily, round(greatest(0.0::DOUBLE, 100 - m), 6) AS monthly FROM s")
def budget_remaining(spark, d):
    return oplog.budget_status(i.costs(spark, d), i.AS_OF).select(F.round("daily_remaining", 6).alias("daily"), F.round("monthly_remaining", 6).alias("monthly"))


@query(f"WITH {i.COSTS_SQL} SELECT round(sum(amount), 6) AS total, round(sum(amount) FILTER (category = 'embedding'), 6) AS embedding, round(sum(amount) FILTER (category = 'storage'), 6) AS storage, round(sum(amount) FILTER (category = 'retrieval'), 6) AS retrieval FROM costs")
def cost_report(spark, d):
    return oplog.cost_report(i.costs(spark, d), i.AS_OF).select(*[F.round(c, 6).alias(c) for c in ("total", "embedding", "storage", "retrieval")])


@query(f"WITH {i.COSTS_SQL}, s AS (SELECT sum(amount) FILTER (category = 'embedding') / sum(amount) AS e FROM costs) SELECT round(e, 6) AS embedding_share, e > 0.5 AS suggest_lite_model FROM s")
def optimize_advice(spark, d):
    return oplog.embedding_share(i.costs(spark, d)).withColumn("embedding_share", F.round("embedding_share", 6))


# tiers


@query(f"WITH {i.TIERS_SQL} SELECT chunk_id, recent FROM recent")
def window_access_count(spark, d):
    return oplog.recent_accesses(i.accesses(spark, d), i.AS_OF)


@query(f"WITH {i.TIERS_SQL}, a AS (SELECT chunk_id, count(*) AS access_count FROM accesses GROUP BY chunk_id) SELECT chunk_id, access_count, CASE WHEN tier <> 'hot' AND coalesce(recent, 0) >= 5 THEN 'hot' WHEN tier = 'cold' AND coalesce(recent, 0) >= 1 THEN 'warm' ELSE tier END AS tier FROM a JOIN tiers USING (chunk_id) LEFT JOIN recent USING (chunk_id)")
def record_access(spark, d):
    return oplog.record_accesses(i.tiers(spark, d), i.accesses(spark, d), i.AS_OF).select("chunk_id", "access_count", "tier")


@query(f"WITH {i.TIERS_SQL} SELECT c_custkey AS chunk_id, coalesce(tier, 'hot') AS tier FROM customer LEFT JOIN tiers ON chunk_id = c_custkey")
def get_tier(spark, d):
    return oplog.tier_of(i.table(spark, d, "customer").select(F.col("c_custkey").alias("chunk_id")), i.tiers(spark, d))


@query(f"WITH {i.TIERS_SQL} SELECT chunk_id, CASE tier WHEN 'cold' THEN 'warm' ELSE 'hot' END AS promoted, CASE tier WHEN 'hot' THEN 'warm' ELSE 'cold' END AS demoted FROM tiers")
def promote_demote(spark, d):
    return i.tiers(spark, d).select("chunk_id", oplog.promoted(F.col("tier")).alias("promoted"), oplog.demoted(F.col("tier")).alias("demoted"))


@query(f"WITH {i.TIERS_SQL}, r AS (SELECT chunk_id, tier, coalesce(recent, 0) AS recent FROM tiers LEFT JOIN recent USING (chunk_id)), a AS (SELECT *, CASE WHEN tier IN ('hot', 'warm') AND recent < 1 THEN 'demote' WHEN (tier = 'warm' AND recent >= 5) OR (tier = 'cold' AND recent >= 1) THEN 'promote' END AS action FROM r) SELECT * FROM a WHERE action IS NOT NULL")
def evaluate_tiers(spark, d):
    return oplog.evaluate_tiers(i.tiers(spark, d), i.accesses(spark, d), i.AS_OF)


@query(f"WITH {i.TIERS_SQL} SELECT tier, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 1) AS percent FROM tiers GROUP BY tier")
def tier_stats(spark, d):
    return oplog.tier_stats(i.tiers(spark, d))


# access and audit


@query("SELECT doc_id, doc_id % 3 AS tenant_id, source FROM documents WHERE doc_id % 3 = 1 OR doc_id % 3 = 2 OR source IN ('src0', 'src1', 'src2')")
def access_filter(spark, d):
    rows = i.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("tenant_id"), "source")
    return oplog.access_filter(rows, i.policies(spark)).select("doc_id", "tenant_id", "source")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source IN ('src0', 'src1', 'src2') ELSE true END AS allowed FROM documents")
def access_check(spark, d):
    rows = i.table(spark, d, "documents").select("doc_id", (F.col("doc_id") % 3).alias("tenant_id"), "source").join(i.policies(spark), "tenant_id", "left")
    return rows.select("doc_id", oplog.allowed(F.col("source"), F.col("sources")).alias("allowed"))


@query("SELECT * FROM (VALUES (0, 'src9'), (1, '*'), (7, 'src7')) AS t(tenant_id, sources)")
def policy_put(spark, d):
    new = spark.createDataFrame([(0, ["src9"]), (7, ["src7"])], "tenant_id long, sources array<string>")
    return oplog.put_policies(i.policies(spark), new).select(F.col("tenant_id").cast("int").alias("tenant_id"), F.array_join("sources", ",").alias("sources"))


def _audit(spark, d):
    e = i.events(spark, d)
    row = F.array(F.struct(F.col("user_id").cast("string").alias("chunk_id"), F.concat(F.lit("src"), F.col("k") % 5).alias("source"), (F.col("value") / 500).alias("score"), F.left("props", F.lit(100)).alias("content_preview")))
    return e.select("event_id", "ts", F.concat(F.lit("t"), F.col("user_id") % 3).alias("tenant_id"), F.col("event_type").alias("query"), F.lit(1).alias("num_results"), row.alias("results"))


@query(f"WITH {i.EVENTS_SQL} SELECT event_id FROM ev WHERE user_id % 3 = 1 AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20'")
def audit_trail(spark, d):
    return oplog.audit_trail(_audit(spark, d), "t1", "2024-01-10", "2024-01-20").select("event_id")


@query(f"WITH {i.EVENTS_SQL} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS timestamp, 't' || (user_id % 3) AS tenant_id, event_type AS query, 1::INT AS num_results, printf('%.4f', value / 500) AS top_score, 'src' || (k % 5) AS sources FROM ev")
def sink_audit_csv(spark, d):
    return oplog.audit_csv(_audit(spark, d))


@query(f"WITH {i.RANKED_SQL} SELECT query_id, count(*)::INT AS num_results, string_agg(left(content, 100), '|' ORDER BY rank) AS previews FROM cand GROUP BY query_id")
def sink_audit_append(spark, d):
    q = i.queries(spark, d).select("query_id", F.lit(i.AS_OF).cast("timestamp").alias("ts"), F.lit("t0").alias("tenant_id"), F.col("query_id").alias("query"))
    return oplog.audit_records(candidates(spark, d, content=F.left("content", F.lit(100))), q).select(F.col("query").alias("query_id"), "num_results", F.array_join(F.transform("results", lambda r: r["content_preview"]), "|").alias("previews"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in schedule.CRON.items()) + ") AS t(frequency, expression)")
def schedule_cron(spark, d):
    return spark.createDataFrame([(k, schedule.cron(k)) for k in schedule.CRON], "frequency string, expression string")


# streams


@query(f"WITH {i.DOCUMENTS_SQL} SELECT doc_id, source FROM docs WHERE lang = 'fr'")
def stream_incremental(spark, d):
    return incremental.replayed(spark, d)


@query(f"""WITH {i.EVENTS_SQL} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM ev GROUP BY ALL""")
def stream_daily_totals(spark, d):
    return incremental.daily_totals(i.events(spark, d)).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
