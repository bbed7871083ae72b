"""Ranking, evaluation, rewriting, codecs, logs, sources, configuration, engine and streams."""

import json
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace import cli, config, templates
from millrace.engine import Engine
from millrace.functions.text import sentences, tokens
from millrace.functions.vectors import dot, l2_normalize, rounded
from millrace.operators import embed, evaluate, ingest, oplog, quantize, rewrite, schedule, search
from millrace.plans import catalog, inputs
from millrace.sources import documents
from millrace.streaming import incremental


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def tables(spark, folder, **rows):
    """``folder`` as a data folder with small tables, and DuckDB over it."""
    duckdb = pytest.importorskip("duckdb")
    schemas = {"embeddings": "vec_id long, embedding array<float>, label int", "documents": "doc_id long, text string, lang string, source string, n_chars long"}
    con = duckdb.connect()
    for name, each in rows.items():
        spark.createDataFrame(each, schemas[name]).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


def same_as_sql(spark, folder, con, name):
    """The query's rows, after they were compared with those of its SQL, to the sign of a zero."""
    got = catalog.QUERIES[name](spark, str(folder))
    text = lambda rows: sorted(map(repr, rows))
    columns = ", ".join(f'"{c}"' for c in got.columns)
    rows = [tuple(r) for r in got.collect()]
    assert text(rows) == text(con.execute(f"SELECT {columns} FROM ({catalog.ORACLES[name]})").fetchall())
    return rows


def signed_zeros(spark, folder):
    vectors = [[0.6, -1e-8, 0.8], [-1e-8, 1e-8, 1.0], [-0.5, 0.5, 0.25], [-0.2, -0.0, 0.055]]
    docs = [(n, f"text {n}", "en" if n % 2 else "de", "src0", 6) for n in range(4)]
    return tables(spark, folder, embeddings=[(n, v, 0) for n, v in enumerate(vectors)], documents=docs)


def store(spark, rows):
    return spark.createDataFrame(rows, "chunk_id long, embedding array<float>, content string")


# search


@pytest.mark.parametrize("limit", [32 << 20, 0])
def test_vector_search_is_exact(spark, monkeypatch, limit):
    monkeypatch.setattr(search, "BROADCAST_BYTES", limit)
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 8)).astype(np.float32)
    v[5] = v[6]
    q = rng.standard_normal((20, 8)).astype(np.float32)
    s = store(spark, [(i, x.tolist(), "") for i, x in enumerate(v)]).repartition(5)
    queries = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, embedding array<float>").repartition(3)
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in search.vector_search(s, queries, 7).collect()}
    unit = lambda m: (m / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)).astype(np.float64)
    scores = np.round(unit(q) @ unit(v).T, 9)
    for i in range(20):
        order = sorted(range(300), key=lambda j: (-scores[i, j], j))[:7]
        assert [got[i, r + 1][0] for r in range(7)] == order
    assert search.vector_search(s.limit(0), queries, 3).count() == 0
    assert search.vector_search(s, queries.limit(0), 3).count() == 0
    assert {r.chunk_id for r in search.vector_search(s, queries, 50, F.col("chunk_id") < 10).collect()} == set(range(10))


def test_vector_search_holds_groups_of_queries_against_segments(spark, monkeypatch):
    rng = np.random.default_rng(5)
    v = np.vstack([rng.standard_normal((50, 4)), np.repeat(rng.standard_normal((3, 4)), 60, axis=0), np.zeros((2, 4))]).astype(np.float32)
    v[230] = v[100] * np.float32(4)
    for name, value in (("BROADCAST_BYTES", 0), ("GROUP_ROWS", 60), ("TASK_PAIRS", 9_000), ("BLOCK_ROWS", 16), ("TILE_ROWS", 7), ("CANDIDATES", 11)):
        monkeypatch.setattr(search, name, value)
    s = store(spark, [(i, x.tolist(), "") for i, x in enumerate(v)]).repartition(3)
    assert search._grid(232, 232) == (4, 2)
    found = search.vector_search(s, s.select(F.col("chunk_id").alias("query_id"), "embedding"), 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "RepartitionById" in plan.replace("RepartitionByExpression", "RepartitionById")
    u = v.astype(np.float64)
    u = np.divide(u, np.linalg.norm(u, axis=1, keepdims=True), out=u.copy(), where=u.any(axis=1, keepdims=True))
    scores = np.round(u @ u.T, 9)
    want = {(q, n): (i, scores[q, i]) for q in range(len(v)) for n, i in enumerate(sorted(range(len(v)), key=lambda i: (-scores[q, i], i))[:5], 1)}
    got = {(r.query_id, r.rank): (r.chunk_id, r.score) for r in found.collect()}
    assert {k: x[0] for k, x in got.items()} == {k: x[0] for k, x in want.items()}
    assert max(abs(got[k][1] - want[k][1]) for k in want) < 2e-9


def test_vector_search_of_any_ids_and_lengths(spark):
    s = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("c", [0.0, 1.0, 0.0, 0.0]), ("d", [None, 3.0, 0.0]), ("e", []), ("f", None), (None, [1.0, 0.0])], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([("x", [1.0, 0.0, 0.0]), ("y", [0.0, 1.0])], "query_id string, embedding array<double>")
    rows = search.vector_search(s, q, 10).collect()
    assert {(r.query_id, r.rank): (r.chunk_id, r.score) for r in rows} == {
        ("x", 1): ("a", 1.0), ("x", 2): ("b", 1.0), ("x", 3): ("c", 0.0), ("x", 4): ("d", 0.0), ("x", 5): ("e", 0.0),
        ("y", 1): ("c", 1.0), ("y", 2): ("d", 1.0), ("y", 3): ("a", 0.0), ("y", 4): ("b", 0.0), ("y", 5): ("e", 0.0),
    }
    plan = search.hybrid_rank(search.vector_search(s, q, 4).join(s.withColumn("content", F.col("chunk_id")), "chunk_id"), q.withColumn("query", F.lit("a b")), 3)
    assert plan._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 3
    assert {r.chunk_id for r in plan.where("query_id = 'x'").collect()} == {"a", "b", "c"}


def test_unit_vectors_keep_the_sign_of_zero(spark, tmp_path):
    assert "-0.0" in repr(same_as_sql(spark, tmp_path, signed_zeros(spark, tmp_path), "l2_normalized"))


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [1.0, 2.0, 9.0]), ([0.0, 0.0], [1.0])], "a array<double>, b array<double>")
    rows = df.select(l2_normalize(F.col("a")).alias("n"), dot(F.col("a"), F.col("b")).alias("d")).collect()
    assert [r.n for r in rows] == [[0.6, 0.8], [0.0, 0.0]] and [r.d for r in rows] == [11.0, 0.0]


def bm25(query, docs, k1=1.5, b=0.75):
    import re

    tok = lambda t: re.findall(r"\w+", t.lower())
    q, ds = tok(query), [tok(d) for d in docs]
    n, avg = len(ds), sum(map(len, ds)) / len(ds)
    out = []
    for d in ds:
        s = 0.0
        for t in q:
            df = sum(t in x for x in ds)
            if t in d:
                f = d.count(t)
                s += math.log((n - df + 0.5) / (df + 0.5) + 1) * f * (k1 + 1) / (f + k1 * (1 - b + b * len(d) / avg))
        out.append(min(1.0, s / (len(q) * math.log(n + 1) * (k1 + 1))) if q else 0.0)
    return out


def test_bm25_and_hybrid(spark):
    docs = ["the cat sat on the mat", "dogs and cats", "the the the", "Über café naïve", "cat cat cat dog"]
    queries = ["the cat cat", "café", "", "zebra"]
    cand = spark.createDataFrame([(q, r + 1, r, 0.9 - r * 0.1, d) for q in range(4) for r, d in enumerate(docs)], "query_id long, rank int, chunk_id long, score double, content string")
    asked = spark.createDataFrame(list(enumerate(queries)), "query_id long, query string")
    got = {(r.query_id, r.chunk_id): r.bm25 for r in search.bm25(cand, asked).collect()}
    for i, q in enumerate(queries):
        for j, s in enumerate(bm25(q, docs)):
            assert got[i, j] == pytest.approx(s)
    ranked = search.hybrid_rank(cand, asked, 3, *search.method_weights("keyword")).where("query_id = 0").orderBy("rank").collect()
    best = sorted(range(5), key=lambda j: (-round(bm25(queries[0], docs)[j], 6), j))[:3]
    assert [r.chunk_id for r in ranked] == best
    assert [r.chunk_id for r in search.hybrid_rank(cand, asked, 0).where("query_id = 3").orderBy("rank").collect()] == [0, 1, 2, 3, 4]


@pytest.mark.parametrize("name", ["doc_frequency", "bm25_score", "avg_doc_length", "hybrid_rank", "hybrid_semantic_only", "hybrid_keyword_only"])
def test_words_are_counted_beside_their_query(spark, tmp_path, name):
    rng = np.random.default_rng(4)
    texts = ["", "one two two", "Two, three! three?", " ... ", "one", "\u00c9t\u00e9 two_3 one one"]
    docs = [(n, texts[n % 6] + (" x y z"[: n % 7] if n % 6 else ""), "en", "src0", 9) for n in range(24)]
    con = tables(spark, tmp_path, embeddings=[(n, v.tolist(), 0) for n, v in enumerate(rng.standard_normal((24, 4)))], documents=docs)
    assert same_as_sql(spark, tmp_path, con, name)
    plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan  # a row for each word of each candidate was shuffled
    assert "regexp_extract_all" not in plan.partition("Join Inner, (chunk_id")[0]  # nor is a text cut into words once for each query that finds it


def test_results_carry_no_contents_to_compare(spark, tmp_path):
    rng = np.random.default_rng(6)
    docs = [(n, ("same", " same\n", "other", "same ")[n % 4], ("en", "de")[n % 3 % 2], "src0", 9) for n in range(30)]
    con = tables(spark, tmp_path, embeddings=[(n, v.tolist(), 0) for n, v in enumerate(rng.standard_normal((30, 4)))], documents=docs)
    for name in ("rrf_fuse", "rrf_dedup", "federated_search", "sink_audit_append"):
        assert same_as_sql(spark, tmp_path, con, name)
        plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
        assert "left(content" not in plan.partition("Join Inner, (chunk_id")[0]
        assert ("sha2(" in plan) == (name in ("rrf_dedup", "federated_search"))


def test_rrf(spark):
    ranking = lambda ids: spark.createDataFrame([(0, i + 1, x, f" {x} ") for i, x in enumerate(ids)], "query_id long, rank int, chunk_id string, content string")
    fused = search.rrf_fuse([ranking(["d1", "d2", "d3"]), ranking(["d2", "d4", "d1"])])
    score = {r.chunk_id: r.score for r in fused.collect()}
    assert score["d2"] == pytest.approx(1 / 62 + 1 / 61) and score["d1"] == pytest.approx(1 / 61 + 1 / 63)
    heavy = {r.chunk_id: r.score for r in search.rrf_fuse([ranking(["a", "b"]), ranking(["b", "a"])], [0.1, 10.0]).collect()}
    assert heavy["b"] > heavy["a"]
    same = search.rrf_fuse([ranking(["x", "y"])]).withColumn("content", F.lit(" same\n"))
    assert [r.chunk_id for r in search.rrf_dedup(same).collect()] == ["x"]


def test_variants_keep_the_first_score(spark):
    rows = spark.createDataFrame([(0, 0, 1, 0.2), (0, 1, 1, 0.9), (0, 1, 2, 0.5)], "query_id long, variant int, chunk_id long, score double")
    assert [(r.chunk_id, r.score) for r in search.merge_variants(rows, 5).orderBy("rank").collect()] == [(2, 0.5), (1, 0.2)]


# evaluation


def test_metrics(spark):
    r = spark.createDataFrame([(0, i + 1, x) for i, x in enumerate("axybz")], "query_id long, rank int, chunk_id string")
    g = spark.createDataFrame([(0, x) for x in "abc"] + [(1, "q")], "query_id long, chunk_id string")
    value = lambda df, c: {x.query_id: x[c] for x in df.collect()}
    assert value(evaluate.precision_at_k(r, g, 3), "precision") == {0: pytest.approx(1 / 3), 1: 0.0}
    assert value(evaluate.precision_at_k(r, g, 0), "precision") == {0: 0.0, 1: 0.0}
    assert value(evaluate.recall_at_k(r, g, 3), "recall")[0] == pytest.approx(1 / 3)
    assert value(evaluate.reciprocal_rank(r, g), "mrr") == {0: 1.0, 1: 0.0}
    rel = spark.createDataFrame([(0, "a", 1), (0, "y", 1)], "query_id long, chunk_id string, relevance int")
    assert value(evaluate.ndcg_at_k(r, rel, 4), "ndcg")[0] == pytest.approx(1.5 / (1 + 1 / math.log2(3)))
    zero = evaluate.evaluate_run(r, g.limit(0), 5).first()
    assert (zero.precision, zero.num_queries, zero.k) == (0.0, 0, 5)
    assert one(spark, evaluate.answer_relevancy(F.col("q"), F.col("a")), q="What is it", a="it is that") == pytest.approx(2 / 3)
    assert one(spark, evaluate.answer_relevancy(F.col("q"), F.col("a")), q=" ", a="x") == 0


def test_classes_are_as_their_pairs(spark):
    members = [(1, "a"), (2, "a"), (2, "b"), (2, "b"), (3, "b"), (4, "c"), (5, "a"), (5, "b"), (6, None), (None, "a")]
    rows = spark.createDataFrame(members, "id long, label string")
    pairs = {(x, y) for x, a in members for y, b in members if a == b and None not in (x, y, a) and x != y}
    golden, listed = evaluate.Classes(rows), spark.createDataFrame(sorted(pairs), "query_id long, chunk_id long")
    r = spark.createDataFrame([(q, n, c) for q in range(1, 7) for n, c in enumerate((q, 5, 3, 6, 9), 1)], "query_id long, rank int, chunk_id long")
    for of in (evaluate.precision_at_k, evaluate.recall_at_k, evaluate.evaluate_queries, lambda x, g, k: evaluate.reciprocal_rank(x, g)):
        assert sorted(of(r, golden, 3).collect()) == sorted(of(r, listed, 3).collect())
    assert evaluate.evaluate_run(r, golden, 3).first() == evaluate.evaluate_run(r, listed, 3).first()
    mine = {x.query_id: x.ndcg for x in evaluate.ndcg_at_k(r, golden, 3).collect()}
    assert mine == {x.query_id: x.ndcg for x in evaluate.evaluate_queries(r, listed, 3).collect()} and 4 not in mine


def labelled(spark, folder):
    rng = np.random.default_rng(3)
    vectors = [(n, v.tolist(), (0, 1, 1, 7)[min(n, 3)] if n < 4 else n % 3) for n, v in enumerate(rng.standard_normal((40, 6)))]
    return tables(spark, folder, embeddings=vectors, documents=[(n, f"word{n % 4} some text", ("en", "de")[n % 2], f"src{n % 3}", 9) for n in range(40)])


@pytest.mark.parametrize("name", ["evaluate_run", "mrr", "precision_at_k", "recall_at_k", "ndcg_at_k"])
def test_metrics_list_no_pairs_of_a_class(spark, tmp_path, name):
    rows = same_as_sql(spark, tmp_path, labelled(spark, tmp_path), name)
    assert len(rows) == (1 if name == "evaluate_run" else 39)  # label 7 is of one id
    assert inputs.golden(spark, str(tmp_path)).kinds.count() == 40  # its pairs are 470


def test_drift(spark):
    b = spark.createDataFrame([("p", 1.0), ("z", 0.0), ("up", 0.5), ("edge", 1.0)], "metric string, value double")
    c = spark.createDataFrame([("p", 0.75), ("z", 0.5), ("up", 0.6), ("edge", 0.9)], "metric string, value double")
    got = {r.metric: (r.drop, r.is_drifted) for r in evaluate.check_drift(b, c).collect()}
    assert got["p"] == (0.25, True) and got["z"] == (0.0, False) and got["up"][0] < 0 and got["edge"] == ((1.0 - 0.9) / 1.0, False)
    with pytest.raises(ValueError):
        evaluate.check_drift(b.limit(0), c)


# rewriting


def test_expansion(spark):
    assert one(spark, rewrite.expand_synonyms(F.col("q")), q="Fast fix!") == ["Fast fix!", "quick fix!", "rapid fix!", "speedy fix!", "fast repair", "fast resolve", "fast patch"]
    assert one(spark, rewrite.expand_acronyms(F.col("q")), q="the API of aws") == ["the API of aws", "the application programming interface of aws", "the api of amazon web services"]
    assert one(spark, rewrite.sub_queries(F.col("q")), q="a And b OR c") == ["a And b OR c", "a", "b", "c"]
    assert one(spark, rewrite.expand(F.col("q")), q="nothing here") == ["nothing here"]
    assert one(spark, rewrite.expand_synonyms(F.col("q"), {"x": ["y"]}), q="fast x") == ["fast x", "fast y"]
    assert len(rewrite.SYNONYMS) == 20 and len(rewrite.ACRONYMS) == 28


def test_routing(spark):
    assert one(spark, rewrite.complexity(F.col("q")), q="  ") == 0
    q = "What is this?"
    expected = 0.3 * 3 / 20 + 0.2 + 0.2 * 1 / 13 + 0.3 * min((4 + 2 + 5) / 3 / 10, 1)
    assert one(spark, rewrite.complexity(F.col("q")), q=q) == pytest.approx(expected)
    assert one(spark, rewrite.route(F.col("q")), q=q) == "lite"
    assert "0.500" in one(spark, rewrite.route_details(F.col("q")), q=q)["reason"]


def test_compression(spark):
    chunks = spark.createDataFrame([(0, 0, "Cats purr. Dogs bark loudly! Rain falls."), (0, 1, "Cats and dogs sleep. "), (1, 0, "Nothing.")], "query_id long, chunk_no int, content string")
    queries = spark.createDataFrame([(0, "cats dogs"), (1, "")], "query_id long, query string")
    got = {r.query_id: r for r in rewrite.compress(chunks, queries).collect()}
    assert got[0].text == "Cats and dogs sleep. Cats purr. Dogs bark loudly!" and got[0].sentences_kept == 3 and got[0].sentences_total == 4
    assert got[0].compression_ratio == round(1 - 9 / 11, 3)
    assert got[1].text == "" and got[1].sentences_kept == 0 and got[1].compression_ratio == 1.0
    small = {r.query_id: r for r in rewrite.compress(chunks, queries, max_tokens=8).collect()}
    assert small[0].text == "Cats and dogs sleep. Cats purr."
    assert one(spark, sentences(F.col("t")), t="A b. C?  D") == ["A b.", "C?", "D"]
    assert one(spark, tokens(F.col("t")), t="Été_1 d'été") == ["été_1", "d", "été"]


# codecs


def test_codecs(spark):
    rng = np.random.default_rng(42)
    rows = [rng.uniform(-1, 1, 64).tolist(), [0.5] * 4, [], [-1.0, -0.5, 0.0, 0.5, 1.0], [1e-7, -3e-8, 65504.0, 0.1]]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v array<double>")
    for r in df.select("v", quantize.quantize(F.col("v"), "int8").alias("q"), quantize.dequantize_int8(quantize.quantize_int8(F.col("v"))).alias("back"), quantize.quantize(F.col("v"), "float16").alias("h")).collect():
        v = np.array(r.v)
        assert np.array_equal(np.array(r.h), v.astype(np.float16).astype(np.float64))
        assert len(r.back) == len(v) and (not len(v) or np.abs(np.array(r.back) - v).max() <= (v.max() - v.min()) / 255)
        if len(v) and v.max() > v.min():
            scale = (v.max() - v.min()) / 255
            assert r.q.codes == np.clip(np.rint((v - v.min()) / scale) - 128, -128, 127).astype(int).tolist()
    with pytest.raises(ValueError):
        quantize.quantize(F.col("v"), "int4")
    s = one(spark, quantize.estimate_savings(F.lit(10_000), F.lit(1024), "float16"))
    assert s.savings_percent == 50.0
    assert one(spark, quantize.estimate_savings(F.lit(10_000), F.lit(1024), "int8")).savings_percent == 74.8


def test_dequantised_entries_keep_the_sign_of_zero(spark, tmp_path):
    con = tables(spark, tmp_path, embeddings=[(0, [-60 / 195, 0.0, 1.0], 0), (1, [1.0, -1.0, 0.5], 0)])
    assert "-0.0" in repr(same_as_sql(spark, tmp_path, con, "dequantize_int8"))


# logs


def ts(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def test_feedback(spark):
    f = ts(spark.createDataFrame([("q", 1, True, "2024-01-01"), ("q", 1, False, "2024-01-02"), ("q", 3, False, "2024-01-01")], "query string, chunk_id long, relevant boolean, ts string"))
    r = spark.createDataFrame([(0, 1, 2, 0.7), (0, 2, 1, 0.65), (0, 3, 3, 0.6)], "query_id long, rank int, chunk_id long, score double")
    assert [(x.chunk_id, x.score) for x in oplog.feedback_boost(r, f).orderBy("rank").collect()] == [(1, 0.75), (2, 0.7), (3, 0.6)]


def test_costs_and_budget(spark):
    assert one(spark, oplog.embedding_cost(F.lit(1000), F.lit("bedrock/titan-embed-v2"))) == pytest.approx(0.0001)
    assert one(spark, oplog.embedding_cost(F.lit(1000), F.lit("local/dev"))) == 0
    assert one(spark, oplog.retrieval_cost(F.lit("a b c"), F.lit("other"))) == pytest.approx(3 / 1000 * 0.0001)
    rows = [("embedding", 6.0, "2024-03-02 10:00:00"), ("storage", 4.0, "2024-03-02 23:00:00"), ("embedding", 7.0, "2024-02-29 10:00:00")]
    costs = ts(spark.createDataFrame(rows, "category string, amount double, ts string"))
    assert {r.category: r.amount for r in oplog.cost_breakdown(costs).collect()} == {"embedding": 13.0, "storage": 4.0, "retrieval": 0.0}
    assert oplog.cost_daily(costs, "2024-03-02").first().total == 10.0
    assert oplog.cost_forecast(costs, "2024-03-02 23:30:00").first().forecast == pytest.approx(17 / 7 * 30)
    status = oplog.budget_status(costs, "2024-03-02 12:00:00", 10, 100)
    row = status.first()
    assert (row.daily_spent, row.monthly_spent, row.is_exceeded, row.exceeded_type, row.daily_remaining) == (10.0, 10.0, True, "daily", 0.0)
    assert oplog.check_budget(status, "downgrade") == "downgrade" and oplog.check_budget(status, "other") == "alert"
    with pytest.raises(oplog.BudgetExceeded) as error:
        oplog.check_budget(oplog.budget_status(costs, "2024-03-02", 100, 5), "block")
    assert (error.value.kind, error.value.limit) == ("monthly", 5.0)
    assert oplog.check_budget(oplog.budget_status(costs, "2024-03-02", 100, 100)) == "ok"
    assert oplog.cost_report(costs.limit(0), "2024-03-02").first().total == 0.0


def test_tiers(spark):
    a = ts(spark.createDataFrame([(c, "2024-01-09") for c in [2] * 5 + [3]] + [(1, "2024-01-01"), (9, "2024-01-09")], "chunk_id long, ts string"))
    t = spark.createDataFrame([(1, "hot"), (2, "warm"), (3, "cold")], "chunk_id long, tier string")
    assert {r.chunk_id: r.tier for r in oplog.record_accesses(t, a, "2024-01-10").collect()} == {1: "hot", 2: "hot", 3: "warm", 9: "hot"}
    assert {r.chunk_id: r.action for r in oplog.evaluate_tiers(t, a, "2024-01-10").collect()} == {1: "demote", 2: "promote", 3: "promote"}
    assert {r.tier: (r.n, r.percent) for r in oplog.tier_stats(t).collect()} == {"hot": (1, 33.3), "warm": (1, 33.3), "cold": (1, 33.3)}
    assert oplog.tier_stats(t.limit(0)).where("n = 0 and percent = 0").count() == 3
    assert one(spark, oplog.demoted(F.lit(None).cast("string"))) == "warm"


def test_access_and_audit(spark, tmp_path):
    p = spark.createDataFrame([("a", ["s1", "s2"]), ("b", ["*"])], "tenant_id string, sources array<string>")
    rows = spark.createDataFrame([(t, s) for t in "abc" for s in ("s1", "s3")], "tenant_id string, source string")
    assert sorted((r.tenant_id, r.source) for r in oplog.access_filter(rows, p).collect()) == [("a", "s1"), ("b", "s1"), ("b", "s3"), ("c", "s1"), ("c", "s3")]
    assert oplog.remove_policies(p, p.where("tenant_id = 'a'")).count() == 1
    q = ts(spark.createDataFrame([(0, "a", "hello", "2024-01-01 00:00:00"), (1, "b", "none", "2024-01-02 00:00:00")], "query_id long, tenant_id string, query string, ts string"))
    r = spark.createDataFrame([(0, 1, "c1", "s1", 0.9, "x" * 200), (0, 2, "c2", "s1", 0.8, "y")], "query_id long, rank int, chunk_id string, source string, score double, content string")
    documents.append_audit(oplog.audit_records(r, q), str(tmp_path / "audit"))
    (tmp_path / "audit" / "more.json").write_text("\nnot json\n\n")
    log = documents.scan_audit(spark, str(tmp_path / "audit"))
    assert log.count() == 2
    flat = {x.query: x for x in oplog.audit_csv(log).collect()}
    assert flat["hello"].top_score == "0.9000" and flat["hello"].sources == "s1, s1" and flat["none"].top_score == "0.0000" and flat["none"].sources == ""
    assert oplog.audit_trail(log, "a", "2024-01-01", "2024-01-01").count() == 1 and oplog.audit_trail(log, None, "2024-01-02").count() == 1
    assert documents.export_csv(oplog.audit_csv(log), str(tmp_path / "csv")) == 2


# ingestion


def test_upsert_keeps_the_sign_of_small_entries(spark, tmp_path):
    rows = same_as_sql(spark, tmp_path, signed_zeros(spark, tmp_path), "upsert")
    assert "-0.0" in repr(rows)
    assert repr(one(spark, rounded(F.array(F.lit(-4e-7), F.lit(-6e-7), F.lit(-0.0), F.lit(4e-7), F.lit(0.1234565), F.lit(None)), 6))) == "[-0.0, -1e-06, -0.0, 0.0, 0.123457, None]"


def test_state_and_upserts(spark):
    state = spark.createDataFrame([("a", "old", "txt")], "source string, hash string, doc_type string")
    docs = spark.createDataFrame([("a", "x", "txt", 1), ("a", "y", "txt", 2), ("b", "z", "md", 1)], "source string, content string, doc_type string, n int")
    assert ingest.filter_changed(docs, state).count() == 3
    marked = ingest.mark_ingested(state, docs, F.col("n"))
    assert ingest.filter_changed(docs.where("n = 2 or source = 'b'"), marked).count() == 0
    s = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "chunk_id long, embedding array<double>")
    new = spark.createDataFrame([(2, [3.0, 4.0], 1), (2, [0.0, 9.0], 0), (3, [2.0, 0.0], 1)], "chunk_id long, embedding array<double>, v int")
    assert {r.chunk_id: r.embedding for r in ingest.upsert(s, new, F.col("v")).collect()} == {1: [1.0, 0.0], 2: [0.6, 0.8], 3: [1.0, 0.0]}
    assert [r.chunk_id for r in ingest.delete(s, s.where("chunk_id = 1")).collect()] == [2]
    meta = one(spark, ingest.stored_metadata(F.lit("s"), F.create_map(F.lit("source"), F.lit("own"), F.lit("k"), F.lit("v"))))
    assert meta == {"source": "own", "k": "v"}


def test_local_embedder(spark):
    df = spark.createDataFrame([(1, "same"), (2, "same"), (3, "other"), (4, None)], "i int, content string")
    v = {r.i: r.embedding for r in embed.embed_local(df, "content", 32).collect()}
    assert v[1] == v[2] != v[3] and v[4] is None and np.linalg.norm(v[1]) == pytest.approx(1) and len(v[3]) == 32
    assert embed.embedder_for("bedrock/m", 4, lambda m, t: [[m == "m"]] * len(t))(["x"]) == [[True]]
    with pytest.raises(ValueError):
        embed.embedder_for("bedrock/m", 4)


def test_file_sources(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_text("# été", "utf-8")
    (tmp_path / "sub" / "b.txt").write_text("b", "utf-8")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\xfa")
    (tmp_path / "c.bin").write_text("c", "utf-8")
    rows = {r.metadata["filename"]: (r.content, r.doc_type) for r in documents.scan_sources(spark, [{"type": "local", "path": str(tmp_path)}, {"type": "github"}]).collect()}
    assert rows == {"a.md": ("# été", "md"), "b.txt": ("b", "txt")}
    assert documents.scan_files(spark, str(tmp_path / "none")).count() == 0
    golden = tmp_path / "g.json"
    golden.write_text(json.dumps([{"query": "q", "relevant_ids": ["x"]}]))
    assert documents.scan_golden(spark, str(golden)).first().relevant_ids == ["x"]
    golden.write_text("{}")
    with pytest.raises(ValueError):
        documents.scan_golden(spark, str(golden))
    with pytest.raises(FileNotFoundError):
        documents.scan_golden(spark, str(tmp_path / "no.json"))
    golden.write_text("{broken")
    assert documents.scan_state(spark, str(golden), "a int").count() == 0


def test_webhooks(tmp_path, monkeypatch):
    hooks = documents.Webhooks(str(tmp_path / "h.json"))
    with pytest.raises(ValueError):
        hooks.register("http://x", ["unknown"])
    hooks.register("http://x", ["error"])
    hooks.register("http://x", ["error", "quality_alert"])
    assert hooks.all() == [{"url": "http://x", "events": ["error", "quality_alert"]}]

    def refused(*args, **kw):
        raise OSError("refused")

    monkeypatch.setattr(documents.urllib.request, "urlopen", refused)
    assert hooks.notify("error", {})[0]["success"] is False and hooks.notify("budget_exceeded", {}) == []
    assert hooks.unregister("http://x") and not hooks.unregister("http://x")


# configuration, schedules, command line

GOOD = {"project": {"name": "p"}, "data_sources": [{"name": "d", "type": "local", "config": {"path": "."}}], "embedding": {"model": "local/dev", "dimensions": 32}}


def test_configuration(tmp_path):
    c = config.parse(GOOD)
    assert (c.chunking.max_chunk_size, c.retrieval.top_k, c.embedding.dimensions) == (512, 5, 32)
    for change in ({"data_sources": []}, {"data_sources": [{"name": "x", "type": "ftp"}]}, {"chunking": {"max_chunk_size": 10}}, {"chunking": {"overlap": 512}}, {"retrieval": {"semantic_weight": 0.9}}, {"chunking": {"strategy": "odd"}}, {"retrieval": {"top_k": 0}}, {"embedding": {"dimensions": 0}}):
        with pytest.raises(ValueError):
            config.parse(GOOD | change)
    prod = config.for_environment(c, "prod", {"retrieval": {"top_k": 9, "unknown": 1}})
    assert prod.retrieval.top_k == 9 and c.retrieval.top_k == 5
    with pytest.raises(ValueError):
        config.for_environment(c, "moon")
    (tmp_path / "c.json").write_text(json.dumps(GOOD))
    assert config.load(str(tmp_path / "c.json")).project_name == "p"
    (tmp_path / "e.json").write_text("")
    with pytest.raises(ValueError):
        config.load(str(tmp_path / "e.json"))
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "no.json"))


def test_schedules_and_templates():
    assert schedule.cron("daily") == "cron(0 0 * * ? *)" and schedule.rate("weekly") == "rate(7 days)" and schedule.cron("rate(3 days)") == "rate(3 days)"
    with pytest.raises(ValueError):
        schedule.cron("sometimes")
    assert schedule.plan([{"name": "a", "type": "s3", "update_frequency": "odd"}])[0] == {"source_name": "a", "source_type": "s3", "frequency": "odd", "cron_expression": "cron(0 0 * * ? *)", "enabled": True}
    stack = templates.serverless(config.parse(GOOD), "dev")
    assert stack["Resources"]["Answer"]["Properties"]["Timeout"] == 3 and stack["Resources"]["Ingest"]["Properties"]["Timeout"] == 900
    assert set(templates.workflow(config.parse(GOOD))["jobs"]) == {"test", "deploy"}


def test_command_line(tmp_path, capsys):
    path = str(tmp_path / "c.json")
    assert cli.main([]) == 0
    assert cli.main(["--config", path, "init"]) == 0 and cli.main(["--config", path, "init"]) == 1 and cli.main(["--config", path, "init", "--force"]) == 0
    assert cli.main(["--config", path, "status"]) == 0 and "hybrid" in capsys.readouterr().out
    assert cli.main(["--config", path, "deploy", "--env", "prod"]) == 0
    assert cli.main(["--config", path, "eject", "--output", str(tmp_path / "out")]) == 0 and (tmp_path / "out" / "template.json").exists()
    assert cli.main(["--config", path, "eval", str(tmp_path / "none")]) == 1


# engine and streams


def test_engine(spark, tmp_path):
    c = config.parse(GOOD | {"chunking": {"strategy": "recursive", "max_chunk_size": 200, "overlap": 20}, "retrieval": {"top_k": 3}})
    e = Engine(spark, c, f"file://{tmp_path}/data")
    docs = spark.createDataFrame([(f"Text {i} speaks of topic{i}. " * 20, f"s{i}", "md") for i in range(4)] + [(None, "bad", "txt")], "content string, source string, doc_type string")
    stats = e.ingest_changed(docs, "2024-01-01").first()
    assert (stats.documents_processed, stats.errors) == (4, 1) and stats.chunks_created == e.store().count() >= 4
    again = e.ingest_changed(docs.where("source <> 'bad'"), "2024-01-02").first()
    assert (again.documents_changed, again.documents_skipped) == (0, 4)
    before = e.store().count()
    changed = docs.where("source = 's1'").withColumn("content", F.lit("short"))
    assert e.ingest_changed(changed, "2024-01-03").first().documents_changed == 1
    assert e.store().where("source = 's1'").count() == 1 and e.store().count() < before
    asked = spark.createDataFrame([(0, "short"), (1, "topic2 and topic3")], "query_id long, query string")
    found = e.query_logged(asked, "2024-01-03", expand=True)
    assert {r.query_id: r.source for r in found.where("rank = 1").collect()}[0] == "s1"
    assert found.groupBy("query_id").count().where("count > 3").count() == 0
    assert oplog.analytics_summary(e.query_log()).first().total_queries == 2
    policies = spark.createDataFrame([("t", ["s2"])], "tenant_id string, sources array<string>")
    assert {r.source for r in e.query_audited(asked, "t", "2024-01-03", policies).collect()} <= {"s2"}
    assert e.audit().count() == 2
    key = e.store().where("source = 's1'").first().chunk_id
    (tmp_path / "g.json").write_text(json.dumps([{"query": "short", "relevant_ids": [key]}]))
    assert e.evaluate(str(tmp_path / "g.json"), "2024-01-03").first().mrr == 1.0
    assert e.cost_report("2024-01-03").first().total == 0.0


def test_stream(spark, tmp_path):
    schema = "content string, source string, doc_type string"
    inbox, out = tmp_path / "in", str(tmp_path / "out")
    spark.createDataFrame([("one", "a", "txt"), ("two", "b", "txt")], schema).coalesce(1).write.json(str(inbox / "x"))
    start = lambda: incremental.ingest_stream(spark.readStream.schema(schema).json(str(inbox / "*")), out, str(tmp_path / "cp")).awaitTermination()
    start()
    spark.createDataFrame([("one", "a", "txt"), ("changed", "b", "txt")], schema).coalesce(1).write.json(str(inbox / "y"))
    start()
    assert {r.source: r.content for r in incremental.current_chunks(spark, out).collect()} == {"a": "one", "b": "changed"}


def test_stream_totals_and_repeats(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"2024-01-0{rng.randrange(1, 5)} 10:00:00", rng.choice("xy"), 1.0) for i in range(100)]
    df = ts(spark.createDataFrame(rows + rows[:10], "event_id long, ts string, event_type string, value double"))
    df.write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "e"))
    once = incremental.drop_repeats(stream, "event_id").writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    once.awaitTermination()
    assert spark.table("once").count() == 100
    totals = incremental.daily_totals(stream).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    totals.awaitTermination()
    assert spark.table("totals").agg(F.sum("n")).first()[0] == 110
    assert incremental.daily_totals(df).agg(F.sum("n")).first()[0] == 110
