"""Query rewriting, routing by complexity, and extractive compression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import sentences, token_set, words

#: word: its synonyms, in order
SYNONYMS = {
    line.split(":")[0]: line.split(":")[1].split(",")
    for line in (
        "fast:quick,rapid,speedy|quick:fast,rapid,speedy|error:bug,issue,problem,fault|bug:error,issue,defect|fix:repair,resolve,patch|create:make,build,generate"
        "|delete:remove,drop,erase|update:modify,change,edit|get:fetch,retrieve,obtain|send:transmit,deliver,dispatch|start:begin,launch,initiate"
        "|stop:halt,end,terminate|big:large,huge,massive|small:tiny,little,compact|show:display,present,render|hide:conceal,mask,obscure"
        "|search:find,lookup,query|install:setup,deploy,configure|test:verify,validate,check|run:execute,launch,invoke"
    ).split("|")
}
ACRONYMS = dict(
    line.split("=")
    for line in (
        "ai=artificial intelligence;api=application programming interface;aws=amazon web services;cd=continuous deployment;cdn=content delivery network;"
        "ci=continuous integration;cli=command line interface;crud=create read update delete;db=database;dns=domain name system;etl=extract transform load;"
        "gcp=google cloud platform;grpc=google remote procedure call;http=hypertext transfer protocol;iam=identity and access management;jwt=json web token;"
        "k8s=kubernetes;llm=large language model;ml=machine learning;nlp=natural language processing;nosql=non-relational database;oauth=open authorization;"
        "rag=retrieval augmented generation;rest=representational state transfer;sdk=software development kit;sql=structured query language;sso=single sign on;vpc=virtual private cloud"
    ).split(";")
)


def _lookup(table: dict) -> Column:
    values = [F.array(*map(F.lit, v)) if isinstance(v, list) else F.array(F.lit(v)) for v in table.values()]
    return F.create_map(*[x for k, v in zip(table, values) for x in (F.lit(k), v)])


def _substituted(query: Column, table: dict) -> Column:
    """One variant per known word and substitute, in the order of the words."""
    known, parts = _lookup(table), words(F.lower(query))
    bare = lambda w: F.regexp_replace(w, r"[^\p{L}\p{N}_]", "")
    at = F.transform(parts, lambda w, i: F.transform(F.coalesce(F.try_element_at(known, bare(w)), F.array().cast("array<string>")), lambda s: F.array_join(F.transform(parts, lambda x, j: F.when(j == i, s).otherwise(x)), " ")))
    return F.array_distinct(F.concat(F.array(query), F.flatten(at)))


def expand_synonyms(query: Column, table: dict | None = None) -> Column:
    return _substituted(query, table or SYNONYMS)


def expand_acronyms(query: Column, table: dict | None = None) -> Column:
    return _substituted(query, table or ACRONYMS)


def sub_queries(query: Column) -> Column:
    """The query, then its parts between and / or."""
    parts = F.filter(F.transform(F.split(query, r"(?i)\s+(?:and|or)\s+", -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), lambda p: p != "")
    return F.array_distinct(F.when(F.size(F.split(query, r"(?i)\s+(?:and|or)\s+", -1)) > 1, F.concat(F.array(query), parts)).otherwise(F.array(query)))


def expand(query: Column, synonyms: dict | None = None, acronyms: dict | None = None) -> Column:
    """All variants, the query itself first, none twice."""
    return F.array_distinct(F.concat(expand_synonyms(query, synonyms), expand_acronyms(query, acronyms), sub_queries(query)))


def complexity(query: Column) -> Column:
    """0 to 1 from length, question mark, share of special characters and mean word length; 0 for a blank query."""
    parts = words(query)
    n = F.size(parts)
    special = F.length(F.regexp_replace(query, r"[\p{L}\p{N}\s]", ""))
    letters = F.aggregate(parts, F.lit(0), lambda s, w: s + F.length(w))
    total = (
        0.3 * F.least(n / F.lit(20.0), F.lit(1.0)) + 0.2 * F.when(query.contains("?"), 1.0).otherwise(0.0)
        + 0.2 * (special / F.nullif(F.length(query), F.lit(0))) + 0.3 * F.least(letters / F.nullif(n, F.lit(0)) / 10.0, F.lit(1.0))
    )
    return F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))).otherwise(0.0)


def route(query: Column, lite: str = "lite", full: str = "full", threshold: float = 0.5) -> Column:
    return F.when(complexity(query) < threshold, lite).otherwise(full)


def route_details(query: Column, lite: str = "lite", full: str = "full", threshold: float = 0.5) -> Column:
    c = complexity(query)
    reason = F.format_string("complexity %.3f %s threshold %.3f", c, F.when(c < threshold, "<").otherwise(">="), F.lit(threshold))
    return F.struct(route(query, lite, full, threshold).alias("model"), F.round(c, 6).alias("complexity"), reason.alias("reason"))


def sentence_score(query_terms: Column, sentence: Column) -> Column:
    """0.7 of the share of the query's terms and 0.3 of the sentence's that both have."""
    own = token_set(sentence)
    both = F.size(F.array_intersect(query_terms, own))
    return F.when((F.size(query_terms) > 0) & (F.size(own) > 0), 0.7 * both / F.nullif(F.size(query_terms), F.lit(0)) + 0.3 * both / F.nullif(F.size(own), F.lit(0))).otherwise(0.0)


def compress(chunks: DataFrame, queries: DataFrame, max_tokens: int = 1000, min_score: float = 0.1) -> DataFrame:
    """``chunks (query_id, chunk_no, content)``: the best sentences per query within ``max_tokens``.

    ``(query_id, text, original_chunks, sentences_kept, sentences_total, compression_ratio)``; taking stops
    at the first sentence that would exceed the budget.
    """
    terms = queries.select("query_id", token_set(F.col("query")).alias("terms"))
    each = chunks.join(terms, "query_id").select("query_id", "chunk_no", "terms", F.posexplode(sentences(F.col("content"))).alias("pos", "sentence"))
    scored = each.select("query_id", "chunk_no", "pos", "sentence", F.round(sentence_score(F.col("terms"), F.col("sentence")), 9).alias("score"), F.size(words(F.col("sentence"))).alias("n"))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_no", "pos")
    kept = scored.where(F.col("score") >= min_score).withColumn("place", F.row_number().over(best))
    kept = kept.withColumn("so_far", F.sum("n").over(best.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("so_far") <= int(max_tokens / 1.3))
    text = kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence"))), lambda s: s["sentence"]), " ").alias("text"), F.count(F.lit(1)).alias("sentences_kept"), F.sum("n").alias("kept_words"))
    whole = chunks.groupBy("query_id").agg(F.count(F.lit(1)).alias("original_chunks"), F.sum(F.size(words(F.col("content")))).alias("words"))
    total = scored.groupBy("query_id").agg(F.count(F.lit(1)).alias("sentences_total"))
    kept_words = F.coalesce(F.col("kept_words"), F.lit(0))
    return (
        whole.join(total, "query_id", "left").join(text, "query_id", "left")
        .select(
            "query_id", F.coalesce("text", F.lit("")).alias("text"), "original_chunks", F.coalesce("sentences_kept", F.lit(0)).alias("sentences_kept"),
            F.coalesce("sentences_total", F.lit(0)).alias("sentences_total"), F.when(F.col("words") > 0, F.round(1 - kept_words / F.col("words"), 3)).otherwise(0.0).alias("compression_ratio"),
        )
    )


