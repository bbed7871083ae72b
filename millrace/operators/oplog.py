"""Operational logs: query analytics, feedback, costs, budgets, tiers, access and audit.

Logs are append-only tables with a timestamp; the present is always an argument.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.text import words

# analytics: log (query, num_results, max_score, latency_ms, ts, sources)


def record_queries(results: DataFrame, queries: DataFrame) -> DataFrame:
    """Log rows from ``results (query_id, rank, score, source)`` and ``queries (query_id, query, latency_ms, ts)``."""
    sources = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda r: r["source"]))
    per = results.groupBy("query_id").agg(F.count(F.lit(1)).alias("num_results"), F.greatest(F.lit(0.0), F.max("score")).alias("max_score"), sources.alias("sources"))
    return queries.join(per, "query_id", "left").select(
        "query", F.coalesce("num_results", F.lit(0)).alias("num_results"), F.coalesce("max_score", F.lit(0.0)).alias("max_score"), "latency_ms", "ts",
        F.coalesce("sources", F.array().cast("array<string>")).alias("sources"),
    )


def low_confidence(log: DataFrame, threshold: float = 0.5) -> DataFrame:
    return log.where((F.col("max_score") < threshold) & (F.col("num_results") > 0))


def zero_results(log: DataFrame) -> DataFrame:
    return log.where(F.col("num_results") == 0)


def analytics_summary(log: DataFrame) -> DataFrame:
    """One row of totals; zeros for an empty log."""
    return log.agg(
        F.count(F.lit(1)).alias("total_queries"), F.coalesce(F.round(F.avg("latency_ms"), 2), F.lit(0.0)).alias("avg_latency_ms"),
        F.count_if(F.col("num_results") == 0).alias("zero_result_count"), F.count_if((F.col("max_score") < 0.5) & (F.col("num_results") > 0)).alias("low_confidence_count"),
    )


def queries_per_source(log: DataFrame) -> DataFrame:
    return log.select(F.explode(F.array_distinct("sources")).alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("queries"))


def query_frequency(log: DataFrame) -> DataFrame:
    """Counts per query, sorted; of equals the one seen first comes first."""
    per = log.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_seen"))
    return per.orderBy(F.desc("n"), "first_seen", "query")


# feedback: (query, chunk_id, relevant, ts)


def positive_chunks(feedback: DataFrame) -> DataFrame:
    """Chunks that were ever relevant; a later negative does not take that back."""
    return feedback.where("relevant").select("chunk_id").distinct()


def feedback_boost(results: DataFrame, feedback: DataFrame, boost: float = 0.1) -> DataFrame:
    """``results (query_id, rank, chunk_id, score)`` with positive chunks raised, ranked anew; ties keep their order."""
    liked = positive_chunks(feedback).withColumn("_liked", F.lit(True))
    raised = results.join(liked, "chunk_id", "left").withColumn("score", F.round(F.col("score") + F.when(F.col("_liked"), boost).otherwise(0.0), 9))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "before")
    return raised.withColumnRenamed("rank", "before").withColumn("rank", F.row_number().over(order)).select("query_id", "rank", "chunk_id", "score")


# costs: (category, amount, ts, ...)

PRICES = {**dict.fromkeys(("titan-embed-v2", "titan-embed-text-v1", "cohere-embed-english", "cohere-embed-multilingual", "default"), 0.0001), "local/dev": 0.0, "dev": 0.0}
CATEGORIES = ("embedding", "storage", "retrieval")
STORAGE_PRICE = 0.25


def price(model: Column, prices: dict[str, float] | None = None) -> Column:
    """Per 1000 tokens, by the last part of the model's name; the default for others."""
    table = PRICES if prices is None else prices
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.element_at(F.split(model, "/"), -1)), F.lit(table.get("default", 0.0001)))


def embedding_cost(tokens: Column, model: Column) -> Column:
    return tokens / 1000.0 * price(model)


def storage_cost(vectors: Column, dimensions: Column, rate: float = STORAGE_PRICE) -> Column:
    return vectors * dimensions * 4.0 / float(1 << 30) * rate


def retrieval_cost(query: Column, model: Column, tokens: Column | None = None) -> Column:
    n = F.floor(F.size(words(query)) * F.lit(1.3)) if tokens is None else tokens
    return n / 1000.0 * price(model)


def cost_total(costs: DataFrame) -> DataFrame:
    return costs.agg(F.coalesce(F.sum("amount"), F.lit(0.0)).alias("total"))


def cost_breakdown(costs: DataFrame) -> DataFrame:
    """The three categories are always there."""
    names = costs.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return names.join(costs.groupBy("category").agg(F.sum("amount").alias("amount")), "category", "full").select("category", F.coalesce("amount", F.lit(0.0)).alias("amount"))


def _between(start: Column, end: Column) -> Column:
    return (F.col("ts") >= start) & (F.col("ts") < end)


def cost_daily(costs: DataFrame, day: str) -> DataFrame:
    start = F.lit(day).cast("timestamp")
    return cost_total(costs.where(_between(start, start + F.expr("interval 1 day"))))


def cost_forecast(costs: DataFrame, as_of: str) -> DataFrame:
    """Thirty days at the mean of the last seven."""
    now = F.lit(as_of).cast("timestamp")
    week = costs.where((F.col("ts") >= now - F.expr("interval 7 days")) & (F.col("ts") <= now))
    return week.agg((F.coalesce(F.sum("amount"), F.lit(0.0)) / 7 * 30).alias("forecast"))


def cost_records(costs: DataFrame, category: str | None = None) -> DataFrame:
    return costs if category is None else costs.where(F.col("category") == category)


def budget_status(costs: DataFrame, as_of: str, daily: float = 10.0, monthly: float = 100.0) -> DataFrame:
    """One row; a budget counts as exceeded when it is reached, the daily one is named first."""
    day, month = F.date_trunc("day", F.lit(as_of).cast("timestamp")), F.date_trunc("month", F.lit(as_of).cast("timestamp"))
    spent = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("amount"))), F.lit(0.0))
    sums = costs.agg(spent(_between(day, day + F.expr("interval 1 day"))).alias("daily_spent"), spent((F.col("ts") >= month) & (F.col("ts") < day + F.expr("interval 1 day"))).alias("monthly_spent"))
    over_day, over_month = F.col("daily_spent") >= daily, F.col("monthly_spent") >= monthly
    return sums.select(
        F.lit(float(daily)).alias("daily_limit"), "daily_spent", F.greatest(F.lit(0.0), F.lit(float(daily)) - F.col("daily_spent")).alias("daily_remaining"),
        F.lit(float(monthly)).alias("monthly_limit"), "monthly_spent", F.greatest(F.lit(0.0), F.lit(float(monthly)) - F.col("monthly_spent")).alias("monthly_remaining"),
        (over_day | over_month).alias("is_exceeded"), F.when(over_day, "daily").when(over_month, "monthly").alias("exceeded_type"),
    )


class BudgetExceeded(Exception):
    def __init__(self, kind: str, limit: float, spent: float) -> None:
        super().__init__(f"{kind} budget of {limit} is spent: {spent}")
        self.kind, self.limit, self.spent = kind, limit, spent


def check_budget(status: DataFrame, action: str = "alert") -> str:
    """``ok``, or what to do when a budget is spent: ``downgrade``, ``alert``, or an exception for ``block``."""
    row = status.first()
    if not row["is_exceeded"]:
        return "ok"
    if action == "block":
        kind = row["exceeded_type"]
        raise BudgetExceeded(kind, row[f"{kind}_limit"], row[f"{kind}_spent"])
    return "downgrade" if action == "downgrade" else "alert"


def cost_report(costs: DataFrame, as_of: str, daily: float = 10.0, monthly: float = 100.0) -> DataFrame:
    sums = costs.agg(*[F.coalesce(F.sum(F.when(F.col("category") == c, F.col("amount"))), F.lit(0.0)).alias(c) for c in CATEGORIES])
    return cost_total(costs).crossJoin(sums).crossJoin(cost_forecast(costs, as_of)).crossJoin(budget_status(costs, as_of, daily, monthly))


def embedding_share(costs: DataFrame) -> DataFrame:
    share = F.sum(F.when(F.col("category") == "embedding", F.col("amount"))) / F.nullif(F.sum("amount"), F.lit(0.0))
    return costs.agg(F.coalesce(share, F.lit(0.0)).alias("embedding_share")).withColumn("suggest_lite_model", F.col("embedding_share") > 0.5)


# tiers: accesses (chunk_id, ts), tiers (chunk_id, tier)

TIERS = ("hot", "warm", "cold")
HOT, WARM, DAYS = 5, 1, 7


def recent_accesses(accesses: DataFrame, as_of: str, days: int = DAYS) -> DataFrame:
    since = F.lit(as_of).cast("timestamp") - F.expr(f"interval {int(days)} days")
    return accesses.where(F.col("ts") >= since).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("recent"))


def tier_of(ids: DataFrame, tiers: DataFrame) -> DataFrame:
    """An unknown chunk is hot."""
    return ids.join(tiers, "chunk_id", "left").select("chunk_id", F.coalesce("tier", F.lit("hot")).alias("tier"))


def promoted(tier: Column) -> Column:
    return F.when(tier == "cold", "warm").otherwise("hot")


def demoted(tier: Column) -> Column:
    """An unknown chunk, which is hot, becomes warm."""
    return F.when(tier.isNull() | (tier == "hot"), "warm").otherwise("cold")


def record_accesses(tiers: DataFrame, accesses: DataFrame, as_of: str, hot: int = HOT, warm: int = WARM) -> DataFrame:
    """Counts, last access and the tier after automatic promotion of every accessed chunk."""
    seen = accesses.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("access_count"), F.max("ts").alias("last_access"))
    rows = seen.join(tiers, "chunk_id", "left").join(recent_accesses(accesses, as_of), "chunk_id", "left")
    tier, recent = F.coalesce("tier", F.lit("hot")), F.coalesce("recent", F.lit(0))
    return rows.select("chunk_id", "access_count", "last_access", F.when((tier != "hot") & (recent >= hot), "hot").when((tier == "cold") & (recent >= warm), "warm").otherwise(tier).alias("tier"))


def evaluate_tiers(tiers: DataFrame, accesses: DataFrame, as_of: str, hot: int = HOT, warm: int = WARM) -> DataFrame:
    """Suggestions only: ``(chunk_id, tier, recent, action)``."""
    rows = tiers.join(recent_accesses(accesses, as_of), "chunk_id", "left").withColumn("recent", F.coalesce("recent", F.lit(0)))
    t, r = F.col("tier"), F.col("recent")
    action = F.when(t.isin("hot", "warm") & (r < warm), "demote").when(((t == "warm") & (r >= hot)) | ((t == "cold") & (r >= warm)), "promote")
    return rows.withColumn("action", action).where("action is not null").select("chunk_id", "tier", "recent", "action")


def tier_stats(tiers: DataFrame) -> DataFrame:
    """Chunks and share per tier; all three tiers are there."""
    names = tiers.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    n = names.join(tiers.groupBy("tier").agg(F.count(F.lit(1)).alias("n")), "tier", "left").select("tier", F.coalesce("n", F.lit(0)).alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return n.select("tier", "n", F.when(total > 0, F.round(F.col("n") * 100.0 / total, 1)).otherwise(0.0).alias("percent"))


# access: policies (tenant_id, sources); audit: (ts, tenant_id, query, results)


def allowed(source: Column, sources: Column) -> Column:
    """Without a policy all is allowed; ``*`` allows all."""
    return sources.isNull() | F.array_contains(sources, "*") | F.array_contains(sources, source)


def access_filter(results: DataFrame, policies: DataFrame) -> DataFrame:
    """``results (tenant_id, source, ...)`` that the tenant's policy allows."""
    p = policies.select("tenant_id", F.col("sources").alias("_sources"))
    return results.join(p, "tenant_id", "left").where(F.coalesce(allowed(F.col("source"), F.col("_sources")), F.lit(False))).drop("_sources")


def put_policies(policies: DataFrame, new: DataFrame) -> DataFrame:
    return policies.join(new.select("tenant_id"), "tenant_id", "left_anti").select(new.columns).unionByName(new)


def remove_policies(policies: DataFrame, tenants: DataFrame) -> DataFrame:
    return policies.join(tenants.select("tenant_id"), "tenant_id", "left_anti")


def audit_records(results: DataFrame, queries: DataFrame) -> DataFrame:
    """``(ts, tenant_id, query, num_results, results)`` with a preview of 100 characters of each result."""
    row = F.struct("rank", "chunk_id", "source", "score", F.left("content", F.lit(100)).alias("content_preview"))
    per = results.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("results"))
    rows = F.transform("results", lambda r: F.struct(r["chunk_id"].alias("chunk_id"), r["source"].alias("source"), r["score"].alias("score"), r["content_preview"].alias("content_preview")))
    return queries.join(per, "query_id", "left").select("ts", "tenant_id", "query", F.coalesce(F.size("results"), F.lit(0)).alias("num_results"), rows.alias("results"))


def audit_trail(audit: DataFrame, tenant: str | None = None, start: str | None = None, end: str | None = None) -> DataFrame:
    """Both ends inclusive; a filter that isn't given is off."""
    if tenant:
        audit = audit.where(F.col("tenant_id") == tenant)
    if start:
        audit = audit.where(F.col("ts") >= F.lit(start).cast("timestamp"))
    return audit.where(F.col("ts") <= F.lit(end).cast("timestamp")) if end else audit


def audit_csv(audit: DataFrame) -> DataFrame:
    """Flat rows for a CSV file: the best score with four digits and all sources."""
    top = F.coalesce(F.array_max(F.transform("results", lambda r: r["score"])), F.lit(0.0))
    return audit.select(
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), "tenant_id", "query", "num_results", F.format_string("%.4f", top).alias("top_score"),
        F.coalesce(F.array_join(F.transform("results", lambda r: r["source"]), ", "), F.lit("")).alias("sources"),
    )
