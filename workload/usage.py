"""Queries on token usage and cost."""

from pyspark.sql import functions as F

from sourcelode.functions.lookups import PRICES
from sourcelode.operators import usage as use
from sourcelode.session import scratch_path
from sourcelode.sources.sinks import append_usage
from sourcelode.sources.store import HistoryStore
from workload.registry import literal, query

USAGE = ["llm_usage"]


def _pairs(index: int) -> str:
    """Price as SQL: contained key in list order, then the provider's default or first entry."""
    arms = [
        f"WHEN lower(provider) = {literal(p[0])} AND contains(lower(model), {literal(p[1])}) THEN {p[index]!r}"
        for p in PRICES
    ]
    first: dict = {}
    for entry in PRICES:
        first.setdefault(entry[0], entry)
    arms += [f"WHEN lower(provider) = {literal(v)} THEN {e[index]!r}" for v, e in first.items()]
    return f"CAST(CASE {' '.join(arms)} ELSE 0 END AS DOUBLE)"


PRICED = f"""priced AS (SELECT *, prompt_tokens + completion_tokens AS total_tokens, prompt_tokens / 1000.0::DOUBLE * {_pairs(2)} AS prompt_cost,
 completion_tokens / 1000.0::DOUBLE * {_pairs(3)} AS completion_cost FROM llm_usage),
costs AS (SELECT *, prompt_cost + completion_cost AS total_cost FROM priced)"""


@query(
    "price_join",
    f"SELECT usage_id, {_pairs(2)} AS prompt_price, {_pairs(3)} AS completion_price FROM llm_usage",
    USAGE,
)
def _(t):
    pair = use.price(F.lower("provider"), F.lower("model"))
    return t("llm_usage").select("usage_id", pair.alias("p")).select(
        "usage_id", F.col("p.prompt").alias("prompt_price"),
        F.col("p.completion").alias("completion_price"),
    )


@query(
    "estimate_cost",
    "SELECT usage_id, total_tokens, round(prompt_cost, 8) AS prompt_cost, round(completion_cost, 8) AS completion_cost, round(total_cost, 8) AS total_cost FROM costs",
    USAGE,
    PRICED,
)
def _(t):
    return use.with_cost(t("llm_usage")).select(
        "usage_id", "total_tokens",
        *[F.round(c, 8).alias(c) for c in ("prompt_cost", "completion_cost", "total_cost")],
    )


_SUMMARY = """count(*) AS total_requests, CAST(sum(prompt_tokens) AS BIGINT) AS total_prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS total_completion_tokens,
 CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(total_cost), 4) AS total_cost_usd, round(sum(total_cost) / count(*), 4) AS avg_cost_per_request"""


@query("cost_summary", f"SELECT provider, {_SUMMARY} FROM costs GROUP BY ROLLUP (provider)", USAGE, PRICED)
def _(t):
    return use.cost_summary(t("llm_usage"))


@query(
    "track_usage",
    f"SELECT provider, {_SUMMARY} FROM costs GROUP BY ROLLUP (provider)",
    USAGE,
    PRICED,
)
def _(t):
    """Usage appended to a log in two batches, one of them twice, then summed from the log."""
    rows, path = t("llm_usage"), scratch_path(t.spark, "usage")
    early = F.col("completion_tokens") < 250
    for batch, chosen in ((0, early), (1, ~early), (1, ~early)):
        append_usage(rows.where(chosen), path, batch)
    return use.cost_summary(t.spark.read.parquet(path))


@query(
    "provider_breakdown",
    """SELECT lower(provider) AS provider, count(*) AS requests, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
 CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(total_cost), 4) AS total_cost_usd, CAST(round_even(sum(total_tokens) / count(*), 0) AS BIGINT) AS avg_tokens_per_request,
 round(sum(total_cost) / count(*), 4) AS avg_cost_per_request FROM costs GROUP BY 1""",
    USAGE,
    PRICED,
)
def _(t):
    return use.provider_breakdown(t("llm_usage"))


@query(
    "usage_export",
    """SELECT usage_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp, provider, model, prompt_tokens, completion_tokens, total_tokens,
 round(total_cost, 8) AS estimated_cost FROM costs""",
    USAGE,
    PRICED,
)
def _(t):
    return use.usage_export(t("llm_usage")).withColumn("estimated_cost", F.round("estimated_cost", 8))


_METRICS = """metrics AS (SELECT scan_id, provider, model, count(*) AS total_requests, count(*) FILTER (WHERE ok) AS successful_requests,
 count(*) FILTER (WHERE NOT ok) AS failed_requests, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens,
 CAST(sum(total_tokens) AS BIGINT) AS total_tokens, sum(total_cost) AS estimated_cost FROM costs GROUP BY ALL)"""


@query(
    "save_usage",
    """SELECT * EXCLUDE (estimated_cost), round(estimated_cost, 10) AS estimated_cost FROM metrics
 WHERE scan_id IN (SELECT scan_id FROM scan_records)""",
    ["llm_usage", "scan_records"],
    f"{PRICED},\n{_METRICS}",
)
def _(t):
    """Metrics stored in the history, dated by their scan, and read back."""
    store = HistoryStore(t.spark, scratch_path(t.spark, "history"), "year")
    dates = t("scan_records").select("scan_id", F.col("scan_timestamp").alias("created_at"))
    store.put("usage_metrics", use.save_usage(t("llm_usage"), t("scan_records")).join(dates, "scan_id"))
    return store.table("usage_metrics").select(
        F.col("scan_id").cast("long").alias("scan_id"), "provider", "model", "total_requests",
        "successful_requests", "failed_requests", "prompt_tokens", "completion_tokens",
        "total_tokens", F.round("estimated_cost", 10).alias("estimated_cost"),
    )


@query(
    "usage_by_model",
    """SELECT provider, model, CAST(sum(total_requests) AS BIGINT) AS total_requests, round(sum(estimated_cost), 9) AS total_cost FROM metrics GROUP BY ALL""",
    USAGE,
    f"{PRICED},\n{_METRICS}",
)
def _(t):
    return use.usage_by_model(use.usage_metrics(t("llm_usage"))).withColumn(
        "total_cost", F.round("total_cost", 9)
    )


@query(
    "usage_metrics_rollup",
    """SELECT m.scan_id, round(c, 11) AS estimated_cost, r AS total_requests, coalesce(n, 0) AS vulnerabilities, round(CASE WHEN n > 0 THEN c / n END, 11) AS cost_per_vulnerability FROM
 (SELECT scan_id, sum(estimated_cost) AS c, CAST(sum(total_requests) AS BIGINT) AS r FROM metrics GROUP BY scan_id) m
 LEFT JOIN (SELECT scan_id, count(*) AS n FROM vulnerability_records GROUP BY scan_id) v ON m.scan_id = v.scan_id""",
    ["llm_usage", "vulnerability_records"],
    f"{PRICED},\n{_METRICS}",
)
def _(t):
    rolled = use.cost_per_finding(use.usage_metrics(t("llm_usage")), t("vulnerability_records"))
    return rolled.withColumns(
        {c: F.round(c, 11) for c in ("estimated_cost", "cost_per_vulnerability")}
    )


@query(
    "cache_hit_rate",
    """SELECT provider, CAST(sum(n - 1) AS BIGINT) AS cache_hits, count(*) AS cache_misses, round(sum(n - 1) / sum(n), 6) AS cache_hit_rate
 FROM (SELECT provider, prompt_tokens, count(*) AS n FROM llm_usage GROUP BY ALL) GROUP BY provider""",
    USAGE,
)
def _(t):
    """Requests with the same prompt size stand for the same prompt."""
    rates = use.cache_hit_rate(t("llm_usage"), "prompt_tokens", ("provider",))
    return rates.withColumn("cache_hit_rate", F.round("cache_hit_rate", 6))


@query(
    "budget_alert",
    """SELECT strftime(ts, '%Y-%m-%d') AS day, round(sum(total_cost), 9) AS cost_usd,
 CASE WHEN sum(total_cost) >= 10 THEN 'exceeded' WHEN sum(total_cost) >= 8 THEN 'warning' ELSE 'ok' END AS state FROM costs GROUP BY 1""",
    USAGE,
    PRICED,
)
def _(t):
    return use.budget_alert(t("llm_usage")).select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.round("cost_usd", 9).alias("cost_usd"), "state"
    )
