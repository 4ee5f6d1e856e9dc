"""Token usage: price it, roll it up, watch the budget."""

from pyspark.sql import Column, DataFrame, functions as F

from sourcelode.functions.lookups import PRICES
from sourcelode.functions.text import as_column

# Daily limit in US dollars and the share of it that warns.
DAILY_LIMIT_USD = 10.0
WARN_SHARE = 0.8


def price(provider, model, prices=PRICES) -> Column:
    """Prompt and completion price per 1000 tokens.

    The price list is a short fixed list, so "model contains key, first in list order" is a chain
    of tests instead of a join. An unmatched model of a known provider takes the provider's
    ``default`` entry, else its first; an unknown provider costs nothing.
    """
    vendor, name = as_column(provider), as_column(model)
    fallback: dict = {}
    for entry in prices:
        if entry[0] not in fallback or entry[1] == "default":
            fallback[entry[0]] = entry

    def pair(entry) -> Column:
        return F.struct(F.lit(entry[2]).alias("prompt"), F.lit(entry[3]).alias("completion"))

    chain = None
    for entry in [*prices, *[(v, "", e[2], e[3]) for v, e in fallback.items()]]:
        test = (vendor == entry[0]) & name.contains(entry[1])
        chain = F.when(test, pair(entry)) if chain is None else chain.when(test, pair(entry))
    return chain.otherwise(pair(("", "", 0.0, 0.0)))


def with_cost(usage: DataFrame, prices=PRICES) -> DataFrame:
    """Add ``total_tokens``, ``prompt_cost``, ``completion_cost`` and ``total_cost``."""
    lowered = usage.withColumn("_vendor", F.lower("provider")).withColumn("_name", F.lower("model"))
    priced = lowered.withColumn("_price", price("_vendor", "_name", prices))
    return (
        priced.withColumn("total_tokens", F.col("prompt_tokens") + F.col("completion_tokens"))
        .withColumn("prompt_cost", F.col("prompt_tokens") / 1000.0 * F.col("_price.prompt"))
        .withColumn("completion_cost", F.col("completion_tokens") / 1000.0 * F.col("_price.completion"))
        .withColumn("total_cost", F.col("prompt_cost") + F.col("completion_cost"))
        .drop("_vendor", "_name", "_price")
    )


def cost_summary(usage: DataFrame) -> DataFrame:
    """Requests, tokens and cost per provider as written, and for all (NULL provider)."""
    total = F.sum("total_cost")
    return (
        with_cost(usage).rollup("provider")
        .agg(
            F.count(F.lit(1)).alias("total_requests"),
            F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("total_prompt_tokens"),
            F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("total_completion_tokens"),
            F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
            F.coalesce(F.round(total, 4), F.lit(0.0)).alias("total_cost_usd"),
            F.coalesce(F.round(total / F.count(F.lit(1)), 4), F.lit(0.0)).alias("avg_cost_per_request"),
        )
    )


def provider_breakdown(usage: DataFrame, provider: str | None = None) -> DataFrame:
    """Totals per provider ignoring case. A named provider without usage gives a zero row."""
    vendor = F.lower("provider")
    chosen = with_cost(usage if provider is None else usage.where(vendor == provider.lower()))
    requests = F.count(F.lit(1))
    measures = [
        requests.alias("requests"),
        F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"),
        F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.coalesce(F.round(F.sum("total_cost"), 4), F.lit(0.0)).alias("total_cost_usd"),
        # Halves round to the even neighbour.
        F.coalesce(F.bround(F.sum("total_tokens") / requests, 0), F.lit(0.0)).cast("long")
        .alias("avg_tokens_per_request"),
        F.coalesce(F.round(F.sum("total_cost") / requests, 4), F.lit(0.0)).alias("avg_cost_per_request"),
    ]
    if provider is None:
        return chosen.groupBy(vendor.alias("provider")).agg(*measures)
    return chosen.agg(*measures).select(F.lit(provider).alias("provider"), "*")


def usage_export(usage: DataFrame) -> DataFrame:
    """The usage history with the cost of each row."""
    return with_cost(usage).select(
        "usage_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
        "provider", "model", "prompt_tokens", "completion_tokens", "total_tokens",
        F.col("total_cost").alias("estimated_cost"),
    )


def usage_metrics(usage: DataFrame) -> DataFrame:
    """Usage rows -> one metrics row per scan, provider and model."""
    return with_cost(usage).groupBy("scan_id", "provider", "model").agg(
        F.count(F.lit(1)).alias("total_requests"),
        F.count_if("ok").alias("successful_requests"),
        F.count_if(~F.col("ok")).alias("failed_requests"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("total_cost").alias("estimated_cost"),
    )


def save_usage(usage: DataFrame, scans: DataFrame) -> DataFrame:
    """Metrics rows to store: those whose scan exists."""
    return usage_metrics(usage).join(scans.select("scan_id"), "scan_id", "left_semi")


def usage_by_model(metrics: DataFrame) -> DataFrame:
    return metrics.groupBy("provider", "model").agg(
        F.sum("total_requests").alias("total_requests"),
        F.sum("estimated_cost").alias("total_cost"),
    )


def cost_per_finding(metrics: DataFrame, findings: DataFrame) -> DataFrame:
    """Cost per finding of each scan with usage; both sides shrink to a row per scan first."""
    cost = metrics.groupBy("scan_id").agg(
        F.sum("estimated_cost").alias("estimated_cost"),
        F.sum("total_requests").alias("total_requests"),
    )
    found = findings.groupBy("scan_id").agg(F.count(F.lit(1)).alias("vulnerabilities"))
    return cost.join(found, "scan_id", "left").select(
        "scan_id", "estimated_cost", "total_requests",
        F.coalesce("vulnerabilities", F.lit(0)).alias("vulnerabilities"),
        F.when(F.col("vulnerabilities") > 0, F.col("estimated_cost") / F.col("vulnerabilities"))
        .alias("cost_per_vulnerability"),
    )


def cache_hit_rate(requests: DataFrame, request_key: str, by=()) -> DataFrame:
    """Repeated requests a cache would answer: each distinct key misses once."""
    per_key = requests.groupBy(*by, request_key).agg(F.count(F.lit(1)).alias("_n"))
    counted = per_key.groupBy(*by).agg(
        F.sum(F.col("_n") - 1).alias("cache_hits"), F.count(F.lit(1)).alias("cache_misses")
    )
    total = F.col("cache_hits") + F.col("cache_misses")
    return counted.withColumn("cache_hit_rate", F.col("cache_hits") / total)


def budget_state(cost, limit: float = DAILY_LIMIT_USD, warn: float = WARN_SHARE) -> Column:
    column = as_column(cost)
    return (
        F.when(column >= limit, "exceeded").when(column >= limit * warn, "warning").otherwise("ok")
    )


def budget_alert(usage: DataFrame, limit: float = DAILY_LIMIT_USD, warn: float = WARN_SHARE):
    """Daily cost against the limit."""
    daily = with_cost(usage).groupBy(F.to_date("ts").alias("day")).agg(
        F.sum("total_cost").alias("cost_usd")
    )
    return daily.withColumn("state", budget_state("cost_usd", limit, warn))
