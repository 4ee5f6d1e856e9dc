"""Running cost of token usage."""

from pyspark.sql import DataFrame, functions as F

from sourcelode.operators.usage import DAILY_LIMIT_USD, WARN_SHARE, budget_state, with_cost

DELAY = "1 hour"


def _windowed(usage: DataFrame, delay: str, window: str, by) -> DataFrame:
    """Totals per window, partially summed in every task before the shuffle."""
    return (
        with_cost(usage).withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("w"), *by)
        .agg(
            F.count(F.lit(1)).alias("total_requests"),
            F.sum("total_tokens").alias("total_tokens"),
            F.sum("total_cost").alias("cost_usd"),
        )
        .select(F.col("w.start").alias("window_start"), *by, "total_requests", "total_tokens", "cost_usd")
    )


def stream_cost(usage: DataFrame, delay: str = DELAY, window: str = "1 day") -> DataFrame:
    """Cost per window and provider, emitted once the watermark has passed the window's end.

    Rows later than ``delay`` are dropped, which bounds the state to the open windows.
    """
    return _windowed(usage, delay, window, ["provider"])


def stream_budget(
    usage: DataFrame, limit: float = DAILY_LIMIT_USD, warn: float = WARN_SHARE, delay: str = DELAY
) -> DataFrame:
    """Daily cost against the limit."""
    daily = _windowed(usage, delay, "1 day", [])
    return daily.withColumn("state", budget_state("cost_usd", limit, warn))
