"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelode.llm.storage import removed, written


def components(links: DataFrame, rounds: int = 64) -> DataFrame:
    """node, component for every node of ``links`` (left, right); the component is the smallest node
    that can be reached.

    Large-star and small-star rounds: every node links its larger neighbours to its smallest one, then
    its smaller neighbours too, until nothing changes. Each round is aggregations and joins on the
    node, written to the shared folder; the driver sees two numbers per round. A node with most of
    the links is summed inside tasks first.
    """
    pairs = links.where("left <> right").select(F.least("left", "right").alias("low"), F.greatest("left", "right").alias("high"))
    edges = written(pairs.distinct(), "links")
    state = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("high").alias("low"), F.col("low").alias("high")))
        least = both.groupBy(F.col("low").alias("node")).agg(F.least(F.min("high"), F.first("low")).alias("root"))
        # Large star: of each node, the larger neighbours meet its least neighbour or itself.
        star = both.withColumnRenamed("low", "node").where("high > node").join(least, "node").select(F.col("root").alias("low"), "high")
        star = star.where("low <> high").distinct()
        # Small star: of each node, the smaller neighbours and itself meet the least of them.
        down = star.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("root"))
        small = star.select(F.col("high").alias("node"), "low").join(down, "node")
        small = small.select(F.col("root").alias("low"), F.explode(F.array("low", "node")).alias("high")).where("low <> high").distinct()
        before, edges = edges, written(small, "links")
        removed(before)  # the new links stand by themselves
        seen = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("low", "high").cast("decimal(20,0)")).alias("sum")).first()
        if state == (seen["n"], seen["sum"]):
            break
        state = (seen["n"], seen["sum"])
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return edges.select(F.col("high").alias("node"), F.col("low").alias("component")).unionByName(
        edges.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct()
    )
