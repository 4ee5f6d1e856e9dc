"""Mixing sources to target weights with a tree of budgets, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("domain", "lang", "source")
#: Hex digits of the order key that number a leaf's slices; 16**3 slices per leaf.
SLICE_DIGITS = 3
#: Tasks among which the rows of a leaf are dealt when they meet its budget.
SALTS = 32


def _with_leaf(rows: DataFrame, leaves: DataFrame, path: list[str]) -> DataFrame:
    """``rows`` joined to the one row of their leaf; a leaf may hold any share of all rows, so its
    rows are dealt to ``SALTS`` tasks by doc_id and its row is repeated for each."""
    dealt = rows.withColumn("mix_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    copies = leaves.withColumn("mix_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return dealt.join(copies, [*path, "mix_salt"]).drop("mix_salt")


def count_tokens(text: Column) -> Column:
    """Words, runs of characters other than white space; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("bigint")


def first_tokens(text: Column, tokens: Column) -> Column:
    """The text up to its ``tokens``-th word, white space as it was."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(r"(\s*\S+)"), F.lit(1)), F.lit(1), tokens.cast("int")), "")


def weight_of(level: Column, weights: Mapping[str, int], default: int) -> Column:
    """Integer weight of a node, ``default`` for names without one."""
    chain = F
    for name, weight in weights.items():
        chain = chain.when(level == name, F.lit(weight))
    return (chain.otherwise(F.lit(default)) if weights else F.lit(default)).cast("bigint")


def _share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Split ``budget`` of each parent over its children in proportion to ``weight``, none above its
    ``capacity``: what a full child leaves goes to its siblings by their weights.

    In order of capacity per weight, child i is full if its capacity is at most its share of what
    the earlier ones leave. The others split the rest in whole tokens; the odd tokens go to the
    first of them, by name.
    """
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = group.orderBy((F.col("capacity") / F.col("weight")), name)
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    wide = lambda c: c.cast("decimal(38,0)")
    nodes = (
        nodes.withColumn("left", F.col("budget") - F.coalesce(F.sum("capacity").over(earlier), F.lit(0)))
        .withColumn("weights", F.sum("weight").over(later))
        .withColumn("full", wide(F.col("capacity")) * F.col("weights") <= wide(F.col("left")) * F.col("weight"))
    )
    # Full children come first in this order: the share of the rest only grows along it.
    rest = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    open_ = ~F.col("full")
    nodes = (
        nodes.withColumn("rest", F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(rest), F.lit(0)))
        .withColumn("weights", F.sum(F.when(open_, F.col("weight"))).over(rest))
        .withColumn("part", F.when(open_, F.expr("CAST(CAST(rest AS DECIMAL(20,0)) * CAST(weight AS DECIMAL(18,0)) AS DECIMAL(38,0)) div weights")))
        .withColumn("odd", F.col("rest") - F.sum("part").over(rest))
        .withColumn("nth", F.row_number().over(Window.partitionBy(*parents, "full").orderBy(name) if parents else Window.partitionBy("full").orderBy(name)))
    )
    budget = F.when(F.col("full"), F.col("capacity")).otherwise(F.col("part") + (F.col("nth") <= F.col("odd")).cast("bigint"))
    return nodes.withColumn("budget", budget.cast("bigint")).drop("left", "weights", "full", "rest", "part", "odd", "nth")


def leaf_budgets(leaves: DataFrame, share: int, max_epochs: int, weights: Mapping[str, Column]) -> DataFrame:
    """Token budgets of all leaves: ``share`` thousandths of all tokens go to the domains, theirs to
    their languages, theirs to the sources. A node can take ``max_epochs`` times the tokens below it,
    so a shortage moves to siblings first and reaches the next level up only when they are full."""
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs).where(F.col("capacity") > 0)
    budgets = None
    for depth, name in enumerate(LEVELS):
        path, parents = list(LEVELS[: depth + 1]), list(LEVELS[:depth])
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity")) if depth < len(LEVELS) - 1 else leaves
        nodes = nodes.withColumn("weight", weights[name])
        if budgets is None:
            everything = F.sum("capacity").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("all_capacity", everything).withColumn(
                "budget", F.expr(f"least(CAST(all_capacity div {max_epochs} AS DECIMAL(20,0)) * {share} div 1000, all_capacity)")
            ).drop("all_capacity")
        else:
            nodes = nodes.join(budgets, parents)
        budgets = _share(nodes, parents, name)
        if depth < len(LEVELS) - 1:
            budgets = budgets.select(*path, "budget")
    return budgets.select(*LEVELS, "tokens", "budget")


def mix(
    docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], defaults: Mapping[str, int],
    keep_share: float = 1.0, max_epochs: int = 4, seed: int = 17,
) -> DataFrame:
    """Choose documents, some several times, so that tokens follow a tree of target weights.

    ``docs`` needs doc_id, text, lang and source; ``domain`` is a column of it. ``weights`` maps
    each of ``domain``, ``lang`` and ``source`` to positive integer weights by name, ``defaults`` has
    those of all other names (NULL is named ``unknown``). The target is ``keep_share`` (in
    thousandths, rounded) of all tokens, or all that ``max_epochs`` passes can give if that is less.

    Returns the columns of ``docs`` with ``mix_domain``, ``mix_lang``, ``mix_source``, ``mix_tokens``, ``mix_epoch`` and
    ``mix_take``: one row per document and epoch in which it is taken, whole unless ``mix_take`` is
    below ``mix_tokens``. A leaf of budget B and A tokens gives B div A whole epochs and B mod A
    tokens of the next one, in the order of md5(seed:epoch:doc_id); rows of one doc_id
    share a place. The document that crosses the end is taken up to it (each of its rows, if there
    are several). Documents without words are
    taken with the whole epochs and before the end of the last one. A table without any word
    gives no rows. Columns of these names in ``docs`` are replaced.

    Only ids and token counts are shuffled to find the end of a leaf: whole slices of its order are
    summed, and only the slice in which it ends is sorted. Texts meet one row per leaf.
    """
    key = lambda epoch: F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    path = [f"mix_{x}" for x in LEVELS]
    named = lambda c: F.coalesce(c.cast("string"), F.lit("unknown"))
    docs = docs.drop(*path, "mix_tokens", "mix_epoch", "mix_take", "mix_salt")
    marked = docs.select(
        "*", named(domain).alias(path[0]), named(F.col("lang")).alias(path[1]), named(F.col("source")).alias(path[2]),
        count_tokens(F.col("text")).alias("mix_tokens"),
    )
    light = marked.select(*(F.col(p).alias(x) for p, x in zip(path, LEVELS, strict=True)), "doc_id", F.col("mix_tokens").alias("n"))
    leaves = light.groupBy(*LEVELS).agg(F.sum("n").alias("tokens"))
    share = round(keep_share * 1000)
    level_weights = {x: weight_of(F.col(x), weights.get(x, {}), defaults[x]) for x in LEVELS}
    plan = leaf_budgets(leaves, share, max_epochs, level_weights).select(
        *LEVELS, F.expr("budget div tokens").alias("epochs"), (F.col("budget") % F.col("tokens")).alias("rest")
    )
    keyed = _with_leaf(light, plan.where("rest > 0"), list(LEVELS)).withColumn("key", key(F.col("epochs")))
    units = keyed.withColumn("slice", F.substring("key", 1, SLICE_DIGITS))
    slices = units.groupBy(*LEVELS, "slice").agg(F.sum("n").alias("n"), F.first("rest").alias("rest"))
    running = Window.partitionBy(*LEVELS).orderBy("slice")
    ends = (
        slices.withColumn("before", F.sum("n").over(running) - F.col("n"))
        .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("n") >= F.col("rest")))
        .select(*LEVELS, "slice", "before", "rest")
    )
    # Rows of the slice in which a leaf ends, one per order key.
    last = (
        units.drop("rest").join(ends, [*LEVELS, "slice"]).groupBy(*LEVELS, "key").agg(F.sum("n").alias("n"), F.first("before").alias("before"), F.first("rest").alias("rest"))
        .withColumn("start", F.col("before") + F.sum("n").over(running.orderBy("key")) - F.col("n"))
        .where((F.col("start") < F.col("rest")) & (F.col("start") + F.col("n") >= F.col("rest")))
        .select(*LEVELS, F.col("key").alias("end_key"), (F.col("rest") - F.col("start")).alias("end_take"))
    )
    whole = plan.join(last, list(LEVELS), "left").select(*(F.col(x).alias(p) for p, x in zip(path, LEVELS, strict=True)), "epochs", "end_key", "end_take")
    row_key = key(F.col("epochs"))
    taken = _with_leaf(marked, whole, path).withColumn("row_key", F.when(F.col("end_key").isNotNull(), row_key))
    count = F.col("epochs") + F.coalesce((F.col("row_key") <= F.col("end_key")).cast("bigint"), F.lit(0))
    taken = taken.withColumn("copies", count).where(F.col("copies") > 0)
    taken = taken.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("copies") - 1)))
    cut = (F.col("mix_epoch") == F.col("epochs")) & (F.col("row_key") == F.col("end_key"))
    taken = taken.withColumn("mix_take", F.when(cut, F.least("end_take", "mix_tokens")).otherwise(F.col("mix_tokens")))
    return taken.select(*docs.columns, *path, "mix_tokens", "mix_epoch", "mix_take")
