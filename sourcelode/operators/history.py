"""Scan history: look up, filter, compare, track status, expire."""

from pyspark.sql import Column, DataFrame, Window, functions as F

from sourcelode.operators.summary import severity_counts, severity_rank
from sourcelode.functions.paths import base_name

ISSUE = ("vulnerability_type", "file_path", "line_number")


def scan_findings(scans: DataFrame, findings: DataFrame, scan_id=None, severity=None) -> DataFrame:
    """Findings joined to their scans, for one scan and severity or all."""
    if scan_id is not None:
        scans, findings = scans.where(F.col("scan_id") == scan_id), findings.where(
            F.col("scan_id") == scan_id)
    if severity is not None:
        findings = findings.where(F.col("severity") == severity)
    return scans.join(findings, "scan_id")


def recent_high(scans: DataFrame, findings: DataFrame, as_of, days: int = 7) -> DataFrame:
    """HIGH findings of scans in the ``days`` before ``as_of``, newest first."""
    start = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return (
        scans.where(F.col("scan_timestamp").cast("timestamp_ntz") > start)
        .select("scan_id", "scan_timestamp")
        .join(findings.where(F.col("severity") == "HIGH"), "scan_id")
        .select("scan_id", "scan_timestamp", *ISSUE)
        .orderBy(F.desc("scan_timestamp"), "scan_id", *ISSUE)
    )


def recent_scans(scans: DataFrame, limit: int = 10, target_path: str | None = None) -> DataFrame:
    if target_path is not None:
        scans = scans.where(F.col("target_path") == target_path)
    return scans.orderBy(F.desc("scan_timestamp"), "scan_id").limit(limit)


def with_finding_counts(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Scans with their severity counts; a scan without findings has zeros."""
    counts = severity_counts(findings)
    names = [name for name in counts.columns if name != "scan_id"]
    return scans.join(counts, "scan_id", "left").na.fill(0, names)


def show_scan(scans: DataFrame, findings: DataFrame, first: int = 20) -> DataFrame:
    """Per scan: totals and the first findings (file names only); ``more`` counts the rest.

    The row limit per scan is applied inside every task before the shuffle.
    """
    order = Window.partitionBy("scan_id").orderBy("file_path", "line_number", "vulnerability_type", "finding_id")
    top = (
        findings.withColumn("position", F.row_number().over(order))
        .where(F.col("position") <= first)
        .select(
            "scan_id", "position", "vulnerability_type", "severity",
            base_name("file_path").alias("file_name"),
            F.coalesce(F.col("line_number").cast("string"), F.lit("N/A")).alias("line"),
        )
    )
    totals = with_finding_counts(scans.select("scan_id", "target_path"), findings)
    return totals.join(top, "scan_id", "left").withColumn(
        "more", F.greatest(F.col("total_vulnerabilities") - first, F.lit(0))
    )


def scan_statistics(scans: DataFrame, start=None, end=None) -> DataFrame:
    """Totals and averages over scans within inclusive dates; zeros when there are none."""
    stamp = F.col("scan_timestamp").cast("timestamp_ntz")
    if start is not None:
        scans = scans.where(stamp >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        scans = scans.where(stamp <= F.lit(end).cast("timestamp_ntz"))
    zero, none = F.lit(0), F.lit(0.0)
    return scans.agg(
        F.count(F.lit(1)).alias("total_scans"),
        F.coalesce(F.sum("total_vulnerabilities"), zero).alias("total_vulnerabilities"),
        F.coalesce(F.avg("total_vulnerabilities"), none).alias("avg_vulnerabilities_per_scan"),
        F.coalesce(F.sum("files_scanned"), zero).alias("total_files_scanned"),
        F.coalesce(F.avg("scan_duration"), none).alias("avg_scan_duration"),
    )


def pattern_usage(findings: DataFrame) -> DataFrame:
    """Rule counters from reviewed findings: a false_positive status counts against the rule."""
    wrong = F.count_if(F.col("status") == "false_positive")
    return (
        findings.groupBy(F.col("vulnerability_type").alias("pattern_name"))
        .agg(
            F.count(F.lit(1)).alias("times_triggered"),
            (F.count(F.lit(1)) - wrong).alias("true_positives"),
            wrong.alias("false_positives"),
            F.avg(severity_rank()).alias("avg_severity"),
            F.min("created_at").alias("first_used"),
            F.max("created_at").alias("last_used"),
        )
        .withColumn("accuracy_rate", _accuracy())
    )


def _accuracy() -> Column:
    right, wrong = F.col("true_positives"), F.col("false_positives")
    return F.when(right + wrong > 0, right / (right + wrong))


def sum_pattern_usage(counters: DataFrame) -> DataFrame:
    """Counters of several periods or loads -> one row per rule."""
    weighted = F.sum(F.col("avg_severity") * F.col("times_triggered"))
    return (
        counters.groupBy("pattern_name")
        .agg(
            (weighted / F.sum("times_triggered")).alias("avg_severity"),
            F.sum("times_triggered").alias("times_triggered"),
            F.sum("true_positives").alias("true_positives"),
            F.sum("false_positives").alias("false_positives"),
            F.min("first_used").alias("first_used"),
            F.max("last_used").alias("last_used"),
        )
        .withColumn("accuracy_rate", _accuracy())
    )


def merge_pattern_usage(totals: DataFrame, latest: DataFrame) -> DataFrame:
    """Add new counters to stored ones: both tables have one row per rule."""
    columns = [
        "pattern_name", "times_triggered", "true_positives", "false_positives", "avg_severity",
        "first_used", "last_used",
    ]
    return sum_pattern_usage(totals.select(*columns).unionByName(latest.select(*columns)))


def top_patterns(usage: DataFrame, limit: int = 50) -> DataFrame:
    return usage.orderBy(F.desc("times_triggered"), "pattern_name").limit(limit)


def patterns_by_accuracy(usage: DataFrame) -> DataFrame:
    return usage.orderBy(F.desc_nulls_last("accuracy_rate"), "pattern_name")


# --- comparing scans -------------------------------------------------------------------------


def _issue_changes(sides: DataFrame, pair=()) -> DataFrame:
    """``sides``: rows with an issue and its rank in the baseline or in the current scan.

    Grouping treats NULL lines as equal and removes repeated issues; copies collapse inside each
    task before anything is shuffled.
    """
    return sides.groupBy(*pair, *ISSUE).agg(
        F.max("base_rank").alias("base_rank"), F.max("cur_rank").alias("cur_rank")
    )


def _two_sides(findings: DataFrame, baseline, current) -> DataFrame:
    rank = severity_rank()
    return findings.where(F.col("scan_id").isin(baseline, current)).select(
        *ISSUE,
        F.when(F.col("scan_id") == baseline, rank).alias("base_rank"),
        F.when(F.col("scan_id") == current, rank).alias("cur_rank"),
    )


def new_findings(findings: DataFrame, baseline, current) -> DataFrame:
    """Issues of the current scan that the baseline does not have."""
    changes = _issue_changes(_two_sides(findings, baseline, current))
    return changes.where("base_rank IS NULL").select(*ISSUE)


def fixed_findings(findings: DataFrame, baseline, current) -> DataFrame:
    """Issues of the baseline that the current scan no longer has."""
    changes = _issue_changes(_two_sides(findings, baseline, current))
    return changes.where("cur_rank IS NULL").select(*ISSUE)


def _tally() -> list:
    base, cur = F.col("base_rank"), F.col("cur_rank")
    return [
        F.count_if(base.isNull() & cur.isNotNull()).alias("new_vulnerabilities"),
        F.count_if(base.isNotNull() & cur.isNull()).alias("fixed_vulnerabilities"),
        F.count_if(base.isNotNull() & cur.isNotNull()).alias("persistent_vulnerabilities"),
        F.count_if(cur > base).alias("severity_increased"),
        F.count_if(cur < base).alias("severity_decreased"),
        F.coalesce(F.sum(F.coalesce(cur + 1, F.lit(0)) - F.coalesce(base + 1, F.lit(0))), F.lit(0))
        .cast("double").alias("risk_score_change"),
    ]


def _trend() -> Column:
    new, fixed = F.col("new_vulnerabilities"), F.col("fixed_vulnerabilities")
    return F.when(new > fixed, "degraded").when(new < fixed, "improved").otherwise("stable")


def compare_scans(scans: DataFrame, findings: DataFrame, baseline, current) -> DataFrame:
    """Set difference of two scans and the trend; no row when either scan is unknown."""
    found = scans.where(F.col("scan_id").isin(baseline, current)).agg(
        F.count_distinct("scan_id")
    )
    tally = _issue_changes(_two_sides(findings, baseline, current)).agg(*_tally())
    return tally.where(found.scalar() == len({baseline, current})).select(
        F.lit(baseline).alias("baseline_scan_id"),
        F.lit(current).alias("current_scan_id"),
        *tally.columns,
        _trend().alias("overall_trend"),
    )


def scan_order(scans: DataFrame, bucket: str = "day") -> DataFrame:
    """Each scan with its neighbours on the same target (by time, then id).

    Scans are ordered per target and time bucket, and only bucket ends per target, so a target
    with very many scans is no single task's work. Scans without a time come first.
    """
    # Structs are equal where their NULLs are, which keeps NULL targets and times in the join.
    keyed = scans.select("scan_id", "target_path", "scan_timestamp").withColumn(
        "_bucket", F.struct("target_path", F.date_trunc(bucket, "scan_timestamp").alias("start"))
    )
    order = F.struct("scan_timestamp", "scan_id")
    inside = Window.partitionBy("_bucket").orderBy("scan_timestamp", "scan_id")
    buckets = keyed.groupBy("_bucket").agg(
        F.min_by("scan_id", order).alias("_first"), F.max_by("scan_id", order).alias("_last")
    )
    across = Window.partitionBy("_bucket.target_path").orderBy("_bucket.start")
    around = buckets.select(
        "_bucket",
        F.lag("_last").over(across).alias("_earlier"),
        F.lead("_first").over(across).alias("_later"),
    )
    return (
        keyed.withColumn("_previous", F.lag("scan_id").over(inside))
        .withColumn("_next", F.lead("scan_id").over(inside))
        .join(around, "_bucket")
        .select(
            "target_path", "scan_id", "scan_timestamp",
            F.coalesce("_previous", "_earlier").alias("previous_scan_id"),
            F.coalesce("_next", "_later").alias("next_scan_id"),
        )
    )


def scan_trend(scans: DataFrame, findings: DataFrame, bucket: str = "day") -> DataFrame:
    """Comparison of every scan with the previous one of its target, in one pass over findings.

    A finding counts as current for its own scan and as baseline for the following one.
    """
    ordered = scan_order(scans, bucket)
    rank = severity_rank()
    roles = F.array(
        F.when(
            F.col("previous_scan_id").isNotNull(),
            F.struct(
                F.col("scan_id").alias("pair"), F.lit(None).cast("int").alias("base_rank"),
                rank.alias("cur_rank"),
            ),
        ),
        F.when(
            F.col("next_scan_id").isNotNull(),
            F.struct(
                F.col("next_scan_id").alias("pair"), rank.alias("base_rank"),
                F.lit(None).cast("int").alias("cur_rank"),
            ),
        ),
    )
    # Both sides of this join are plain shuffles on scan_id: adaptive execution splits a scan
    # that owns a large share of the findings.
    sides = (
        findings.select("scan_id", *ISSUE, "severity")
        .join(ordered.select("scan_id", "previous_scan_id", "next_scan_id"), "scan_id")
        .select(*ISSUE, F.explode(roles).alias("_r"))
        .where(F.col("_r").isNotNull())
        .select(
            F.col("_r.pair").alias("scan_id"), *ISSUE, F.col("_r.base_rank").alias("base_rank"),
            F.col("_r.cur_rank").alias("cur_rank"),
        )
    )
    tally = _issue_changes(sides, ("scan_id",)).groupBy("scan_id").agg(*_tally())
    counts = [name for name in tally.columns if name != "scan_id"]
    return (
        ordered.where("previous_scan_id IS NOT NULL")
        .join(tally, "scan_id", "left")
        .na.fill(0, counts)
        .select(
            "target_path", F.col("previous_scan_id").alias("baseline_scan_id"),
            F.col("scan_id").alias("current_scan_id"), "scan_timestamp", *counts,
            _trend().alias("overall_trend"),
        )
    )


def degraded_comparisons(comparisons: DataFrame) -> DataFrame:
    return comparisons.where(F.col("overall_trend") == "degraded").orderBy(
        F.desc("scan_timestamp"), "current_scan_id"
    )


# --- rows ------------------------------------------------------------------------------------


def lookup_rows(table: DataFrame, key: str, value) -> DataFrame:
    return table.where(F.col(key) == value)


def filter_findings(findings: DataFrame, scan_id, severity=None, status=None) -> DataFrame:
    chosen = findings.where(F.col("scan_id") == scan_id)
    if severity is not None:
        chosen = chosen.where(F.col("severity") == severity)
    if status is not None:
        chosen = chosen.where(F.col("status") == status)
    return chosen


def update_status(findings: DataFrame, updates: DataFrame, key="finding_id") -> DataFrame:
    """Apply status updates (``key, status, updated_at, seq, fixed_in_commit``), the last one wins.

    ``fixed_at`` is the update's time when the status becomes fixed; a commit is only overwritten
    by a given one; updates of unknown findings do nothing.
    """
    order = F.struct("updated_at", "seq")
    fixed_at = F.when(F.col("status") == "fixed", F.col("updated_at"))
    latest = updates.groupBy(key).agg(
        F.max_by("status", order).alias("_status"),
        F.max("updated_at").alias("_updated"),
        F.max(fixed_at).alias("_fixed_at"),
        F.max_by("fixed_in_commit", F.when(F.col("fixed_in_commit") != "", order)).alias("_commit"),
    )
    changed = {
        "status": F.coalesce("_status", "status"),
        "fixed_at": F.coalesce("_fixed_at", "fixed_at"),
        "fixed_in_commit": F.coalesce("_commit", "fixed_in_commit"),
        "updated_at": F.coalesce("_updated", "updated_at"),
    }
    joined = findings.join(latest, key, "left")
    return joined.select(
        *[changed[name].alias(name) if name in changed else F.col(name) for name in findings.columns]
    )


def known_scans_only(children: DataFrame, scans: DataFrame) -> DataFrame:
    """Keep the rows whose scan exists."""
    return children.join(scans.select("scan_id"), "scan_id", "left_semi")


def orphans(children: DataFrame, scans: DataFrame) -> DataFrame:
    return children.join(scans.select("scan_id"), "scan_id", "left_anti")


def expired_scans(scans: DataFrame, as_of, days: int = 90) -> DataFrame:
    """Scans older than ``days`` before ``as_of``: archive these."""
    limit = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return scans.where(F.col("scan_timestamp").cast("timestamp_ntz") < limit)


def retained_scans(scans: DataFrame, as_of, days: int = 90) -> DataFrame:
    limit = F.lit(as_of).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return scans.where(F.col("scan_timestamp").cast("timestamp_ntz") >= limit)
