"""Counting files, lines and findings."""

from pyspark.sql import Column, DataFrame, functions as F

from sourcelode.functions import paths as pth, text as txt
from sourcelode.functions.lookups import CONFIDENCE_SCORE, DEFAULT_CONFIDENCE_SCORE, SEVERITY_RANK

SEVERITIES = ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")


def severity_rank(severity="severity") -> Column:
    return pth.lookup(pth.as_column(severity), SEVERITY_RANK)


def confidence_score(confidence="confidence") -> Column:
    known = pth.lookup(pth.as_column(confidence), CONFIDENCE_SCORE)
    return F.coalesce(known, F.lit(DEFAULT_CONFIDENCE_SCORE))


def above_confidence(findings: DataFrame, threshold: float) -> DataFrame:
    return findings.where(confidence_score() >= threshold)


def min_severity(findings: DataFrame, severity: str) -> DataFrame:
    kept = [name for name, rank in SEVERITY_RANK.items() if rank >= SEVERITY_RANK[severity]]
    return findings.where(F.col("severity").isin(*kept))


def by_type(findings: DataFrame, vulnerability_type: str) -> DataFrame:
    return findings.where(F.col("vulnerability_type") == vulnerability_type)


def severity_counts(findings: DataFrame, by=("scan_id",)) -> DataFrame:
    """One row per group with a column per severity, zeros included."""
    counts = [
        F.count_if(F.col("severity") == name).alias(f"{name.lower()}_count") for name in SEVERITIES
    ]
    return findings.groupBy(*by).agg(F.count(F.lit(1)).alias("total_vulnerabilities"), *counts)


def languages_detected(findings: DataFrame, by=("scan_id",)) -> DataFrame:
    """Sorted distinct languages of the findings' files: at most nine names per group."""
    return findings.groupBy(*by).agg(
        F.sort_array(F.collect_set(pth.finding_language("file_path"))).alias("languages_detected")
    )


def file_line_counts(files: DataFrame, by) -> DataFrame:
    return files.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.sum(F.size(txt.lines("content"))).cast("long").alias("lines_scanned"),
    )


def scan_summary(files: DataFrame, findings: DataFrame, by=("repo",)) -> DataFrame:
    """Files, lines and findings per scan; scans without findings stay with zero.

    Both sides are reduced to one row per scan before they meet.
    """
    found = findings.groupBy(*by).agg(F.count(F.lit(1)).alias("vulnerabilities_found"))
    return file_line_counts(files, by).join(found, list(by), "left").na.fill(
        0, ["vulnerabilities_found"]
    )


def scan_totals(counts: DataFrame, by=("repo",)) -> DataFrame:
    """The same summary from per-file counts (``detect.file_counts``): one pass, one shuffle."""
    return counts.groupBy(*by).agg(
        F.count(F.lit(1)).alias("files_scanned"),
        F.sum("lines").alias("lines_scanned"),
        F.sum("findings").alias("vulnerabilities_found"),
    )


def project_languages(files: DataFrame, by="repo") -> DataFrame:
    """Number of files per language, hidden directories aside."""
    visible = files.where(~pth.below_pruned_dir("file_path", "root", ()))
    named = visible.select(
        by, pth.detect_language("file_path", "content").alias("language")
    ).where(F.col("language").isNotNull())
    return named.groupBy(by, "language").agg(F.count(F.lit(1)).alias("file_count"))


def primary_language(counts: DataFrame, by="repo") -> DataFrame:
    """Language with most files; the alphabetically first one on a tie."""
    order = F.struct(-F.col("file_count"), F.col("language"))
    return counts.groupBy(by).agg(F.min_by("language", order).alias("primary_language"))


FINDING_ORDER = ("file_path", "line_number", "column_number", "vulnerability_type", "id")


def findings_by_file(findings: DataFrame, keys=("scan_id", "file_path"), row_id="id") -> DataFrame:
    """Findings file by file, in line order within each: a range sort, no file is ever gathered.

    :func:`file_totals` has the number of each file.
    """
    order = [c for c in ("line_number", "column_number", "vulnerability_type", row_id) if c in findings.columns]
    return findings.orderBy(*keys, *order)


def file_totals(findings: DataFrame, keys=("scan_id", "file_path")) -> DataFrame:
    return findings.groupBy(*keys).agg(F.count(F.lit(1)).alias("finding_count"))


def artifacts(findings: DataFrame, by=()) -> DataFrame:
    """Distinct files with findings and their MIME types, sorted."""
    keys = [*by, "file_path"]
    return (
        findings.select(*keys).distinct()
        .withColumn("mime_type", pth.mime_type("file_path")).orderBy(*keys)
    )


def check_conclusion(scans: DataFrame, findings: DataFrame, key="scan_id") -> DataFrame:
    """success without findings, failure with a CRITICAL or HIGH one, else neutral."""
    counts = findings.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("severity").isin("CRITICAL", "HIGH")).alias("_severe"),
    )
    joined = scans.select(key).join(counts, key, "left")
    return joined.select(
        key,
        F.when(F.coalesce("_n", F.lit(0)) == 0, "success")
        .when(F.col("_severe") > 0, "failure")
        .otherwise("neutral")
        .alias("conclusion"),
    )


def ai_coverage(findings: DataFrame, by=()) -> DataFrame:
    """Findings with a (non-empty) explanation next to all findings."""
    return findings.groupBy(*by).agg(
        F.count_if(F.coalesce("ai_explanation", F.lit("")) != "").alias("ai_analyzed"),
        F.count(F.lit(1)).alias("total"),
    )


def dedupe_code(files: DataFrame, row_id: str, code="content") -> DataFrame:
    """One row per distinct code: its hash, the smallest id holding it and the number of copies.

    Only hashes and ids are shuffled, never the code.
    """
    return (
        files.select(F.col(row_id), txt.code_hash(code).alias("code_hash"))
        .groupBy("code_hash")
        .agg(F.min(row_id).alias(row_id), F.count(F.lit(1)).alias("copies"))
    )


def dedupe_rate(unique: DataFrame) -> DataFrame:
    """Requests, distinct codes and the share a cache would have answered."""
    return unique.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).alias("requests"),
        F.count(F.lit(1)).alias("distinct_codes"),
    ).select(
        "requests",
        "distinct_codes",
        (F.col("requests") - F.col("distinct_codes")).alias("hits"),
        F.when(
            F.col("requests") > 0,
            (F.col("requests") - F.col("distinct_codes")) / F.col("requests"),
        ).otherwise(0.0).alias("hit_rate"),
    )
