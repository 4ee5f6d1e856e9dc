"""Queries on scan history: joins, aggregates, comparisons, status, retention."""

from pyspark.sql import functions as F

from sourcelode.operators import history as his, summary as agg
from sourcelode.session import scratch_path
from sourcelode.sources.repos import repo_metadata
from sourcelode.sources.sinks import export_csv
from sourcelode.sources.store import HistoryStore
from workload.registry import query, sql_case
from sourcelode.functions.lookups import FINDING_LANGUAGES, SEVERITY_RANK

SCANS, VULNS = "scan_records", "vulnerability_records"
BOTH = [SCANS, VULNS]
AS_OF = "1998-01-01"
RANK = sql_case("severity", SEVERITY_RANK)


def stamp(name: str):
    return F.date_format(name, "yyyy-MM-dd HH:mm:ss").alias(name)


def duck_stamp(name: str) -> str:
    return f"strftime({name}, '%Y-%m-%d %H:%M:%S') AS {name}"


@query(
    "scan_findings_join",
    """SELECT s.scan_id, s.target_path, v.vulnerability_type, v.severity, v.file_path, v.line_number
 FROM vulnerability_records v JOIN scan_records s ON v.scan_id = s.scan_id WHERE v.severity = 'HIGH'""",
    BOTH,
)
def _(t):
    return his.scan_findings(t(SCANS), t(VULNS), severity="HIGH").select(
        "scan_id", "target_path", "vulnerability_type", "severity", "file_path", "line_number"
    )


@query(
    "recent_high",
    f"""SELECT s.scan_id, {duck_stamp('scan_timestamp')}, vulnerability_type, file_path, line_number
 FROM vulnerability_records v JOIN scan_records s ON v.scan_id = s.scan_id
 WHERE severity = 'HIGH' AND scan_timestamp > TIMESTAMP '{AS_OF}' - INTERVAL 7 DAY""",
    BOTH,
)
def _(t):
    found = his.recent_high(t(SCANS), t(VULNS), AS_OF)
    return found.withColumn("scan_timestamp", stamp("scan_timestamp"))


@query(
    "recent_scans",
    f"""SELECT scan_id, {duck_stamp('scan_timestamp')}, CASE WHEN length(target_path) > 30 THEN substr(target_path, 1, 30) || '...'
 ELSE target_path END AS target, files_scanned FROM scan_records ORDER BY scan_records.scan_timestamp DESC, scan_id LIMIT 10""",
    [SCANS],
)
def _(t):
    from sourcelode.functions.text import truncate

    return his.recent_scans(t(SCANS), 10).select(
        "scan_id", stamp("scan_timestamp"), truncate("target_path", 30).alias("target"), "files_scanned"
    )


_COUNTS = ", ".join(
    f"count(*) FILTER (WHERE severity = '{name}') AS {name.lower()}_count"
    for name in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")
)


@query(
    "severity_counts",
    f"SELECT scan_id, count(*) AS total_vulnerabilities, {_COUNTS} FROM vulnerability_records GROUP BY scan_id",
    [VULNS],
)
def _(t):
    return agg.severity_counts(t(VULNS))


_LANG = sql_case("lower(split_part(file_path, '.', -1))", FINDING_LANGUAGES)


@query(
    "languages_detected",
    f"""SELECT scan_id, array_to_string(list_sort(list(DISTINCT {_LANG})), ',') AS languages_detected
 FROM vulnerability_records GROUP BY scan_id""",
    [VULNS],
)
def _(t):
    return agg.languages_detected(t(VULNS)).withColumn(
        "languages_detected", F.array_join("languages_detected", ",")
    )


def saved_history(t):
    """A store of its own with all scans and findings of the test tables."""
    store = HistoryStore(t.spark, scratch_path(t.spark, "history"), "year")
    findings = t(VULNS).withColumnRenamed("finding_id", "id").withColumn("ai_explanation", F.lit(None).cast("string"))
    store.save(t(SCANS), findings.withColumn("false_positive_likelihood", F.lit(None).cast("double")))
    return store


@query(
    "save_scan",
    f"""SELECT s.scan_id, count(v.scan_id) AS total_vulnerabilities,
 count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count, count(*) FILTER (WHERE severity = 'HIGH') AS high_count,
 coalesce(array_to_string(list_sort(list(DISTINCT {_LANG}) FILTER (WHERE {_LANG} IS NOT NULL)), ','), '') AS languages_detected, count(v.scan_id) AS stored_findings
 FROM scan_records s LEFT JOIN vulnerability_records v ON s.scan_id = v.scan_id GROUP BY s.scan_id""",
    BOTH,
)
def _(t):
    store = saved_history(t)
    stored = store.findings().groupBy("scan_id").agg(F.count(F.lit(1)).alias("stored_findings"))
    return (
        store.scans().join(stored, "scan_id", "left").na.fill(0, ["stored_findings"])
        .select(
            F.col("scan_id").cast("long").alias("scan_id"), "total_vulnerabilities", "critical_count",
            "high_count", F.array_join("languages_detected", ",").alias("languages_detected"),
            "stored_findings",
        )
    )


@query(
    "repo_metadata",
    """SELECT s.scan_id, s.target_path AS repo, 'https://code.example/' || c.c_name AS repository_url, c.c_name AS repository_name,
 coalesce(CASE WHEN s.scan_id % 3 = 0 THEN 'release' END, lower(c.c_mktsegment)) AS branch,
 CASE WHEN c.c_custkey % 2 = 0 THEN sha256(c.c_name) END AS commit_hash
 FROM scan_records s LEFT JOIN customer c ON s.target_path = 'repo-' || c.c_custkey""",
    [SCANS],
)
def _(t):
    owners = t("customer").select(
        F.concat(F.lit("repo-"), F.col("c_custkey").cast("string")).alias("repo"),
        F.concat(F.lit("https://code.example/"), "c_name").alias("repository_url"),
        F.col("c_name").alias("repository_name"),
        F.lower("c_mktsegment").alias("default_branch"),
        F.when(F.col("c_custkey") % 2 == 0, F.sha2("c_name", 256)).alias("commit_hash"),
    )
    scans = t(SCANS).select(
        "scan_id", F.col("target_path").alias("repo"),
        F.when(F.col("scan_id") % 3 == 0, "release").alias("branch"),
    )
    return repo_metadata(scans, owners)


@query(
    "scan_statistics",
    """SELECT count(*) AS total_scans, CAST(sum(n) AS BIGINT) AS total_vulnerabilities, round(avg(n), 4) AS avg_vulnerabilities_per_scan,
 CAST(sum(files_scanned) AS BIGINT) AS total_files_scanned, round(avg(scan_duration), 4) AS avg_scan_duration FROM
 (SELECT s.scan_id, any_value(files_scanned) AS files_scanned, any_value(scan_duration) AS scan_duration, count(v.scan_id) AS n
  FROM scan_records s LEFT JOIN vulnerability_records v ON s.scan_id = v.scan_id
  WHERE scan_timestamp >= TIMESTAMP '1996-01-01' AND scan_timestamp <= TIMESTAMP '1997-12-31' GROUP BY s.scan_id)""",
    BOTH,
)
def _(t):
    counted = his.with_finding_counts(t(SCANS), t(VULNS))
    stats = his.scan_statistics(counted, "1996-01-01", "1997-12-31")
    return stats.withColumns(
        {c: F.round(c, 4) for c in ("avg_vulnerabilities_per_scan", "avg_scan_duration")}
    )


_USAGE = f"""usage AS (SELECT vulnerability_type AS pattern_name, count(*) AS times_triggered,
 count(*) FILTER (WHERE status <> 'false_positive') AS true_positives,
 count(*) FILTER (WHERE status = 'false_positive') AS false_positives,
 round(count(*) FILTER (WHERE status <> 'false_positive') / count(*), 6) AS accuracy_rate,
 round(avg(CAST({RANK} AS INTEGER)), 6) AS avg_severity,
 strftime(min(created_at), '%Y-%m-%d') AS first_used, strftime(max(created_at), '%Y-%m-%d') AS last_used
 FROM vulnerability_records GROUP BY vulnerability_type)"""


def usage(t):
    return _shown(his.pattern_usage(t(VULNS)))


def _shown(table):
    return table.withColumns(
        {
            "accuracy_rate": F.round("accuracy_rate", 6),
            "avg_severity": F.round("avg_severity", 6),
            "first_used": F.date_format("first_used", "yyyy-MM-dd"),
            "last_used": F.date_format("last_used", "yyyy-MM-dd"),
        }
    )


@query("pattern_usage", "SELECT * FROM usage", [VULNS], _USAGE)
def _(t):
    return usage(t)


@query("pattern_usage_merge", "SELECT * FROM usage", [VULNS], _USAGE)
def _(t):
    """Counters of two halves of the history, added up, equal the counters of all of it."""
    found = t(VULNS)
    old = his.pattern_usage(found.where(F.col("created_at") < F.lit("1997-01-01").cast("timestamp_ntz")))
    new = his.pattern_usage(found.where(F.col("created_at") >= F.lit("1997-01-01").cast("timestamp_ntz")))
    return _shown(his.merge_pattern_usage(old, new))


@query(
    "top_patterns",
    "SELECT pattern_name, times_triggered FROM usage ORDER BY times_triggered DESC, pattern_name LIMIT 50",
    [VULNS],
    _USAGE,
)
def _(t):
    return his.top_patterns(usage(t)).select("pattern_name", "times_triggered")


@query("stored_pattern_usage", "SELECT * FROM usage", [VULNS], _USAGE)
def _(t):
    """Counters of two periods stored, one of them twice, and read back as one row per rule."""
    store = HistoryStore(t.spark, scratch_path(t.spark, "history"), "year")
    early = F.col("created_at") < F.lit("1995-06-17").cast("timestamp_ntz")
    for chosen, start in ((early, "1992-01-01"), (~early, "1995-06-17"), (~early, "1995-06-17")):
        rows = his.pattern_usage(t(VULNS).where(chosen))
        start = F.lit(start).cast("timestamp_ntz")
        store.put("pattern_usage", rows.withColumn("stats_period_start", start))
    return _shown(store.pattern_usage())


@query("patterns_by_accuracy", "SELECT pattern_name, accuracy_rate FROM usage", [VULNS], _USAGE)
def _(t):
    return his.patterns_by_accuracy(usage(t)).select("pattern_name", "accuracy_rate")


# --- listings --------------------------------------------------------------------------------


@query(
    "show_scan",
    f"""SELECT s.scan_id, s.target_path, coalesce(c.total_vulnerabilities, 0) AS total_vulnerabilities, coalesce(c.critical_count, 0) AS critical_count,
 coalesce(c.high_count, 0) AS high_count, p.position, p.vulnerability_type, p.severity, p.file_name, p.line, greatest(coalesce(c.total_vulnerabilities, 0) - 20, 0) AS more
 FROM scan_records s LEFT JOIN (SELECT scan_id, count(*) AS total_vulnerabilities, {_COUNTS} FROM vulnerability_records GROUP BY scan_id) c ON s.scan_id = c.scan_id
 LEFT JOIN (SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY file_path, line_number NULLS FIRST, vulnerability_type, finding_id) AS position,
  vulnerability_type, severity, split_part(file_path, '/', -1) AS file_name, coalesce(CAST(line_number AS varchar), 'N/A') AS line FROM vulnerability_records) p
 ON s.scan_id = p.scan_id AND p.position <= 20""",
    BOTH,
)
def _(t):
    return his.show_scan(t(SCANS), t(VULNS)).select(
        "scan_id", "target_path", "total_vulnerabilities", "critical_count", "high_count",
        F.col("position").cast("long").alias("position"), "vulnerability_type", "severity",
        "file_name", "line", "more",
    )


@query(
    "findings_by_file",
    "SELECT scan_id, file_path, line_number, vulnerability_type, severity FROM vulnerability_records",
    [VULNS],
)
def _(t):
    return agg.findings_by_file(t(VULNS), row_id="finding_id").select(
        "scan_id", "file_path", "line_number", "vulnerability_type", "severity"
    )


@query(
    "file_totals",
    "SELECT scan_id, file_path, count(*) AS finding_count FROM vulnerability_records GROUP BY scan_id, file_path",
    [VULNS],
)
def _(t):
    return agg.file_totals(t(VULNS))


@query(
    "check_conclusion",
    """SELECT s.scan_id, CASE WHEN n IS NULL THEN 'success' WHEN severe > 0 THEN 'failure' ELSE 'neutral' END AS conclusion
 FROM scan_records s LEFT JOIN (SELECT scan_id, count(*) AS n, count(*) FILTER (WHERE severity IN ('CRITICAL', 'HIGH')) AS severe
 FROM vulnerability_records GROUP BY scan_id) v ON s.scan_id = v.scan_id""",
    BOTH,
)
def _(t):
    return agg.check_conclusion(t(SCANS), t(VULNS))


# --- comparisons -----------------------------------------------------------------------------

# Consecutive scans per target with the issues of both, null-safe.
_TREND = f"""pairs AS (SELECT target_path, scan_id AS cur, lag(scan_id) OVER (PARTITION BY target_path ORDER BY scan_timestamp, scan_id) AS base,
  scan_timestamp FROM scan_records),
keyed AS (SELECT scan_id, vulnerability_type AS vt, file_path AS fp, coalesce(line_number, -1) AS ln, max(CAST({RANK} AS INTEGER)) AS r FROM vulnerability_records GROUP BY ALL),
sides AS (SELECT p.cur, vt, fp, ln, NULL AS b, r AS c FROM pairs p JOIN keyed k ON k.scan_id = p.cur WHERE p.base IS NOT NULL
 UNION ALL SELECT p.cur, vt, fp, ln, r AS b, NULL AS c FROM pairs p JOIN keyed k ON k.scan_id = p.base),
issues AS (SELECT cur, vt, fp, ln, max(b) AS b, max(c) AS c FROM sides GROUP BY ALL),
tally AS (SELECT cur, count(*) FILTER (WHERE b IS NULL) AS new_vulnerabilities, count(*) FILTER (WHERE c IS NULL) AS fixed_vulnerabilities,
 count(*) FILTER (WHERE b IS NOT NULL AND c IS NOT NULL) AS persistent_vulnerabilities, count(*) FILTER (WHERE c > b) AS severity_increased,
 count(*) FILTER (WHERE c < b) AS severity_decreased, CAST(sum(coalesce(c + 1, 0) - coalesce(b + 1, 0)) AS DOUBLE) AS risk_score_change FROM issues GROUP BY cur),
trend AS (SELECT target_path, p.base AS baseline_scan_id, p.cur AS current_scan_id, scan_timestamp, coalesce(new_vulnerabilities, 0) AS new_vulnerabilities,
 coalesce(fixed_vulnerabilities, 0) AS fixed_vulnerabilities, coalesce(persistent_vulnerabilities, 0) AS persistent_vulnerabilities,
 coalesce(severity_increased, 0) AS severity_increased, coalesce(severity_decreased, 0) AS severity_decreased, coalesce(risk_score_change, 0) AS risk_score_change,
 CASE WHEN coalesce(new_vulnerabilities, 0) > coalesce(fixed_vulnerabilities, 0) THEN 'degraded'
  WHEN coalesce(new_vulnerabilities, 0) < coalesce(fixed_vulnerabilities, 0) THEN 'improved' ELSE 'stable' END AS overall_trend
 FROM pairs p LEFT JOIN tally t ON t.cur = p.cur WHERE p.base IS NOT NULL)"""
_NUMBERS = "new_vulnerabilities, fixed_vulnerabilities, persistent_vulnerabilities"


def trend(t):
    return his.scan_trend(t(SCANS), t(VULNS), "month")


@query(
    "scan_trend",
    f"SELECT target_path, baseline_scan_id, current_scan_id, {_NUMBERS}, overall_trend FROM trend",
    BOTH,
    _TREND,
)
def _(t):
    return trend(t).select(
        "target_path", "baseline_scan_id", "current_scan_id", *_NUMBERS.split(", "), "overall_trend"
    )


@query(
    "stored_comparisons",
    f"SELECT baseline_scan_id, current_scan_id, {_NUMBERS}, risk_score_change, overall_trend FROM trend",
    BOTH,
    _TREND,
)
def _(t):
    """All comparisons stored and read back."""
    store = HistoryStore(t.spark, scratch_path(t.spark, "history"), "year")
    store.put("scan_comparisons", trend(t).withColumn("comparison_timestamp", F.col("scan_timestamp")))
    return store.table("scan_comparisons").select(
        *[F.col(name).cast("long").alias(name) for name in ("baseline_scan_id", "current_scan_id")],
        *_NUMBERS.split(", "), "risk_score_change", "overall_trend",
    )


@query(
    "severity_shift",
    "SELECT current_scan_id, severity_increased, severity_decreased, risk_score_change FROM trend",
    BOTH,
    _TREND,
)
def _(t):
    return trend(t).select(
        "current_scan_id", "severity_increased", "severity_decreased", "risk_score_change"
    )


@query(
    "degraded_comparisons",
    f"SELECT baseline_scan_id, current_scan_id, {_NUMBERS} FROM trend WHERE overall_trend = 'degraded'",
    BOTH,
    _TREND,
)
def _(t):
    return his.degraded_comparisons(trend(t)).select(
        "baseline_scan_id", "current_scan_id", *_NUMBERS.split(", ")
    )


_SIDES = """vt AS (SELECT scan_id, vulnerability_type, file_path, line_number FROM vulnerability_records),
base AS (SELECT DISTINCT vulnerability_type, file_path, line_number FROM vt WHERE scan_id = 1),
cur AS (SELECT DISTINCT vulnerability_type, file_path, line_number FROM vt WHERE scan_id = 2)"""


@query(
    "compare_scans",
    """SELECT CAST(1 AS BIGINT) AS baseline_scan_id, CAST(2 AS BIGINT) AS current_scan_id, n AS new_vulnerabilities, f AS fixed_vulnerabilities, p AS persistent_vulnerabilities,
 CASE WHEN n > f THEN 'degraded' WHEN n < f THEN 'improved' ELSE 'stable' END AS overall_trend FROM
 (SELECT (SELECT count(*) FROM (FROM cur EXCEPT FROM base)) AS n, (SELECT count(*) FROM (FROM base EXCEPT FROM cur)) AS f,
  (SELECT count(*) FROM (FROM base INTERSECT FROM cur)) AS p)""",
    [VULNS],
    _SIDES,
)
def _(t):
    return his.compare_scans(t(SCANS), t(VULNS), 1, 2).select(
        F.col("baseline_scan_id").cast("long").alias("baseline_scan_id"),
        F.col("current_scan_id").cast("long").alias("current_scan_id"),
        *_NUMBERS.split(", "), "overall_trend",
    )


@query("new_findings", "FROM cur EXCEPT FROM base", [VULNS], _SIDES)
def _(t):
    return his.new_findings(t(VULNS), 1, 2)


@query("fixed_findings", "FROM base EXCEPT FROM cur", [VULNS], _SIDES)
def _(t):
    return his.fixed_findings(t(VULNS), 1, 2)


# --- rows ------------------------------------------------------------------------------------


@query("lookup", "SELECT finding_id, scan_id, severity FROM vulnerability_records WHERE finding_id = 43791", [VULNS])
def _(t):
    return his.lookup_rows(t(VULNS), "finding_id", 43791).select("finding_id", "scan_id", "severity")


@query(
    "filter_findings",
    "SELECT finding_id, file_path FROM vulnerability_records WHERE scan_id = 4379 AND severity = 'HIGH' AND status = 'open'",
    [VULNS],
)
def _(t):
    return his.filter_findings(t(VULNS), 4379, "HIGH", "open").select("finding_id", "file_path")


# Two updates for a third of the findings, one for another third; some commits are missing.
_UPDATES = """updates AS (SELECT l_orderkey * 10 + l_linenumber AS finding_id, CASE l_partkey % 4 WHEN 0 THEN 'fixed' WHEN 1 THEN 'ignored' WHEN 2 THEN 'open' ELSE 'false_positive' END AS status,
 l_shipdate + INTERVAL 1 DAY AS updated_at, l_partkey * 2 AS seq, CASE WHEN l_partkey % 3 = 0 THEN concat('c', CAST(l_partkey AS varchar)) END AS fixed_in_commit FROM lineitem WHERE l_suppkey % 3 < 2
 UNION ALL SELECT l_orderkey * 10 + l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN 'fixed' ELSE 'open' END, l_shipdate + INTERVAL 1 DAY, l_partkey * 2 + 1, NULL FROM lineitem WHERE l_suppkey % 3 = 0)"""


def status_updates(t):
    sql = _UPDATES[len("updates AS (") : -1].replace("varchar", "string").replace("FROM lineitem", "FROM {lineitem}")
    return t.spark.sql(sql, lineitem=t("lineitem")).withColumn(
        "finding_id", F.col("finding_id").cast("long")
    )


def tracked_findings(t):
    return t(VULNS).select(
        "finding_id", "status", F.lit(None).cast("timestamp_ntz").alias("fixed_at"),
        F.lit(None).cast("string").alias("fixed_in_commit"),
    )


STATUS_SQL = """SELECT v.finding_id, coalesce(u.status, v.status) AS status, strftime(u.fixed_at, '%Y-%m-%d') AS fixed_at, u.fixed_in_commit FROM vulnerability_records v LEFT JOIN
 (SELECT finding_id, arg_max(status, epoch(updated_at) * 1000000 + seq) AS status, max(updated_at) FILTER (WHERE status = 'fixed') AS fixed_at, arg_max(fixed_in_commit, epoch(updated_at) * 1000000 + seq) FILTER (WHERE fixed_in_commit IS NOT NULL) AS fixed_in_commit
  FROM updates GROUP BY finding_id) u ON v.finding_id = u.finding_id"""
UPDATES_CTE = _UPDATES


@query("update_status", STATUS_SQL, [VULNS], _UPDATES)
def _(t):
    changed = his.update_status(tracked_findings(t), status_updates(t))
    return changed.withColumn("fixed_at", F.date_format("fixed_at", "yyyy-MM-dd"))


@query(
    "stored_status",
    STATUS_SQL,
    [VULNS],
    _UPDATES,
)
def _(t):
    """Status updates written into the stored findings."""
    store = saved_history(t)
    store.update_status(status_updates(t).withColumn("id", F.col("finding_id").cast("string")))
    return store.findings().select(
        F.col("id").cast("long").alias("finding_id"), "status",
        F.date_format("fixed_at", "yyyy-MM-dd").alias("fixed_at"), "fixed_in_commit",
    )


@query(
    "stored_retention",
    f"""SELECT scan_timestamp < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY AS archived, s.scan_id, count(v.finding_id) AS findings
 FROM scan_records s LEFT JOIN vulnerability_records v ON s.scan_id = v.scan_id GROUP BY 1, 2""",
    BOTH,
)
def _(t):
    """Old scans moved to an archive with their findings."""
    store = saved_history(t)
    archive = HistoryStore(t.spark, scratch_path(t.spark, "archive"), "year")
    store.expire(AS_OF, 90, archive)
    parts = []
    for archived, place in ((True, archive), (False, store)):
        found = place.findings().groupBy("scan_id").agg(F.count(F.lit(1)).alias("findings"))
        parts.append(
            place.scans().join(found, "scan_id", "left").na.fill(0, ["findings"])
            .select(F.lit(archived).alias("archived"), F.col("scan_id").cast("long").alias("scan_id"), "findings")
        )
    return parts[0].unionByName(parts[1])


@query(
    "orphan_guard",
    """SELECT usage_id, u.scan_id, s.scan_id IS NOT NULL AS kept FROM llm_usage u LEFT JOIN scan_records s ON u.scan_id = s.scan_id""",
    ["llm_usage", SCANS],
)
def _(t):
    rows = t("llm_usage").select("usage_id", "scan_id")
    kept = his.known_scans_only(rows, t(SCANS)).withColumn("kept", F.lit(True))
    return kept.unionByName(his.orphans(rows, t(SCANS)).withColumn("kept", F.lit(False)))


@query(
    "retention",
    f"""SELECT scan_timestamp < TIMESTAMP '{AS_OF}' - INTERVAL 90 DAY AS archived, count(DISTINCT s.scan_id) AS scans, count(v.finding_id) AS findings
 FROM scan_records s LEFT JOIN vulnerability_records v ON s.scan_id = v.scan_id GROUP BY 1""",
    BOTH,
)
def _(t):
    scans, found = t(SCANS), t(VULNS)
    parts = []
    for archived, chosen in (
        (True, his.expired_scans(scans, AS_OF)), (False, his.retained_scans(scans, AS_OF)),
    ):
        children = his.known_scans_only(found, chosen).agg(F.count(F.lit(1)).alias("findings"))
        parts.append(
            chosen.agg(F.count(F.lit(1)).alias("scans")).select(
                F.lit(archived).alias("archived"), "scans", children.scalar().alias("findings")
            )
        )
    return parts[0].unionByName(parts[1])


@query(
    "export_csv",
    f"""SELECT scan_id, target_path, {duck_stamp('scan_timestamp')}, scan_duration, files_scanned FROM scan_records""",
    [SCANS],
)
def _(t):
    """Written as CSV with a header, read back."""
    path = scratch_path(t.spark, "csv")
    table = t(SCANS).select(
        "scan_id", "target_path", stamp("scan_timestamp"), "scan_duration", "files_scanned"
    )
    export_csv(table, path)
    return t.spark.read.schema(table.schema).option("header", True).csv(path)
