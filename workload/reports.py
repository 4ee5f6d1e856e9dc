"""Queries on model verdicts and reports."""

from pyspark.sql import functions as F

from sourcelode.functions import text as txt
from sourcelode.functions.lookups import FAILED_VERDICT, REPORT_LEVELS, REPORT_RULE_TYPES
from sourcelode.operators import reports as rep, summary as agg, verdicts as ver
from sourcelode.operators.ledger import AnswerLedger
from sourcelode.session import kept, scratch_path
from sourcelode.sources.sinks import write_json, write_sarif
from workload import sqlparts as sp
from workload.detection import _ID, FINDS, findings, scanned
from workload.history import BOTH, SCANS, VULNS
from workload.registry import literal, query, sql_case

# --- verdicts --------------------------------------------------------------------------------


@query(
    "finding_source_join",
    """SELECT file_id, rule_id AS vulnerability_type, line_number, column_number, code_snippet AS prompt_snippet FROM finds""",
    ["src_files"],
    sp.findings(radius=10),
)
def _(t):
    """Every finding with the lines around it, cut while detecting."""
    return findings(t, prompt_radius=ver.PROMPT_RADIUS).select(
        "file_id", "vulnerability_type", "line_number", "column_number", "prompt_snippet"
    )


_PROMPT = (
    "'Is the marked line a real case of ' || vulnerability_type || '?' || chr(10) || 'Language: ' || language || chr(10) || '```' || language || chr(10) || code_snippet"
    " || chr(10) || '```' || chr(10) || 'File: ' || file_path || chr(10) || 'Context:' || chr(10) || '- repo: ' || repo || chr(10)"
    " || 'Give severity, impact, attack scenarios, exact fixes and your confidence.'"
)


@query(
    "build_prompts",
    f"SELECT file_id, vulnerability_type, line_number, column_number, {_PROMPT} AS analysis_prompt FROM finds",
    ["src_files"],
    FINDS,
)
def _(t):
    prompts = ver.build_prompts(findings(t), context={"repo": F.col("repo")})
    return prompts.select(
        "file_id", "vulnerability_type", "line_number", "column_number", "analysis_prompt"
    )


# JSON_EXTRACT fails on text that is not JSON, so broken answers are set apart first.
_PARSED = f"""parsed AS (SELECT file_id, CASE WHEN json_valid(verdict_json) THEN verdict_json END AS j FROM verdicts),
verdict AS (SELECT file_id, j IS NULL AS failed, coalesce(j->>'analysis', {literal(FAILED_VERDICT['analysis'] + 'unreadable answer')}) AS analysis,
 coalesce(j->>'severity_assessment', 'UNKNOWN') AS severity_assessment, coalesce(CAST(j->>'false_positive_likelihood' AS DOUBLE), 0.5) AS false_positive_likelihood,
 coalesce(j->>'remediation', {literal(FAILED_VERDICT['remediation'])}) AS advice, coalesce(j->>'confidence', 'LOW') AS verdict_confidence FROM parsed)"""


@query(
    "stored_source_join",
    """SELECT file_id, rule_id AS vulnerability_type, line_number, column_number, code_snippet AS prompt_snippet FROM finds""",
    ["src_files"],
    sp.findings(radius=10),
)
def _(t):
    """The same for findings that were stored without their surroundings."""
    stored_rows = kept(findings(t).drop("language"), "findings")
    return ver.with_source(stored_rows, scanned(t)).select(
        "file_id", "vulnerability_type", "line_number", "column_number", "prompt_snippet"
    )


def verdicts(t):
    return t("verdicts").select("file_id", ver.parse_verdict("verdict_json").alias("analysis"))


@query(
    "parse_verdict",
    """SELECT file_id, failed, analysis, severity_assessment, false_positive_likelihood, advice AS remediation, verdict_confidence AS confidence FROM verdict""",
    ["verdicts"],
    _PARSED,
)
def _(t):
    v = F.col("analysis")
    return verdicts(t).select(
        "file_id", v["error"].isNotNull().alias("failed"), v["analysis"].alias("analysis"),
        v["severity_assessment"].alias("severity_assessment"),
        v["false_positive_likelihood"].alias("false_positive_likelihood"),
        v["remediation"].alias("remediation"), v["confidence"].alias("confidence"),
    )


_MERGED = f"""{FINDS},
{_PARSED},
merged AS (SELECT f.file_id, f.vulnerability_type, f.line_number, f.column_number, f.language,
 CASE WHEN upper(v.severity_assessment) IN ('LOW', 'MEDIUM', 'HIGH', 'CRITICAL') THEN upper(v.severity_assessment) ELSE f.severity END AS severity,
 CASE WHEN upper(v.verdict_confidence) IN ('LOW', 'MEDIUM', 'HIGH') THEN upper(v.verdict_confidence) ELSE f.confidence END AS confidence,
 CASE WHEN length(v.advice) > length(f.remediation) THEN v.advice ELSE f.remediation END AS remediation,
 v.analysis AS ai_explanation, v.false_positive_likelihood FROM finds f LEFT JOIN verdict v ON f.file_id = v.file_id)"""
_KEY = ["file_id", "vulnerability_type", "line_number", "column_number"]


def merged(t):
    per_file = verdicts(t).select("file_id", "analysis", F.col("analysis").alias("doubt"))
    return ver.merge_verdicts(findings(t), per_file, "file_id")


@query(
    "merge_verdict",
    "SELECT * EXCLUDE (language) FROM merged",
    ["src_files", "verdicts"],
    _MERGED,
)
def _(t):
    return merged(t).select(
        *_KEY, "severity", "confidence", "remediation", "ai_explanation", "false_positive_likelihood"
    )


@query(
    "verdict_join",
    "SELECT file_id, vulnerability_type, line_number, column_number, ai_explanation IS NOT NULL AS judged FROM merged",
    ["src_files", "verdicts"],
    _MERGED,
)
def _(t):
    return merged(t).select(*_KEY, F.col("ai_explanation").isNotNull().alias("judged"))


@query(
    "drop_false_positives",
    """SELECT file_id, vulnerability_type, line_number, column_number, false_positive_likelihood FROM merged
 WHERE coalesce(false_positive_likelihood, 0) <= 0.8""",
    ["src_files", "verdicts"],
    _MERGED,
)
def _(t):
    return ver.drop_false_positives(merged(t)).select(*_KEY, "false_positive_likelihood")


@query(
    "ai_coverage",
    "SELECT language, count(*) FILTER (WHERE coalesce(ai_explanation, '') <> '') AS ai_analyzed, count(*) AS total FROM merged GROUP BY language",
    ["src_files", "verdicts"],
    _MERGED,
)
def _(t):
    return agg.ai_coverage(merged(t), ("language",))


_BARE_PROMPT = _PROMPT.replace("'- repo: ' || repo", "'No additional context provided'")


@query(
    "batch_infer",
    f"SELECT {_ID} AS id, CAST(length({_BARE_PROMPT}) AS varchar) AS analysis FROM finds",
    ["src_files"],
    FINDS,
)
def _(t):
    """A stand-in judge that answers from the prompt alone."""

    def judge(system, prompts):
        import json

        return [
            json.dumps({"analysis": str(len(p)), "confidence": "high", "false_positive_likelihood": 0.1})
            for p in prompts
        ]

    prompts = ver.build_prompts(findings(t))
    answers = ver.batch_infer(prompts, "id", judge, tasks=8)
    return answers.select("id", ver.parse_verdict("analysis_json")["analysis"].alias("analysis"))


@query(
    "answer_ledger",
    f"SELECT {_ID} AS id, CAST(length({_BARE_PROMPT}) AS varchar) AS analysis FROM finds",
    ["src_files"],
    FINDS,
)
def _(t):
    """The same judge behind a ledger: some prompts are asked first, then all that are still missing."""

    def judge(system, prompts):
        import json

        return [json.dumps({"analysis": str(len(p))}) for p in prompts]

    prompts = ver.build_prompts(findings(t))
    ledger = AnswerLedger(t.spark, scratch_path(t.spark, "answers"), "stand-in")
    ledger.ask(prompts.where("line_number % 2 = 0"), "id", judge, tasks=8, batch=500)
    answers = ledger.ask(prompts, "id", judge, tasks=8, batch=500)
    return answers.select("id", F.get_json_object("analysis_json", "$.analysis").alias("analysis"))


# --- reports ---------------------------------------------------------------------------------

_LEVEL = sql_case("severity", REPORT_LEVELS)
_INDEX = sql_case(
    "vulnerability_type", {name: at for at, names in enumerate(REPORT_RULE_TYPES) for name in names}
)
_HASH = "substr(md5(concat_ws(':', file_path, coalesce(CAST(line_number AS varchar), 'None'), vulnerability_type)), 1, 8)"


@query(
    "sarif_level",
    f"SELECT finding_id, coalesce({_LEVEL}, 'warning') AS level FROM vulnerability_records",
    [VULNS],
)
def _(t):
    return t(VULNS).select("finding_id", rep.level().alias("level"))


@query(
    "sarif_rule_index",
    f"SELECT finding_id, CAST(coalesce({_INDEX}, '0') AS INTEGER) AS rule_index FROM vulnerability_records",
    [VULNS],
)
def _(t):
    return t(VULNS).select("finding_id", rep.rule_index().alias("rule_index"))


@query("line_fingerprint", f"SELECT finding_id, {_HASH} AS fingerprint FROM vulnerability_records", [VULNS])
def _(t):
    return t(VULNS).select("finding_id", rep.line_fingerprint().alias("fingerprint"))


def _clean_sql(column: str) -> str:
    return f"""array_to_string(list_transform(string_split({column}, chr(10)),
 lambda l: CASE WHEN contains(l, ':') THEN substr(l, strpos(l, ':') + 1) ELSE l END), chr(10))"""


@query("clean_snippet", f"SELECT doc_id, {_clean_sql('text')} AS clean FROM documents")
def _(t):
    return t("documents").select("doc_id", txt.clean_snippet("text").alias("clean"))


@query(
    "sarif_result",
    f"""SELECT file_id, rule_id, CAST({_INDEX} AS BIGINT) AS rule_index, {_LEVEL} AS level, file_path AS uri, line_number AS start_line, column_number AS start_column,
 line_number AS end_line, end_column_number AS end_column, {_clean_sql('code_snippet')} AS snippet, {_HASH} AS fingerprint, cwe_id AS cwe, remediation AS fix FROM finds""",
    ["src_files"],
    FINDS,
)
def _(t):
    """The written JSON, read back."""
    results = rep.sarif_results(findings(t), keys=("file_id",))
    shape = (
        "ruleId string, ruleIndex long, level string, properties struct<cwe string>,"
        " locations array<struct<physicalLocation struct<artifactLocation struct<uri string>,"
        " region struct<startLine long, startColumn long, endLine long, endColumn long, snippet struct<text string>>>>>,"
        " partialFingerprints struct<primaryLocationLineHash string>,"
        " fixes array<struct<description struct<text string>>>"
    )
    read = results.select("file_id", F.from_json("result", shape).alias("r")).select(
        "file_id", "r.*", F.col("r.locations")[0]["physicalLocation"].alias("place")
    )
    region = "place.region."
    return read.select(
        "file_id", F.col("ruleId").alias("rule_id"), F.col("ruleIndex").alias("rule_index"), "level",
        F.col("place.artifactLocation.uri").alias("uri"),
        F.col(region + "startLine").alias("start_line"), F.col(region + "startColumn").alias("start_column"),
        F.col(region + "endLine").alias("end_line"), F.col(region + "endColumn").alias("end_column"),
        F.col(region + "snippet.text").alias("snippet"),
        F.col("partialFingerprints.primaryLocationLineHash").alias("fingerprint"),
        F.col("properties.cwe").alias("cwe"), F.get("fixes", 0)["description"]["text"].alias("fix"),
    )


def stored(t):
    """History findings with the report columns the stored view lacks."""
    none = F.lit(None).cast("string")
    return t(VULNS).select(
        "*", F.col("finding_id").cast("string").alias("id"),
        F.lit(1).cast("long").alias("column_number"),
        F.lit(None).cast("long").alias("end_line_number"),
        F.lit(None).cast("long").alias("end_column_number"),
        F.concat(F.lit(">>>    1: "), "vulnerability_type").alias("code_snippet"),
        F.concat("vulnerability_type", F.lit(" found")).alias("description"),
        F.col("vulnerability_type").alias("title"),
        none.alias("cwe_id"), none.alias("owasp_category"), none.alias("remediation"),
        none.alias("ai_explanation"), F.lit(None).cast("double").alias("false_positive_likelihood"),
        F.array().cast("array<string>").alias("references"),
        F.create_map().cast("map<string,string>").alias("metadata"),
    )


def described_scans(t):
    """Scans as the SARIF envelope wants them; every second one has repository facts."""
    known = F.col("scan_id") % 2 == 0
    return t(SCANS).select(
        "*", F.when(known, F.concat(F.lit("https://code.example/"), "target_path")).alias("repository_url"),
        F.when(known, F.sha2("target_path", 256)).alias("commit_hash"),
        F.when(known, "main").alias("branch"),
    )


@query(
    "sarif_run",
    """SELECT s.scan_id, count(v.scan_id) AS results, count(DISTINCT v.file_path) AS artifacts,
 CASE WHEN s.scan_id % 2 = 0 THEN sha256(any_value(target_path)) END AS revision, coalesce(min(v.file_path), '') AS first_artifact
 FROM scan_records s LEFT JOIN vulnerability_records v ON s.scan_id = v.scan_id GROUP BY s.scan_id""",
    BOTH,
)
def _(t):
    """Each scan's lines, parsed one by one."""
    lines = rep.sarif_lines(described_scans(t), stored(t))
    artifact = F.get_json_object(F.ltrim(F.col("line"), F.lit(",")), "$.location.uri")
    revision = F.regexp_extract("line", '"revisionId":"([0-9a-f]+)"', 1)
    section = F.col("section")
    # Taken out of the lines first: the largest text of a group is found by a sort, which needs no whole lines.
    facts = lines.select(
        "scan_id", "section", F.when(section == rep.HEAD, revision).alias("revision"),
        F.when((section == rep.ARTIFACTS) & ~F.startswith("line", F.lit(",")), artifact).alias("artifact"),
    )
    return facts.groupBy("scan_id").agg(
        F.count_if(section == rep.RESULTS).alias("results"),
        F.count_if(section == rep.ARTIFACTS).alias("artifacts"),
        F.nullif(F.max("revision"), F.lit("")).alias("revision"),
        F.coalesce(F.max("artifact"), F.lit("")).alias("first_artifact"),
    )


_PLACED = """SELECT v.finding_id, v.vulnerability_type, v.file_path, v.line_number, row_number() OVER
 (PARTITION BY v.scan_id ORDER BY v.file_path, v.line_number NULLS FIRST, v.vulnerability_type, CAST(v.finding_id AS varchar)) = 1 AS first
 FROM scan_records s JOIN vulnerability_records v ON s.scan_id = v.scan_id"""


def _entries(t, path, mark: str, shape: str):
    """The written list entries that hold ``mark``: whether they open a list, and their fields."""
    comma = F.lit(",")
    files = t.spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "report-*")
    lines = files.text(path).where(F.contains("value", F.lit(mark)))
    return lines.select(
        (~F.startswith("value", comma)).alias("first"),
        F.from_json(F.ltrim(F.col("value"), comma), shape).alias("r"),
    )


@query("write_sarif", _PLACED, BOTH)
def _(t):
    """SARIF files, written and read again: the result lines, and which ones open a list."""
    path = scratch_path(t.spark, "sarif")
    write_sarif(described_scans(t), stored(t), path, compression="gzip")
    shape = (
        "ruleId string, locations array<struct<physicalLocation struct<artifactLocation struct<uri string>,"
        " region struct<startLine long>>>>, properties struct<scanner_id string>"
    )
    return _entries(t, path, '"scanner_id":', shape).select(
        F.col("r.properties.scanner_id").cast("long").alias("finding_id"),
        F.col("r.ruleId").alias("vulnerability_type"),
        F.col("r.locations")[0]["physicalLocation"]["artifactLocation"]["uri"].alias("file_path"),
        F.col("r.locations")[0]["physicalLocation"]["region"]["startLine"].alias("line_number"),
        "first",
    )


@query("write_json", _PLACED, BOTH)
def _(t):
    """Scan documents, written and read again in the same way."""
    path = scratch_path(t.spark, "json")
    write_json(t(SCANS), stored(t), path)
    shape = "id string, vulnerability_type string, location struct<file_path string, line_number long>"
    return _entries(t, path, '"location":', shape).select(
        F.col("r.id").cast("long").alias("finding_id"), "r.vulnerability_type",
        "r.location.file_path", "r.location.line_number", "first",
    )


@query(
    "sarif_invocation",
    """SELECT scan_id, strftime(scan_timestamp, '%Y-%m-%dT%H:%M:%S') || 'Z' AS started,
 strftime(scan_timestamp + to_seconds(CAST(floor(scan_duration) AS BIGINT)), '%Y-%m-%dT%H:%M:%S') AS ended FROM scan_records""",
    [SCANS],
)
def _(t):
    scans = t(SCANS).select("scan_id", rep.invocation().alias("i"))
    return scans.select(
        "scan_id", F.col("i.startTimeUtc").alias("started"),
        F.substring("i.endTimeUtc", 1, 19).alias("ended"),
    )


@query(
    "related_locations",
    """SELECT a.vec_id, count(*) AS related, min(b.vec_id) AS first_related FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id
 WHERE list_cosine_similarity(a.e, b.e) >= 0.3 GROUP BY a.vec_id""",
    ctes="vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)",
)
def _(t):
    from sourcelode.operators.similar import similar_all

    near = similar_all(t("embeddings"), 0.3, top=None)
    name = F.concat(F.lit("f"), F.col("similar_id").cast("string"))
    text = F.to_json(rep.related_location(name, "similar_id", "similarity"))
    place = F.from_json(text, "physicalLocation struct<region struct<startLine long>>")
    lines = near.select(F.col("target_id").alias("vec_id"), place["physicalLocation"]["region"]["startLine"].alias("line"))
    return lines.groupBy("vec_id").agg(F.count("line").alias("related"), F.min("line").alias("first_related"))


@query(
    "severity_report",
    """SELECT severity, vulnerability_type AS type, file_path AS file, CAST(line_number AS varchar) AS line, description, confidence FROM finds""",
    ["src_files"],
    FINDS,
)
def _(t):
    return rep.severity_report(findings(t))


_SUMMARY = " || ".join(
    f"CASE WHEN {name.lower()}_count > 0 THEN ' | {mark} ' || {name.lower()}_count || ' {name.capitalize()}' ELSE '' END"
    for name, mark in rep.SEVERITY_MARKS.items()
)


@query(
    "check_summary",
    f"""SELECT scan_id, CASE WHEN n = 0 THEN '{rep.CLEAN_SUMMARY}' ELSE '🔍 Found ' || n || ' security issue(s):' || {_SUMMARY} END AS summary FROM
 (SELECT s.scan_id, count(v.scan_id) AS n, count(*) FILTER (WHERE severity = 'CRITICAL') AS critical_count, count(*) FILTER (WHERE severity = 'HIGH') AS high_count,
  count(*) FILTER (WHERE severity = 'MEDIUM') AS medium_count, count(*) FILTER (WHERE severity = 'LOW') AS low_count
  FROM scan_records s LEFT JOIN vulnerability_records v ON s.scan_id = v.scan_id GROUP BY s.scan_id)""",
    BOTH,
)
def _(t):
    from sourcelode.operators.history import with_finding_counts

    return rep.check_summary(with_finding_counts(t(SCANS), t(VULNS)))


_MARK = sql_case("severity", rep.SEVERITY_MARKS)


@query(
    "check_details",
    f"""SELECT scan_id, file_path, 2 AS section, '- ' || {_MARK} || ' **' || vulnerability_type || '** (Line ' || coalesce(CAST(line_number AS varchar), 'None') || ')'
 || chr(10) || '  - **Severity:** ' || severity || chr(10) || '  - **Confidence:** ' || confidence || chr(10) || '  - **Description:** ' || vulnerability_type || ' found' || chr(10) AS text
 FROM vulnerability_records
 UNION ALL SELECT DISTINCT scan_id, file_path, 1, '### ' || file_path || chr(10) FROM vulnerability_records
 UNION ALL SELECT s.scan_id, NULL, 0, CASE WHEN n IS NULL THEN '{rep.CLEAN_DETAILS}' ELSE '## Scan Results' || chr(10) || chr(10) || '- **Files Scanned:** ' || files_scanned || chr(10)
 || '- **Lines Scanned:** ' || total_lines_scanned || chr(10) || '- **Scan Duration:** ' || format('{{:.2f}}', scan_duration) || 's' || chr(10) || chr(10) || '## Vulnerabilities by File' || chr(10) END
 FROM scan_records s LEFT JOIN (SELECT scan_id, count(*) AS n FROM vulnerability_records GROUP BY scan_id) c ON s.scan_id = c.scan_id""",
    BOTH,
)
def _(t):
    return rep.check_details(t(SCANS), stored(t)).select("scan_id", "file_path", "section", "text")


@query(
    "config_snapshot",
    """SELECT scan_id, ai_analysis_enabled AND scan_id % 2 = 0 AS enable_ai_analysis, CAST(0 AS BIGINT) AS max_files_per_scan FROM scan_records""",
    [SCANS],
)
def _(t):
    """Two option sets, attached to scans as JSON and read back."""
    from sourcelode.options import ScanOptions, config_snapshot

    on = F.lit(config_snapshot(ScanOptions(extra={"llm": {"model": "m", "api_key": "x"}})))
    off = F.lit(config_snapshot(ScanOptions(enable_ai_analysis=False)))
    chosen = F.when(F.col("ai_analysis_enabled") & (F.col("scan_id") % 2 == 0), on).otherwise(off)
    kept = t(SCANS).select("scan_id", chosen.alias("configuration"))
    return kept.select(
        "scan_id",
        F.get_json_object("configuration", "$.scanner.enable_ai_analysis").cast("boolean").alias("enable_ai_analysis"),
        F.get_json_object("configuration", "$.scanner.max_files_per_scan").cast("long").alias("max_files_per_scan"),
    )
