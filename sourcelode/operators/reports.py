"""Report shapes: SARIF, scan JSON, check texts, severity table."""

import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from sourcelode import __version__
from sourcelode.functions import text as txt
from sourcelode.functions.lookups import (
    REPORT_LEVELS,
    REPORT_RULE_TYPES,
    REPORT_RULES,
    REPORT_SCHEMA_URI,
    REPORT_VERSION,
)
from sourcelode.functions.paths import as_column, lookup, mime_type
from sourcelode.operators.summary import severity_rank

TOOL_NAME = "sourcelode"


def level(severity="severity") -> Column:
    return F.coalesce(lookup(as_column(severity), REPORT_LEVELS), F.lit("warning"))


def rule_index(vulnerability_type="vulnerability_type") -> Column:
    index = {name: at for at, names in enumerate(REPORT_RULE_TYPES) for name in names}
    return F.coalesce(lookup(as_column(vulnerability_type), index), F.lit(0))


def line_fingerprint(path="file_path", line="line_number", kind="vulnerability_type") -> Column:
    parts = [F.coalesce(as_column(c).cast("string"), F.lit("None")) for c in (path, line, kind)]
    return F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8)


def _or_start(end: Column, start: Column) -> Column:
    """An absent (or zero) end falls back to the start."""
    return F.when(F.coalesce(end, F.lit(0)) != 0, end).otherwise(start)


def _given(text) -> Column:
    """NULL for an empty text, so the JSON writer leaves the field out."""
    column = as_column(text)
    return F.when(column != "", column)


def sarif_result(related=None) -> Column:
    """The row's finding as SARIF result struct; NULL fields vanish in ``to_json``."""
    get = F.col
    region = F.struct(
        get("line_number").alias("startLine"),
        get("column_number").alias("startColumn"),
        _or_start(get("end_line_number"), get("line_number")).alias("endLine"),
        _or_start(get("end_column_number"), get("column_number")).alias("endColumn"),
        F.struct(txt.clean_snippet(get("code_snippet")).alias("text")).alias("snippet"),
    )
    location = F.struct(
        F.struct(
            F.struct(
                get("file_path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")
            ).alias("artifactLocation"),
            region.alias("region"),
        ).alias("physicalLocation")
    )
    fixes = F.when(
        _given(get("remediation")).isNotNull(),
        F.array(F.struct(F.struct(get("remediation").alias("text")).alias("description"))),
    )
    kind = get("vulnerability_type")
    fingerprint = line_fingerprint(get("file_path"), get("line_number"), kind)
    fields = [
        kind.alias("ruleId"),
        rule_index(kind).alias("ruleIndex"),
        F.struct(get("description").alias("text")).alias("message"),
        level(get("severity")).alias("level"),
        F.array(location).alias("locations"),
        F.struct(fingerprint.alias("primaryLocationLineHash")).alias("partialFingerprints"),
        F.struct(
            get("confidence").alias("confidence"),
            get("id").alias("scanner_id"),
            _given(get("cwe_id")).alias("cwe"),
            _given(get("owasp_category")).alias("owasp_category"),
            txt.redact(_given(get("ai_explanation"))).alias("ai_analysis"),
            get("false_positive_likelihood").alias("false_positive_likelihood"),
        ).alias("properties"),
        fixes.alias("fixes"),
    ]
    if related is not None:
        fields.append(related_locations(related).alias("relatedLocations"))
    return F.struct(*fields)


def related_location(file_path, line_number, similarity) -> Column:
    """A similar place as one related location: a row per link, however many links a finding has."""
    return F.struct(
        F.struct(
            F.struct(as_column(file_path).alias("uri")).alias("artifactLocation"),
            F.struct(as_column(line_number).alias("startLine")).alias("region"),
        ).alias("physicalLocation"),
        F.struct(
            F.concat(
                F.lit("Similar vulnerability (similarity: "),
                F.coalesce(as_column(similarity).cast("string"), F.lit("unknown")),
                F.lit(")"),
            ).alias("text")
        ).alias("message"),
    )


def related_locations(similar) -> Column:
    """``array<struct<file_path, line_number, similarity>>`` as related locations; pass bounded lists,
    such as the best ``TOP`` of a finding."""
    return F.transform(
        as_column(similar), lambda place: related_location(place["file_path"], place["line_number"], place["similarity"])
    )


def sarif_results(findings: DataFrame, keys=("scan_id",), related=None) -> DataFrame:
    """One JSON result per finding: the form to write for scans of any size."""
    return findings.select(*keys, "id", F.to_json(sarif_result(related=related)).alias("result"))


def utc_text(stamp) -> Column:
    """ISO time with ``Z``; microseconds only when there are any."""
    column = as_column(stamp)
    whole = F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(column, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("Z"))


def end_time(stamp="scan_timestamp", seconds="scan_duration") -> Column:
    micros = F.round(as_column(seconds) * 1_000_000).cast("long")
    return F.timestamp_micros(F.unix_micros(as_column(stamp).cast("timestamp")) + micros)


def invocation(of: str = "") -> Column:
    """A scan as an invocation; its fields may be in a struct, as in ``of="scan."``."""
    return F.struct(
        F.lit(True).alias("executionSuccessful"),
        utc_text(f"{of}scan_timestamp").alias("startTimeUtc"),
        utc_text(end_time(f"{of}scan_timestamp", f"{of}scan_duration")).alias("endTimeUtc"),
        F.lit("scanner-host").alias("machine"),
    )


def tool_json() -> str:
    """The tool object with its rules: the same text in every document."""
    driver = {
        "name": TOOL_NAME, "version": __version__, "semanticVersion": __version__, "rules": REPORT_RULES,
    }
    return json.dumps({"driver": driver}, separators=(",", ":"))


def provenance(of: str = "") -> Column:
    """Version control details, absent when neither URL nor commit is known."""
    url, commit = f"{of}repository_url", f"{of}commit_hash"
    known = (F.coalesce(url, F.lit("")) != "") | (F.coalesce(commit, F.lit("")) != "")
    return F.when(
        known,
        F.array(
            F.struct(
                _given(url).alias("repositoryUri"),
                _given(commit).alias("revisionId"),
                _given(f"{of}branch").alias("branch"),
            )
        ),
    )


# The place of a finding: entries are in this order.
PLACE = ("file_path", "line_number", "column_number", "vulnerability_type", "id")


_REST = (
    "title", "description", "severity", "confidence", "end_line_number", "end_column_number",
    "code_snippet", "cwe_id", "owasp_category", "remediation", "references", "ai_explanation",
    "false_positive_likelihood",
)

# What a finding's entry is made of, besides its place.
SARIF_FIELDS = tuple(name for name in _REST if name not in ("title", "references"))
JSON_FIELDS = (*_REST, "metadata")
SARIF_FACTS = ("scan_timestamp", "scan_duration", "repository_url", "commit_hash", "branch")


# Sections of a written scan, in this order.
HEAD, ARTIFACTS, RESULTS_HEAD, RESULTS, TAIL = range(5)


def _in_order(scans: DataFrame, findings: DataFrame, heads: dict, artifacts: bool, keys=("scan_id",)):
    """The rows of all scans' documents in writing order, one document after another: texts around lists, and list entries.

    A document is known by ``keys``, the scan and perhaps a part of it. Columns ``keys``, ``section``, the finding's fields (of a file: its path), ``_first`` (entry
    that needs no comma before it) and ``_text`` (a text that is no entry). ``heads`` has the text
    column of each section that is one; what is the same in every document is left to the caller, so that it does not travel.

    The smallest finding of a scan is an aggregate, so no scan is ever gathered: findings meet one
    row per scan (which also drops those of unknown scans) and are range-sorted. The one row per scan is what a task
    hashes, so findings pass by unsorted. Plain fields travel; the longer JSON is made after the sort. Repeated rows need a
    ``_row`` number.
    """
    order = [*PLACE, *[name for name in ("_row",) if name in findings.columns]]
    place = F.struct(*order)
    keys = list(keys)
    first = findings.groupBy(*keys).agg(F.min(place).alias("_least"))
    entries = findings.select(*keys, *order, *_REST, "metadata").join(
        first.join(scans.select(*keys), keys).hint("shuffle_hash"), keys
    )
    parts = [
        entries.withColumns({"section": F.lit(RESULTS), "_first": place.eqNullSafe(F.col("_least"))})
    ]
    if artifacts:
        is_first = F.col("file_path").eqNullSafe(F.col("_least.file_path"))
        known = first.join(scans.select(*keys), keys, "left_semi").hint("shuffle_hash")
        parts.append(
            findings.select(*keys, "file_path").distinct().join(known, keys)
            .select(*keys, "file_path", is_first.alias("_first"), F.lit(ARTIFACTS).alias("section"))
        )
    around = [F.struct(F.lit(at).alias("section"), text.cast("string").alias("_text")) for at, text in heads.items()]
    parts.append(scans.select(*keys, F.inline(F.array(*around))))
    rows = parts[0].drop("_least")
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.orderBy(*keys, "section", *order)


def _in_documents(scans: DataFrame, findings: DataFrame, facts, heads: dict, artifacts: bool, keys, fields: tuple, place_rows, deal=None) -> DataFrame:
    """The rows of :func:`_in_order` for documents that tasks hold whole, with ``fields`` of a finding.

    One row per scan and one per finding travel, once: ``deal`` brings the rows of a document into one task. There a scan's row becomes
    the texts around its lists (made of its ``facts``, in ``_scan``), a finding its entry and that of its file, and ``place_rows``
    sorts them. The row before tells whether an entry opens its list or repeats a file; rows that no scan's row precedes belong to
    unknown scans.
    """
    keys, order, section = list(keys), list(PLACE), F.col("section")
    entries = findings.dropna(subset=keys).select(*keys, *order, *fields)
    rows = scans.select(*keys, F.struct(*facts).alias("_scan")).unionByName(entries, allowMissingColumns=True)
    rows = deal(rows) if deal else rows
    lists = F.array(*[F.lit(at) for at in ((ARTIFACTS, RESULTS) if artifacts else (RESULTS,))])
    rows = rows.withColumn("section", F.explode(F.when(F.col("_scan").isNotNull(), F.array(*map(F.lit, heads))).otherwise(lists)))
    # The entry of a file has nothing but its path.
    whole = section == RESULTS
    rows = rows.select(
        *keys, "section", *[F.col(c) if c == "file_path" else F.when(whole, F.col(c)).alias(c) for c in order],
        F.when(whole, F.struct(*fields)).alias("_rest"), F.when(section == HEAD, heads[HEAD]).alias("_text"),
    )
    placed = place_rows(rows, *keys, "section", *order)
    document = Window.partitionBy(*keys).orderBy("section", *order)
    placed = placed.withColumns({
        "_before": F.lag("section").over(document), "_path": F.lag("file_path").over(document),
        "_scans": F.sum((section == HEAD).cast("int")).over(document.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
    })
    again = (section == ARTIFACTS) & (F.col("_before") == ARTIFACTS) & F.col("_path").eqNullSafe(F.col("file_path"))
    found = placed.where((F.col("_scans") > 0) & ~again).withColumn("_first", F.col("_before") != section)
    # A scan that is listed repeatedly has its findings as often.
    found = found.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.when(whole, F.col("_scans")).otherwise(1).cast("int"))))
    return found.select(*keys, "section", *order, "_rest.*", "_first", "_text")


def _entry(build) -> Column:
    """JSON of a list entry, after a comma unless it is the first of its list."""
    return F.concat(F.when(F.col("_first"), "").otherwise(","), F.to_json(build))


#: What opens and closes a SARIF file around its runs.
SARIF_FILE = (f'{{"$schema":"{REPORT_SCHEMA_URI}","version":"{REPORT_VERSION}","runs":[', "]}")


def run_lines(scans: DataFrame, findings: DataFrame, keys, place_rows, deal=None) -> DataFrame:
    """Runs without the file around them: each names its document (``automationDetails``), so that several can share a file."""
    name = F.to_json(F.struct(F.concat_ws("/", *(F.col(k).cast("string") for k in keys)).alias("id")))
    return _sarif(scans, findings, F.concat(F.lit('{"automationDetails":'), name, F.lit(",")), "]}", keys, place_rows, deal)


def sarif_lines(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """SARIF documents as sorted lines (``scan_id``, ``section``, ``line``).

    The lines of a scan, one after the other, are its document: an envelope, one line per file
    and one per finding, in the order of file, line, column, type and id. Scans follow one
    another by id. A scan of any size is as many lines, in as many tasks as it takes.
    """
    return _sarif(scans, findings, F.lit(SARIF_FILE[0] + "{"), "]}" + SARIF_FILE[1])


def _sarif(scans: DataFrame, findings: DataFrame, opened: Column, closed: str, keys=("scan_id",), place_rows=None, deal=None) -> DataFrame:
    of = "_scan." if place_rows else ""
    rest = F.to_json(
        F.struct(
            F.array(invocation(of)).alias("invocations"),
            F.lit("unicodeCodePoints").alias("columnKind"),
            provenance(of).alias("versionControlProvenance"),
        )
    )
    heads = {HEAD: F.substring(rest, F.lit(2), F.length(rest) - 2), RESULTS_HEAD: F.lit(None), TAIL: F.lit(None)}
    if place_rows:
        rows = _in_documents(scans, findings, SARIF_FACTS, heads, True, keys, SARIF_FIELDS, place_rows, deal)
    else:
        rows = _in_order(scans, findings, heads, True, keys)
    head = F.concat(opened, F.lit(f'"tool":{tool_json()},'), "_text", F.lit(',"artifacts":['))
    artifact = F.struct(
        F.struct(
            F.col("file_path").alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId")
        ).alias("location"),
        mime_type("file_path").alias("mimeType"),
        F.array(F.lit("analysisTarget")).alias("roles"),
    )
    line = (
        F.when(F.col("section") == RESULTS, _entry(sarif_result()))
        .when(F.col("section") == ARTIFACTS, _entry(artifact))
        .when(F.col("section") == HEAD, head)
        .when(F.col("section") == RESULTS_HEAD, F.lit('],"results":['))
        .otherwise(F.lit(closed))
    )
    return rows.select(*keys, "section", line.alias("line"))


def finding_json() -> Column:
    """A finding as nested JSON fields."""
    place = ("file_path", "line_number", "column_number", "end_line_number", "end_column_number")
    plain = [name for name in ("id", "vulnerability_type", *_REST) if name not in place]
    return F.struct(*plain, F.struct(*place).alias("location"), "metadata")


def scan_lines(scans: DataFrame, findings: DataFrame, keys=("scan_id",), place_rows=None, deal=None) -> DataFrame:
    """Scan results as JSON documents in sorted lines, built like :func:`sarif_lines`."""
    head = F.to_json(F.col("_scan") if place_rows else F.struct(*scans.columns), {"ignoreNullFields": "false"})
    opened = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"vulnerabilities":['))
    if place_rows:
        rows = _in_documents(scans, findings, scans.columns, {HEAD: opened, TAIL: F.lit(None)}, False, keys, JSON_FIELDS, place_rows, deal)
    else:
        rows = _in_order(scans, findings, {HEAD: opened, TAIL: F.lit(None)}, False, keys)
    line = (
        F.when(F.col("section") == RESULTS, _entry(finding_json()))
        .when(F.col("section") == HEAD, F.col("_text"))
        .otherwise(F.lit("]}"))
    )
    return rows.select(*keys, "section", line.alias("line"))


def severity_report(findings: DataFrame, description: str = "description") -> DataFrame:
    """The six report columns, worst first; description cut at 100 characters."""
    rank = F.coalesce(severity_rank(), F.lit(-1))
    return findings.orderBy(F.desc(rank), *[c for c in PLACE if c in findings.columns]).select(
        "severity", F.col("vulnerability_type").alias("type"), F.col("file_path").alias("file"),
        F.col("line_number").cast("string").alias("line"),
        txt.truncate(description, 100).alias("description"), "confidence",
    )


# Texts and marks of the check report.
CLEAN_SUMMARY = "✅ No security vulnerabilities found!"
CLEAN_DETAILS = "No vulnerabilities detected in the scanned code."
SEVERITY_MARKS = {"CRITICAL": "🔴", "HIGH": "🟠", "MEDIUM": "🟡", "LOW": "🟢"}
OTHER_MARK = "⚪"


def check_summary(counts: DataFrame, key: str = "scan_id") -> DataFrame:
    """One line per scan from its severity counts; severities without findings are left out."""
    def part(severity: str) -> Column:
        number = F.col(f"{severity.lower()}_count")
        text = F.concat(
            F.lit(SEVERITY_MARKS[severity] + " "), number.cast("string"),
            F.lit(" " + severity.capitalize()),
        )
        return F.when(number > 0, text)

    total = F.col("total_vulnerabilities")
    found = F.concat(F.lit("🔍 Found "), total.cast("string"), F.lit(" security issue(s):"))
    summary = F.concat_ws(" | ", found, *[part(severity) for severity in SEVERITY_MARKS])
    return counts.select(
        key, F.when(total == 0, CLEAN_SUMMARY).otherwise(summary).alias("summary")
    )


def _finding_lines() -> Column:
    mark = F.coalesce(lookup(F.col("severity"), SEVERITY_MARKS), F.lit(OTHER_MARK))
    text = [
        F.concat(
            F.lit("- "), mark, F.lit(" **"), F.col("vulnerability_type"), F.lit("** (Line "),
            F.coalesce(F.col("line_number").cast("string"), F.lit("None")), F.lit(")"),
        ),
        F.concat(F.lit("  - **Severity:** "), F.col("severity")),
        F.concat(F.lit("  - **Confidence:** "), F.col("confidence")),
        F.concat(F.lit("  - **Description:** "), F.col("description")),
        F.concat(F.lit("  - **Remediation:** "), _given("remediation")),
    ]
    return F.concat(F.concat_ws("\n", *text), F.lit("\n"))


def check_details(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Markdown report as sorted texts: a header per scan (NULL file), a header per file, then a
    text per finding.

    The texts of a scan, joined by line breaks, are its report. The line formats are fixed values.
    """
    title = F.concat(F.lit("### "), F.col("file_path"), F.lit("\n"))
    files = findings.groupBy("scan_id", "file_path").agg(F.count(F.lit(1)).alias("_n"))
    found = files.groupBy("scan_id").agg(F.sum("_n").alias("_n"))
    header = F.concat_ws(
        "\n",
        F.lit("## Scan Results"),
        F.lit(""),
        F.concat(F.lit("- **Files Scanned:** "), F.col("files_scanned").cast("string")),
        F.concat(F.lit("- **Lines Scanned:** "), F.col("total_lines_scanned").cast("string")),
        F.concat(F.lit("- **Scan Duration:** "), F.format_string("%.2f", "scan_duration"), F.lit("s")),
        F.lit(""),
        F.lit("## Vulnerabilities by File"),
        F.lit(""),
    )
    headers = scans.join(found, "scan_id", "left").select(
        "scan_id", F.lit(0).alias("section"),
        F.when(F.col("_n") > 0, header).otherwise(CLEAN_DETAILS).alias("text"),
    )
    titles = files.select("scan_id", "file_path", F.lit(1).alias("section"), title.alias("text"))
    places = ("line_number", "column_number", "vulnerability_type", "id")
    texts = findings.select(
        "scan_id", "file_path", F.lit(2).alias("section"), *places, _finding_lines().alias("text")
    )
    rows = texts.unionByName(titles, allowMissingColumns=True)
    rows = rows.unionByName(headers, allowMissingColumns=True)
    whole = F.when(F.col("section") == 0, 0).otherwise(1)
    return rows.orderBy("scan_id", whole, "file_path", "section", *places).select(
        "scan_id", "file_path", "section", "line_number", "id", "text"
    )
