"""Queries on source files: paths, languages, lines, rules, findings."""

from pyspark.sql import functions as F

from sourcelode.functions import paths as pth, text as txt
from sourcelode.functions.lookups import FINDING_LANGUAGES, LANGUAGE_ALIASES
from sourcelode.functions.rules import (
    BUILTIN_FAMILIES,
    Family,
    Rule,
    rule_catalog,
    with_rules_enabled,
    without_family,
)
from sourcelode.operators import detect as det, summary as agg
from sourcelode.options import ScanOptions
from sourcelode.plans.scan import scan_file, scan_tree
from sourcelode.session import scratch_path
from sourcelode.sources import files as src, repos
from sourcelode.operators.tablefunctions import register_detector
from sourcelode.sources.tree import read_tree
from workload import sqlparts as sp
from workload.registry import literal, query, sql_case

SMALL = ScanOptions(max_file_size_mb=0.004)
DIR = "regexp_replace(file_path, '/[^/]*$', '')"
ROOT = "concat('/corpus/', repo)"
EXCLUDED = " OR ".join(
    f"file_path ILIKE '%/{name}/%'" for name in ("node_modules", "venv", "env", ".git", "dist", "build")
)
DIR_EXCLUDED = EXCLUDED.replace("file_path", DIR)
HIDDEN = f"regexp_matches(substr({DIR}, length({ROOT}) + 1), '/\\.')"
INCLUDED = " OR ".join(f"file_path ILIKE '%.{ext}'" for ext in ("py", "js", "ts", "jsx", "tsx"))


def path_table(t):
    files = t("src_files")
    return files.select(
        "file_id", "repo", F.concat(F.lit("/corpus/"), "repo").alias("root"), "file_path",
        F.octet_length("content").cast("long").alias("length"), "content",
    )


def scanned(t):
    return det.with_language(t("src_files"))


def findings(t, **options):
    return det.detect(scanned(t), keys=("file_id", "repo", "file_path"), **options)


# --- paths -----------------------------------------------------------------------------------


@query("exclude_paths", f"SELECT file_id, file_path FROM src_files WHERE NOT ({EXCLUDED})", ["src_files"])
def _(t):
    return src.exclude_paths(path_table(t)).select("file_id", "file_path")


@query(
    "prune_dirs",
    f"SELECT file_id, file_path FROM src_files WHERE NOT ({HIDDEN}) AND NOT ({DIR_EXCLUDED})",
    ["src_files"],
)
def _(t):
    return src.prune_dirs(path_table(t)).select("file_id", "file_path")


@query("include_paths", f"SELECT file_id, file_path FROM src_files WHERE {INCLUDED}", ["src_files"])
def _(t):
    return src.include_paths(path_table(t)).select("file_id", "file_path")


@query(
    "size_limit",
    "SELECT file_id, CAST(strlen(content) AS BIGINT) AS length FROM src_files"
    " WHERE strlen(content) <= 0.004 * 1024 * 1024",
    ["src_files"],
)
def _(t):
    return src.within_size(path_table(t), SMALL).select("file_id", "length")


@query(
    "cap_files",
    "SELECT repo, file_path FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY file_path) AS n"
    " FROM src_files) WHERE n <= 25",
    ["src_files"],
)
def _(t):
    return src.cap_files(path_table(t).select("repo", "file_path"), 25, per="repo")


@query(
    "select_paths",
    f"SELECT file_id, file_path FROM src_files WHERE NOT ({EXCLUDED}) AND NOT ({HIDDEN})"
    f" AND NOT ({DIR_EXCLUDED}) AND ({INCLUDED}) AND strlen(content) <= 10 * 1024 * 1024",
    ["src_files"],
)
def _(t):
    return src.select_paths(path_table(t)).select("file_id", "file_path")


_BYTES = "regexp_extract_all(substr(hex(encode(text)), 1, 16384), '..')"
_PRINTABLE = f"len(list_filter({_BYTES}, lambda b: (b >= '20' AND b <= '7E') OR b IN ('09', '0A', '0D')))"
_IS_TEXT = f"""CASE WHEN strlen(text) = 0 THEN true WHEN list_contains({_BYTES}, '00') THEN false
 ELSE {_PRINTABLE} / len({_BYTES}) >= 0.75 END"""


@query("is_text", f"SELECT doc_id, {_IS_TEXT} AS is_text FROM documents")
def _(t):
    return t("documents").select("doc_id", txt.is_text(F.col("text").cast("binary")).alias("is_text"))


@query(
    "file_info",
    f"SELECT file_path AS path, CAST(strlen(content) AS BIGINT) AS size,"
    f" {_IS_TEXT.replace('text', 'content').replace('is_content', 'is_text')} AS is_text,"
    f" lower({sp.SUFFIX}) AS extension, {sp.NAME} AS name FROM src_files",
    ["src_files"],
)
def _(t):
    rows = path_table(t).withColumn("content", F.col("content").cast("binary"))
    return src.file_info(rows.withColumn("modified", F.lit(None).cast("timestamp"))).drop("modified")


_CLEAN = "replace(raw_path, chr(92), '/')"
_SAFE_PATH = f"""CASE WHEN raw_path = '' OR len(list_filter(string_split({_CLEAN}, '/'),
 lambda p: p = '' OR (starts_with(p, '.') AND p NOT IN ('.git', '.github')))) > 0 THEN NULL ELSE {_CLEAN} END"""


@query("sanitize_path", f"SELECT path_id, {_SAFE_PATH} AS safe_path FROM raw_paths", ["raw_paths"])
def _(t):
    return t("raw_paths").select("path_id", pth.sanitize_path("raw_path").alias("safe_path"))


# Every document as a blob; one path in seven is not allowed.
_BLOB_PATH = "concat(CASE doc_id % 7 WHEN 3 THEN '../' WHEN 5 THEN '.github/' ELSE 'src/' END, 'f', CAST(doc_id AS varchar), '.py')"


@query(
    "repo_file_limit",
    f"""SELECT doc_id AS file_id, {_SAFE_PATH} AS file_path, md5(text) AS content_hash FROM
 (SELECT doc_id, text, {_BLOB_PATH} AS raw_path FROM documents) WHERE strlen(text) <= 20000 AND {_SAFE_PATH} IS NOT NULL""",
)
def _(t):
    path = F.expr(_BLOB_PATH.replace("varchar", "string"))
    blobs = t("documents").select(
        F.col("doc_id").alias("file_id"), path.alias("file_path"),
        F.base64(F.col("text").cast("binary")).alias("blob"),
    )
    return repos.decode_blobs(blobs, 20000).select(
        "file_id", "file_path", F.md5("content").alias("content_hash")
    )


# --- languages -------------------------------------------------------------------------------


@query("detect_language", "SELECT file_id, language FROM all_files", ["src_files"], sp.ALL_FILES)
def _(t):
    return t("src_files").select(
        "file_id", pth.detect_language("file_path", "content").alias("language")
    )


_BY_DOT = sql_case("lower(split_part(file_path, '.', -1))", FINDING_LANGUAGES)
_ALIASED = f"coalesce({sql_case(_BY_DOT, LANGUAGE_ALIASES)}, {_BY_DOT})"


@query("resolve_alias", f"SELECT file_id, {_BY_DOT} AS named, {_ALIASED} AS language FROM src_files", ["src_files"])
def _(t):
    named = pth.finding_language("file_path")
    return t("src_files").select(
        "file_id", named.alias("named"), pth.resolve_alias(named).alias("language")
    )


@query("shebang_language", f"SELECT file_id, {sp.SHEBANG} AS language FROM src_files", ["src_files"])
def _(t):
    return t("src_files").select("file_id", pth.shebang_language("content").alias("language"))


@query(
    "language_info",
    f"SELECT language, lower({sp.SUFFIX}) AS extension, count(*) AS files FROM all_files"
    " WHERE language IS NOT NULL GROUP BY ALL",
    ["src_files"],
    sp.ALL_FILES,
)
def _(t):
    named = t("src_files").withColumn("language", pth.detect_language("file_path", "content"))
    return (
        named.where(F.col("language").isin(*pth.supported_languages()))
        .groupBy("language", F.lower(pth.suffix("file_path")).alias("extension"))
        .agg(F.count(F.lit(1)).alias("files"))
    )


@query("supported_only", "SELECT file_id, file_path, language FROM files", ["src_files"], sp.FILES)
def _(t):
    return scanned(t).select("file_id", "file_path", "language")


@query(
    "project_languages",
    f"SELECT repo, language, count(*) AS file_count FROM all_files WHERE language IS NOT NULL AND NOT ({HIDDEN}) GROUP BY ALL",
    ["src_files"],
    sp.ALL_FILES,
)
def _(t):
    return agg.project_languages(path_table(t))


@query(
    "primary_language",
    f"""SELECT repo, language AS primary_language FROM (SELECT repo, language,
 row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, language) AS n FROM all_files
 WHERE language IS NOT NULL AND NOT ({HIDDEN}) GROUP BY repo, language) WHERE n = 1""",
    ["src_files"],
    sp.ALL_FILES,
)
def _(t):
    return agg.primary_language(agg.project_languages(path_table(t)))


# --- text ------------------------------------------------------------------------------------


@query(
    "explode_lines",
    "SELECT doc_id, unnest(string_split(text, chr(10))) AS line,"
    " CAST(generate_subscripts(string_split(text, chr(10)), 1) AS BIGINT) AS line_number FROM documents",
)
def _(t):
    return t("documents").select("doc_id", F.posexplode(txt.lines("text")).alias("n", "line")).select(
        "doc_id", "line", (F.col("n") + 1).cast("long").alias("line_number")
    )


def _redact_sql(column: str) -> str:
    from sourcelode.functions.lookups import REDACTION_PATTERNS

    for pattern in REDACTION_PATTERNS:
        column = f"regexp_replace({column}, {literal(pattern)}, '[REDACTED]', 'gi')"
    return column


@query("redact", f"SELECT doc_id, {_redact_sql('text')} AS redacted FROM documents")
def _(t):
    return t("documents").select("doc_id", txt.redact("text").alias("redacted"))


@query("redact_conversations", f"SELECT conv_id, turn, {_redact_sql('text')} AS redacted FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", txt.redact("text").alias("redacted"))


_STRIPPED = sp.strip("l")


@query(
    "preprocess_code",
    f"""SELECT file_id, array_to_string(list_filter(list_transform(string_split(content, chr(10)), lambda l: {_STRIPPED}),
 lambda s: s <> '' AND NOT (language = 'python' AND starts_with(s, '#'))
  AND NOT (language = 'javascript' AND starts_with(s, '//'))), chr(10)) AS code FROM files""",
    ["src_files"],
    sp.FILES,
)
def _(t):
    return scanned(t).select("file_id", txt.preprocess_code("content", "language").alias("code"))


@query("code_hash", "SELECT doc_id, sha256(text) AS code_hash FROM documents")
def _(t):
    return t("documents").select("doc_id", txt.code_hash("text").alias("code_hash"))


@query(
    "truncate_text",
    "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS short FROM documents",
)
def _(t):
    return t("documents").select("doc_id", txt.truncate("text", 100).alias("short"))


# --- rules and findings ----------------------------------------------------------------------

FINDS = sp.findings()


@query(
    "findings_per_severity",
    "SELECT repo, severity, count(*) AS findings FROM finds GROUP BY ALL",
    ["src_files"],
    FINDS,
)
def findings_per_severity(t):
    """Flagship: findings per repository and severity."""
    return findings(t).groupBy("repo", "severity").agg(F.count(F.lit(1)).alias("findings"))


@query(
    "rule_catalog",
    f"""SELECT r.rule_id, r.title, r.severity, r.confidence, r.cwe_id, r.owasp_category,
 count(v.finding_id) AS findings FROM rules r LEFT JOIN vulnerability_records v ON v.vulnerability_type = r.rule_id GROUP BY ALL""",
    ["vulnerability_records"],
    sp.rule_values(threshold=0),
)
def _(t):
    counts = t("vulnerability_records").groupBy(F.col("vulnerability_type").alias("rule_id")).agg(
        F.count(F.lit(1)).alias("findings")
    )
    return (
        rule_catalog(t.spark).join(counts, "rule_id", "left").na.fill(0, ["findings"])
        .select("rule_id", "title", "severity", "confidence", "cwe_id", "owasp_category", "findings")
    )


@query(
    "match_rules",
    "SELECT file_id, rule_id, line_number, regex_match FROM finds",
    ["src_files"],
    FINDS,
)
def _(t):
    return det.match_rules(scanned(t), keys=("file_id",)).select(
        "file_id", "rule_id", "line_number", "regex_match"
    )


@query(
    "match_position",
    "SELECT file_id, rule_id, line_number, column_number, end_column_number FROM finds",
    ["src_files"],
    FINDS,
)
def _(t):
    return det.match_rules(scanned(t), keys=("file_id",)).select(
        "file_id", "rule_id", "line_number", "column_number", "end_column_number"
    )


_ID = """sha256(concat_ws('|', CAST(file_id AS varchar), repo, file_path, rule_id, CAST(line_number AS varchar),
 CAST(column_number AS varchar), CAST(end_column_number AS varchar)))"""


@query(
    "snippet",
    "SELECT file_id, rule_id AS vulnerability_type, line_number, column_number, code_snippet FROM finds",
    ["src_files"],
    FINDS,
)
def _(t):
    return findings(t).select(
        "file_id", "vulnerability_type", "line_number", "column_number", "code_snippet"
    )


@query(
    "build_finding",
    f"""SELECT {_ID} AS id, rule_id AS vulnerability_type, title, description, severity, confidence, file_path,
 line_number, cwe_id, owasp_category, remediation, regex_match FROM finds""",
    ["src_files"],
    FINDS,
)
def _(t):
    return findings(t).select(
        "id", "vulnerability_type", "title", "description", "severity", "confidence", "file_path",
        "line_number", "cwe_id", "owasp_category", "remediation",
        F.col("metadata")["regex_match"].alias("regex_match"),
    )


@query(
    "rule_lookup",
    """SELECT v.finding_id, r.title, r.cwe_id, r.owasp_category, r.remediation FROM vulnerability_records v
 JOIN rules r ON v.vulnerability_type = r.rule_id""",
    ["vulnerability_records"],
    sp.rule_values(threshold=0),
)
def _(t):
    # The catalogue is a fixed list of rules held by the driver: always small.
    rules = F.broadcast(rule_catalog(t.spark).withColumnRenamed("rule_id", "vulnerability_type"))
    return t("vulnerability_records").select("finding_id", "vulnerability_type").join(
        rules, "vulnerability_type"
    ).select("finding_id", "title", "cwe_id", "owasp_category", "remediation")


# "files" as python: inline code has no path to tell the language from.
_INLINE = "files AS (SELECT *, 'python' AS language FROM src_files)"


@query(
    "inline_source",
    "SELECT file_id, rule_id AS vulnerability_type, line_number, column_number FROM finds",
    ["src_files"],
    sp.findings(_INLINE),
)
def _(t):
    code = t("src_files").select("file_id", "content")
    return det.scan_code(code, "python", keys=("file_id", "file_path")).select(
        "file_id", "vulnerability_type", "line_number", "column_number"
    )


_STRICT = ScanOptions(confidence_threshold=0.7)


@query(
    "confidence_filter",
    "SELECT rule_id AS vulnerability_type, confidence, count(*) AS findings FROM finds GROUP BY ALL",
    ["src_files"],
    sp.findings(rules=sp.rule_values(threshold=0.7)),
)
def _(t):
    return findings(t, options=_STRICT).groupBy("vulnerability_type", "confidence").agg(
        F.count(F.lit(1)).alias("findings")
    )


@query(
    "min_severity",
    "SELECT finding_id, severity FROM vulnerability_records WHERE severity IN ('HIGH', 'CRITICAL')",
    ["vulnerability_records"],
)
def _(t):
    return agg.min_severity(t("vulnerability_records"), "HIGH").select("finding_id", "severity")


@query(
    "by_type",
    "SELECT finding_id, scan_id FROM vulnerability_records WHERE vulnerability_type = 'xss_eval'",
    ["vulnerability_records"],
)
def _(t):
    return agg.by_type(t("vulnerability_records"), "xss_eval").select("finding_id", "scan_id")


_TOGGLED = with_rules_enabled(without_family(BUILTIN_FAMILIES, "Weak Cryptography"), ["xss_eval"], False)


@query(
    "rule_toggle",
    "SELECT rule_id AS vulnerability_type, count(*) AS findings FROM finds GROUP BY ALL",
    ["src_files"],
    sp.findings(rules=sp.rule_values(_TOGGLED)),
)
def _(t):
    return findings(t, families=_TOGGLED).groupBy("vulnerability_type").agg(
        F.count(F.lit(1)).alias("findings")
    )


# A rule that only a Python scan reproduces (look-ahead), and a detector of the user's own.
_CALLED = Family(
    "Calls", "calls", "LOW", None, (),
    (Rule("called_hash", "Call of a hash", r"(?:md5|sha1)(?=\()", "LOW", "HIGH"),),
)


def _long_files(code, file_path, language):
    """One finding per file of more than 40 lines, at the last of them."""
    last = code.count("\n") + 1
    if last > 40:
        yield {"vulnerability_type": "long_file", "severity": "INFO", "line_number": last, "column_number": 1}


@query(
    "custom_findings",
    """SELECT file_id, vulnerability_type, line_number FROM finds
 UNION ALL SELECT file_id, 'called_hash', line_number FROM (SELECT file_id, line_number, unnest(regexp_extract_all(line, '(?i)(?:md5|sha1)\\(', 0)) FROM one_line)
 UNION ALL SELECT file_id, 'long_file', len(string_split(content, chr(10))) FROM files WHERE len(string_split(content, chr(10))) > 40""",
    ["src_files"],
    FINDS,
)
def _(t):
    """Catalogue rules, a Python-only rule and a detector of one's own, as one table."""
    keys = ("file_id", "repo", "file_path")
    found = findings(t, families=(*BUILTIN_FAMILIES, _CALLED))
    own = det.detect_custom(scanned(t), _long_files, keys)
    return found.unionByName(own).select("file_id", "vulnerability_type", "line_number")


@query(
    "rule_automaton",
    "SELECT file_id, vulnerability_type, line_number, column_number FROM finds",
    ["src_files"],
    FINDS,
)
def _(t):
    """All rules chosen by one automaton, as it is done for catalogues too large for a plan."""
    found = det.match_rules(scanned(t), keys=("file_id",), most_expressions=0)
    return found.select("file_id", F.col("rule_id").alias("vulnerability_type"), "line_number", "column_number")


@query(
    "detector_in_sql",
    """SELECT file_id, 'long_file' AS vulnerability_type, CAST(len(string_split(content, chr(10))) AS BIGINT) AS line_number, 'long_files' AS detector
 FROM files WHERE len(string_split(content, chr(10))) > 40""",
    ["src_files"],
    sp.FILES,
)
def _(t):
    """A detector of one's own as a table function, called for every file in SQL."""
    register_detector(t.spark, "long_files", _long_files)
    return t.spark.sql(
        "SELECT f.file_id, d.vulnerability_type, d.line_number, d.detector FROM {files} f, LATERAL long_files(f.content, f.file_path, f.language) d WHERE d.error IS NULL",
        files=scanned(t),
    )


@query(
    "union_findings",
    """SELECT language, family, count(*) AS findings FROM (SELECT language, split_part(rule_id, '_', 1) AS family FROM finds) GROUP BY ALL""",
    ["src_files"],
    FINDS,
)
def _(t):
    """Two sets of families, scanned apart and put together."""
    parts = [findings(t, families=BUILTIN_FAMILIES[:2]), findings(t, families=BUILTIN_FAMILIES[2:])]
    return parts[0].unionByName(parts[1]).groupBy(
        "language", F.substring_index("vulnerability_type", "_", 1).alias("family")
    ).agg(F.count(F.lit(1)).alias("findings"))


_TOTALS = """SELECT f.repo, f.files_scanned, f.lines_scanned, coalesce(v.n, 0) AS vulnerabilities_found FROM
 (SELECT repo, count(*) AS files_scanned, CAST(sum(len(string_split(content, chr(10)))) AS BIGINT) AS lines_scanned FROM files GROUP BY repo) f
 LEFT JOIN (SELECT repo, count(*) AS n FROM finds GROUP BY repo) v ON f.repo = v.repo"""


@query("scan_summary", _TOTALS, ["src_files"], FINDS)
def _(t):
    return agg.scan_totals(det.file_counts(scanned(t), keys=("repo",)))


@query("scan_summary_of_findings", _TOTALS, ["src_files"], FINDS)
def _(t):
    """The same totals where findings are already a table of their own."""
    return agg.scan_summary(scanned(t), findings(t))


@query(
    "artifacts",
    f"SELECT file_path, {sp.mime('file_path')} AS mime_type FROM (SELECT DISTINCT file_path FROM vulnerability_records)",
    ["vulnerability_records"],
)
def _(t):
    return agg.artifacts(t("vulnerability_records"))


@query("mime_type", f"SELECT file_id, {sp.mime('file_path')} AS mime_type FROM src_files", ["src_files"])
def _(t):
    return t("src_files").select("file_id", pth.mime_type("file_path").alias("mime_type"))


@query(
    "finding_language",
    f"SELECT finding_id, {_BY_DOT} AS language FROM vulnerability_records",
    ["vulnerability_records"],
)
def _(t):
    return t("vulnerability_records").select(
        "finding_id", pth.finding_language("file_path").alias("language")
    )


@query(
    "dedupe_code",
    "SELECT sha256(text) AS code_hash, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1",
)
def _(t):
    return agg.dedupe_code(t("documents"), "doc_id", "text")


@query(
    "dedupe_rate",
    """SELECT count(*) AS requests, count(DISTINCT text) AS distinct_codes, count(*) - count(DISTINCT text) AS hits,
 round((count(*) - count(DISTINCT text)) / count(*), 6) AS hit_rate FROM documents""",
)
def _(t):
    return agg.dedupe_rate(agg.dedupe_code(t("documents"), "doc_id", "text")).withColumn(
        "hit_rate", F.round("hit_rate", 6)
    )


# --- trees on disk ---------------------------------------------------------------------------


def export_tree(t, where="true"):
    """Write the source files that fit a condition below a fresh shared folder, from the tasks that hold them."""
    base = scratch_path(t.spark, "tree")

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        local = "://" not in base
        system, top = (fs.LocalFileSystem(), base) if local else fs.FileSystem.from_uri(base)
        for batch in batches:
            for path, content in zip(batch.column("file_path"), batch.column("content")):
                full = top + path.as_py()
                system.create_dir(full.rpartition("/")[0], recursive=True)
                with system.open_output_stream(full) as out:
                    out.write(content.as_py().encode("utf-8"))
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    files = t("src_files").where(where).select("file_path", "content")
    files.mapInArrow(write, "n long").agg(F.sum("n")).write.format("noop").mode("overwrite").save()
    roots = t("src_files").select(F.concat(F.lit(base + "/corpus/"), "repo").alias("root")).distinct()
    return base, roots


def _below(base: str):
    return F.expr(f"substr(file_path, {len(base) + 1})").alias("file_path")


@query(
    "list_files",
    f"SELECT file_path, CAST(strlen(content) AS BIGINT) AS length FROM src_files WHERE NOT ({HIDDEN}) AND NOT ({DIR_EXCLUDED})",
    ["src_files"],
)
def _(t):
    base, roots = export_tree(t)
    return src.list_files(t.spark, roots).select(_below(base), "length")


@query(
    "read_source",
    f"SELECT file_path, sha256(regexp_replace(content, '\\r\\n?', chr(10), 'g')) AS code_hash FROM src_files WHERE NOT ({HIDDEN}) AND NOT ({DIR_EXCLUDED})",
    ["src_files"],
)
def _(t):
    base, roots = export_tree(t)
    files = src.read_source(src.list_files(t.spark, roots))
    return files.select(_below(base), txt.code_hash("content").alias("code_hash"))


@query(
    "tree_source",
    f"""SELECT file_path, sha256(regexp_replace(content, '\\r\\n?', chr(10), 'g')) AS code_hash FROM src_files
 WHERE NOT ({EXCLUDED}) AND NOT ({HIDDEN}) AND NOT ({DIR_EXCLUDED}) AND ({INCLUDED})""",
    ["src_files"],
)
def _(t):
    """The files of a scan through the data source."""
    base, roots = export_tree(t)
    files = read_tree(t.spark, [row["root"] for row in roots.collect()])  # a row per repository
    return files.select(_below(base), txt.code_hash("content").alias("code_hash"))


@query(
    "scan_tree",
    f"""SELECT file_path, vulnerability_type, line_number, column_number FROM finds
 WHERE NOT ({EXCLUDED}) AND NOT ({HIDDEN}) AND NOT ({DIR_EXCLUDED}) AND ({INCLUDED})""",
    ["src_files"],
    FINDS,
)
def _(t):
    base, roots = export_tree(t)
    _, found = scan_tree(t.spark, roots)
    return found.select(_below(base), "vulnerability_type", "line_number", "column_number")


@query(
    "scan_file",
    """SELECT vulnerability_type, line_number, column_number FROM finds
 WHERE file_id = (SELECT arg_max(file_id, struct_pack(n := length(content), i := -file_id)) FROM src_files WHERE file_path LIKE '%.py' AND contains(content, 'hashlib.md5('))""",
    ["src_files"],
    FINDS,
)
def _(t):
    """The longest file of a kind, found among all, read from disk and scanned on its own."""
    source = t("src_files").where("file_path LIKE '%.py' AND contains(content, 'hashlib.md5(')")
    first = source.agg(F.max_by(F.struct("file_id", "file_path"), F.struct(F.length("content"), -F.col("file_id"))).alias("f")).first()["f"]
    if first is None:
        return det.detect(source.withColumn("language", F.lit("python"))).select("vulnerability_type", "line_number", "column_number")
    base, _ = export_tree(t, F.col("file_id") == first["file_id"])
    _, found = scan_file(t.spark, base + first["file_path"])
    return found.select("vulnerability_type", "line_number", "column_number")
