"""Explicit schemas of the tables the jobs read and write."""

from pyspark.sql import types as T


def _fields(*specs: tuple) -> list:
    return [T.StructField(name, kind, True) for name, kind in specs]


_S, _I, _L, _D, _B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()
_TS, _LIST = T.TimestampNTZType(), T.ArrayType(T.StringType())

PATHS = T.StructType(
    _fields(("root", _S), ("file_path", _S), ("length", _L), ("modified", T.TimestampType()))
)

RULES = T.StructType(
    _fields(
        ("rule_id", _S), ("family", _S), ("title", _S), ("pattern", _S), ("severity", _S),
        ("confidence", _S), ("cwe_id", _S), ("owasp_category", _S), ("description", _S),
        ("remediation", _S), ("references", _LIST), ("languages", _LIST),
        ("family_languages", _LIST), ("enabled", _B),
    )
)

FINDINGS = T.StructType(
    _fields(
        ("id", _S), ("vulnerability_type", _S), ("title", _S), ("description", _S),
        ("severity", _S), ("confidence", _S), ("file_path", _S), ("line_number", _L),
        ("column_number", _L), ("end_line_number", _L), ("end_column_number", _L),
        ("code_snippet", _S), ("cwe_id", _S), ("owasp_category", _S), ("remediation", _S),
        ("references", _LIST), ("metadata", T.MapType(_S, _S)), ("ai_explanation", _S),
        ("false_positive_likelihood", _D),
    )
)

CODE_EMBEDDINGS = T.StructType(
    _fields(
        ("code_hash", _S), ("embedding", T.ArrayType(_D)), ("model_name", _S),
        ("model_version", _S), ("created_at", T.TimestampType()),
    )
)

SCAN_RECORDS = T.StructType(
    _fields(
        ("id", _S), ("scan_id", _S), ("scan_timestamp", _TS), ("scan_duration", _D),
        ("scanner_version", _S), ("target_type", _S), ("target_path", _S),
        ("repository_url", _S), ("repository_name", _S), ("branch", _S), ("commit_hash", _S),
        ("files_scanned", _L), ("total_lines_scanned", _L), ("languages_detected", _LIST),
        ("ai_analysis_enabled", _B), ("patterns_used", _LIST), ("total_vulnerabilities", _L),
        ("critical_count", _L), ("high_count", _L), ("medium_count", _L), ("low_count", _L),
        ("user_id", _S), ("user_email", _S),
    )
)

VULNERABILITY_RECORDS = T.StructType(
    _fields(
        ("id", _S), ("scan_id", _S), ("vulnerability_type", _S), ("severity", _S),
        ("confidence", _S), ("cwe_id", _S), ("owasp_category", _S), ("description", _S),
        ("remediation", _S), ("explanation", _S), ("file_path", _S), ("line_number", _L),
        ("column_number", _L), ("end_line_number", _L), ("end_column_number", _L),
        ("code_snippet", _S), ("ai_analyzed", _B), ("false_positive_probability", _D),
        ("ai_confidence", _D), ("references", _LIST), ("status", _S), ("fixed_at", _TS),
        ("fixed_in_commit", _S), ("created_at", _TS), ("updated_at", _TS),
    )
)

SCAN_COMPARISONS = T.StructType(
    _fields(
        ("baseline_scan_id", _S), ("current_scan_id", _S), ("comparison_timestamp", _TS),
        ("new_vulnerabilities", _L), ("fixed_vulnerabilities", _L),
        ("persistent_vulnerabilities", _L), ("severity_increased", _L),
        ("severity_decreased", _L), ("changes_detail", _S), ("overall_trend", _S),
        ("risk_score_change", _D),
    )
)

PATTERN_USAGE = T.StructType(
    _fields(
        ("pattern_name", _S), ("pattern_category", _S), ("cwe_id", _S), ("times_triggered", _L),
        ("true_positives", _L), ("false_positives", _L), ("accuracy_rate", _D),
        ("avg_severity", _D), ("first_used", _TS), ("last_used", _TS),
        ("stats_period_start", _TS), ("stats_period_end", _TS),
    )
)

USAGE_METRICS = T.StructType(
    _fields(
        ("scan_id", _S), ("provider", _S), ("model", _S), ("total_requests", _L),
        ("successful_requests", _L), ("failed_requests", _L), ("prompt_tokens", _L),
        ("completion_tokens", _L), ("total_tokens", _L), ("estimated_cost", _D),
        ("cost_per_vulnerability", _D), ("avg_response_time", _D), ("total_api_time", _D),
        ("cache_hits", _L), ("cache_misses", _L), ("cache_hit_rate", _D), ("created_at", _TS),
    )
)

VERDICT = T.StructType(
    _fields(
        ("analysis", _S), ("severity_assessment", _S), ("false_positive_likelihood", _D),
        ("remediation", _S), ("attack_vectors", _LIST), ("impact", _S), ("confidence", _S),
        ("error", _S),
    )
)
