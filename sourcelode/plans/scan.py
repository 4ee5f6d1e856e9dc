"""Whole jobs: scan a tree, profile files, enrich findings with verdicts."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from sourcelode import __version__
from sourcelode.functions import metrics as m, vectors as v
from sourcelode.functions.rules import BUILTIN_FAMILIES
from sourcelode.operators import detect as det, verdicts as ver
from sourcelode.operators.summary import scan_summary, scan_totals
from sourcelode.options import ScanOptions, config_snapshot
from sourcelode.sources import files as src


def scan_tree(
    spark: SparkSession, roots, options: ScanOptions = ScanOptions(),
    families: tuple = BUILTIN_FAMILIES, tasks: int | None = None,
):
    """(files, findings) of the source trees below ``roots``."""
    paths = src.list_files(spark, roots, options, tasks=tasks)
    return scan_paths(src.select_paths(paths, options), options, families, tasks)


def scan_paths(
    paths: DataFrame, options: ScanOptions = ScanOptions(), families: tuple = BUILTIN_FAMILIES,
    tasks: int | None = None,
):
    """Same for a table of paths, at most ``max_files_per_scan`` (0: all) per root, by path."""
    capped = src.cap_files(paths, options.max_files_per_scan, per="root")
    files = det.with_language(src.read_source(capped, tasks), options)
    return files, det.detect(files, options, families, keys=("root", "file_path"))


def scan_file(spark: SparkSession, path: str, options: ScanOptions = ScanOptions()):
    """(files, findings) of one file; both are empty if it does not exist."""
    files = src.read_source(src.file_table(spark, [path]), tasks=1)
    files = det.with_language(src.within_size(files, options), options)
    return files, det.detect(files, options, keys=("root", "file_path"))


def scan_records(files: DataFrame, findings: DataFrame | None, scan_id, started, seconds: float,
                 options: ScanOptions = ScanOptions()) -> DataFrame:
    """One record per scanned root with its counts and the options used.

    Pass findings that are stored already. Without them the built-in rules are counted in the
    same pass over the files that counts lines.
    """
    if findings is None:
        counts = det.file_counts(files, options, keys=("root", "file_path"))
        summary = scan_totals(counts, by=("root",))
    else:
        summary = scan_summary(files, findings, by=("root",))
    return summary.select(
        F.concat_ws(":", F.lit(scan_id), "root").alias("scan_id"),
        F.lit(started).cast("timestamp_ntz").alias("scan_timestamp"),
        F.lit(float(seconds)).alias("scan_duration"),
        F.col("root").alias("target_path"),
        F.substring_index("root", "/", -1).alias("repository_name"),
        "files_scanned",
        F.col("lines_scanned").alias("total_lines_scanned"),
        F.lit(__version__).alias("scanner_version"),
        F.lit(options.enable_ai_analysis).alias("ai_analysis_enabled"),
        F.lit(config_snapshot(options)).alias("configuration"),
    )


def profile_text(files: DataFrame) -> DataFrame:
    """All metrics of each file that come from its text, a map over rows; the text itself is left behind."""
    return m.with_lines(files).withColumns(
        {
            "complexity_score": m.complexity(),
            "security_risk_score": m.risk_score(),
            "maintainability_score": m.maintainability(),
            "code_quality_score": m.code_quality(),
            "detected_patterns": m.detected_indicators(),
            **m.line_stats(),
            "indentation_levels": m.indentation_histogram(),
            "function_count": m.function_count(),
            "class_count": m.class_count(),
            "import_count": m.import_count(),
            "control_structures": m.control_counts(),
            "code_length": F.length("content").cast("long"),
        }
    ).withColumns(
        {
            "pattern_count": F.size("detected_patterns").cast("long"),
            "risk_score": m.indicator_risk("detected_patterns"),
            "high_risk_patterns": m.high_risk("detected_patterns"),
            "medium_risk_patterns": m.medium_risk("detected_patterns"),
        }
    ).drop("_lines", "_code", "content")


def profile_vectors(measured: DataFrame, embedding: str = "embedding", model: str = "hashed-words") -> DataFrame:
    """Rows of :func:`profile_text` with their embeddings: the metrics of the vector and the overall risk.

    Files without an embedding keep their text metrics and get an ``error``.
    """
    def of_vector(value):
        return F.when(F.col(embedding).isNotNull(), value)

    overall = m.overall_risk(
        "complexity_score", "maintainability_score", "code_quality_score", "semantic_complexity",
        "embedding_entropy", "risk_score", "embedding_security_score",
    )
    return (
        measured.withColumns(
            {
                "embedding_magnitude": of_vector(v.norm(embedding)),
                "embedding_entropy": of_vector(v.entropy(embedding)),
                "semantic_complexity": of_vector(v.semantic_complexity(embedding)),
                "pattern_diversity": of_vector(v.pattern_diversity(embedding)),
                "embedding_security_score": of_vector(v.security_signal(embedding)),
            }
        )
        .withColumn("overall_risk_score", of_vector(overall))
        .withColumn(
            "analysis_metadata",
            F.struct(
                F.lit(model).alias("model_used"),
                F.size(embedding).cast("long").alias("embedding_dimensions"),
                F.col("code_length"),
                F.col("language").alias("language"),
            ),
        )
        .withColumn("error", F.when(F.col(embedding).isNull(), "no embedding"))
        .drop("code_length", embedding)
    )


def profile_code(files: DataFrame, embedding: str = "embedding", model: str = "hashed-words"):
    """All code metrics of files that have their embedding at hand; a map over rows. With embeddings in a table of
    their own, join them to the rows of :func:`profile_text`, so that no text is moved."""
    return profile_vectors(profile_text(files), embedding, model)


def enrich(
    findings: DataFrame, files: DataFrame, client, tasks: int, options: ScanOptions = ScanOptions(),
    keys=("file_path",), context: dict | None = None, provider="", model="", as_of=None, ledger=None,
) -> DataFrame:
    """Findings after a model's review; unchanged when reviewing is switched off.

    With a ``ledger`` (:class:`AnswerLedger`) each distinct prompt is asked once, in this run and later ones.
    """
    if not options.enable_ai_analysis:
        return findings
    # Windows cut by detect() need no second look at the files.
    cut = "prompt_snippet" in findings.columns
    sourced = findings if cut else ver.with_source(findings, files, keys)
    prompts = ver.build_prompts(sourced, "prompt_snippet", context)
    answers = ledger.ask(prompts, "id", client, tasks) if ledger else ver.batch_infer(prompts, "id", client, tasks)
    verdicts = answers.select(
        "id", ver.parse_verdict("analysis_json").alias("analysis"),
        ver.parse_verdict("doubt_json").alias("doubt"),
    )
    merged = ver.merge_verdicts(findings, verdicts, "id", provider, model, as_of)
    return ver.drop_false_positives(merged, options.false_positive_reduction)
