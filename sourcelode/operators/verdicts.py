"""Model verdicts: build prompts, read answers, merge them into findings."""

from pyspark.sql import Column, DataFrame, functions as F

from sourcelode.functions import text as txt
from sourcelode.functions.lookups import CONFIDENCE_SCORE, FAILED_VERDICT, SEVERITY_RANK
from sourcelode.schemas import VERDICT

PROMPT_RADIUS = 10
# Findings above this likelihood are dropped; findings per model batch.
FALSE_POSITIVE_LIMIT = 0.8
BATCH = 5

SYSTEM_PROMPT = (
    "You review source code for security weaknesses. Answer with one JSON object holding the keys "
    '"analysis" (text), "severity_assessment" (LOW, MEDIUM, HIGH or CRITICAL), '
    '"false_positive_likelihood" (0.0 to 1.0), "remediation" (text), "attack_vectors" (list of '
    'texts), "impact" (text) and "confidence" (LOW, MEDIUM or HIGH). Say so when you are unsure.'
)


def with_source(findings: DataFrame, files: DataFrame, keys=("repo", "file_path")) -> DataFrame:
    """Add ``prompt_snippet``: each finding's line with ten lines of context from its own file.

    A file meets the distinct lines of its findings once (no more than it has lines); only the
    cut pieces are then joined to the findings, never the text. Findings without a file are left
    out.
    """
    keys, at = list(keys), F.coalesce(F.col("line_number"), F.lit(0)).cast("int")
    wanted = findings.groupBy(*keys).agg(F.collect_set(at).alias("_wanted"))
    split = files.select(*keys, txt.lines("content").alias("_lines")).join(wanted, keys)

    def piece(number):
        window = txt.context_window("_lines", number, PROMPT_RADIUS)
        text = F.when(number > 0, txt.snippet(window, number, PROMPT_RADIUS))
        return F.struct(number.alias("_at"), text.alias("prompt_snippet"))

    pieces = split.select(*keys, F.inline(F.transform("_wanted", piece)))
    return findings.withColumn("_at", at).join(pieces, [*keys, "_at"]).drop("_at")


def context_lines(context: dict) -> Column:
    """``- key: value`` lines; language and path have their own place in the prompt."""
    shown = {k: v for k, v in context.items() if k not in ("language", "file_path")}
    if not shown:
        return F.lit("No additional context provided")
    return F.concat_ws(
        "\n",
        *[
            F.concat(F.lit(f"- {name}: "), F.coalesce(value.cast("string"), F.lit("None")))
            for name, value in shown.items()
        ],
    )


def build_prompts(findings: DataFrame, snippet="code_snippet", context: dict | None = None):
    """Two prompts per finding: judge the weakness, judge whether it is a false alarm."""
    code, language = F.col(snippet), F.coalesce("language", F.lit("unknown"))
    extra = context_lines(context or {})
    block = F.concat(
        F.lit("Language: "), language, F.lit("\n```"), language, F.lit("\n"), code, F.lit("\n```\n")
    )
    judge = F.concat(
        F.lit("Is the marked line a real case of "), F.col("vulnerability_type"), F.lit("?\n"),
        block, F.lit("File: "), F.coalesce("file_path", F.lit("unknown")), F.lit("\nContext:\n"),
        extra, F.lit("\nGive severity, impact, attack scenarios, exact fixes and your confidence."),
    )
    doubt = F.concat(
        F.lit("Could this report be a false positive: "), F.col("description"), F.lit("\n"),
        block, F.lit("Context:\n"), extra,
        F.lit("\nWeigh reachability, existing validation and whether this is test or sample code."),
    )
    return findings.withColumn("analysis_prompt", judge).withColumn("doubt_prompt", doubt)


def batch_infer(prompts: DataFrame, row_id: str, client, tasks: int, batch: int = BATCH) -> DataFrame:
    """Ask an external judge: ``client(system_prompt, [prompt, ...]) -> [answer, ...]``.

    ``tasks`` bounds how many batches are in flight at once. A failing batch gets an answer that
    :func:`parse_verdict` reads as an error.
    """
    size, system = batch, SYSTEM_PROMPT

    def ask(batches):
        import pandas as pd

        for frame in batches:
            for start in range(0, len(frame), size):
                part = frame.iloc[start : start + size]
                answers = {}
                for column, name in (
                    ("analysis_prompt", "analysis_json"), ("doubt_prompt", "doubt_json"),
                ):
                    try:
                        answers[name] = list(client(system, part[column].tolist()))
                    except Exception as error:
                        answers[name] = [f"error: {error}"] * len(part)
                yield pd.DataFrame({row_id: part[row_id].tolist(), **answers})

    kind = prompts.schema[row_id].dataType.simpleString()
    return (
        prompts.select(row_id, "analysis_prompt", "doubt_prompt")
        .repartition(tasks, row_id)
        .mapInPandas(ask, f"{row_id} {kind}, analysis_json string, doubt_json string")
    )


def parse_verdict(answer) -> Column:
    """JSON answer -> verdict struct; unreadable text gives the fixed stand-in with its error."""
    text = txt.as_column(answer)
    schema = VERDICT.simpleString()[len("struct<") : -1].replace(":", " ")
    parsed = F.from_json(text, schema + ", _broken string", {"columnNameOfCorruptRecord": "_broken"})
    failure = F.lit("unreadable answer")
    stand_in = {
        **{name: F.lit(value) for name, value in FAILED_VERDICT.items()},
        "analysis": F.concat(F.lit(FAILED_VERDICT["analysis"]), failure),
        "attack_vectors": F.array().cast("array<string>"),
        "error": failure,
    }
    broken = parsed.isNull() | parsed["_broken"].isNotNull()
    return F.when(
        text.isNotNull(),
        F.struct(
            *[
                F.when(broken, stand_in[field.name]).otherwise(parsed[field.name]).alias(field.name)
                for field in VERDICT
            ]
        ),
    )


def merge_verdicts(
    findings: DataFrame, verdicts: DataFrame, row_id="id", provider="", model="", as_of=None
) -> DataFrame:
    """Fold verdicts (``analysis`` and ``doubt`` structs per ``row_id``) into findings.

    A finding without verdict stays as it is; so do severity and confidence when the verdict's
    value is missing or unknown. A remediation is replaced by a strictly longer one.
    """
    joined = findings.join(verdicts.select(row_id, "analysis", "doubt"), row_id, "left")
    has, said, doubt = F.col("analysis").isNotNull(), F.col("analysis"), F.col("doubt")
    severity, confidence = F.upper(said["severity_assessment"]), F.upper(said["confidence"])
    likelihood = F.when(has, F.coalesce(doubt["false_positive_likelihood"], F.lit(0.5)))
    advice, old = said["remediation"], F.coalesce("remediation", F.lit(""))
    note = F.to_json(
        F.struct(
            F.lit(provider).alias("provider"),
            F.lit(model).alias("model"),
            F.lit(as_of).cast("string").alias("analysis_timestamp"),
            F.coalesce(said["attack_vectors"], F.array().cast("array<string>")).alias("attack_vectors"),
            F.coalesce(said["impact"], F.lit("")).alias("impact"),
            likelihood.alias("false_positive_likelihood"),
            F.coalesce(said["confidence"], F.lit("UNKNOWN")).alias("llm_confidence"),
        )
    )
    changed = {
        "severity": F.when(severity.isin(*SEVERITY_RANK), severity).otherwise(F.col("severity")),
        "confidence": F.when(confidence.isin(*CONFIDENCE_SCORE), confidence).otherwise(
            F.col("confidence")),
        "remediation": F.when(F.length(advice) > F.length(old), advice).otherwise(
            F.col("remediation")),
        "ai_explanation": F.when(has, F.coalesce(said["analysis"], F.lit(""))).otherwise(
            F.col("ai_explanation")),
        "false_positive_likelihood": F.coalesce(likelihood, "false_positive_likelihood"),
        "metadata": F.when(
            has,
            F.map_concat(
                F.map_filter("metadata", lambda key, _: key != "llm_analysis"),
                F.create_map(F.lit("llm_analysis"), note),
            ),
        ).otherwise(F.col("metadata")),
    }
    return joined.select(
        *[changed[name].alias(name) if name in changed else F.col(name) for name in findings.columns]
    )


def drop_false_positives(findings: DataFrame, enabled: bool = True, limit=FALSE_POSITIVE_LIMIT):
    if not enabled:
        return findings
    return findings.where(F.coalesce("false_positive_likelihood", F.lit(0.0)) <= limit)
