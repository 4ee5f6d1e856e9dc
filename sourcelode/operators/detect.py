"""Detection: rules x lines -> findings, in one pass over the files and without a shuffle."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sourcelode.functions import text as txt
from sourcelode.functions.automaton import RuleChooser
from sourcelode.functions.paths import detect_language
from sourcelode.functions.rules import BUILTIN_FAMILIES, Rule, active_rules, rule_catalog
from sourcelode.options import ScanOptions
from sourcelode.schemas import FINDINGS

SNIPPET_RADIUS = 3
# Rules that become expressions of a plan; larger catalogues go through an automaton in Python.
MOST_EXPRESSIONS = 100
# Offsets of many matches on one line are summed block by block.
BLOCK = 1024


def with_language(files: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Add ``language`` and keep the files of a configured language."""
    return files.withColumn("language", detect_language("file_path", "content")).where(
        F.col("language").isin(*options.languages)
    )


# The tests below are SQL text: a catalogue of rules makes hundreds of small expressions, and one
# parsed text is far quicker to build than as many Column objects.


def _text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def _one_of(tests) -> str:
    return "(" + " OR ".join(tests) + ")"


def _speaks(language: str, langs) -> str:
    return f"{language} IN ({', '.join(_text(lang) for lang in langs)})"


def _may_match(rule: Rule, lowered: str) -> str:
    """False only if the rule cannot match a text with this lower-case form."""
    groups = [
        _one_of(f"contains({lowered}, {_text(word)})" for word in group) for group in rule.needles
    ]
    return "(" + " AND ".join(groups or ["true"]) + ")"


def _folds(text: str) -> str:
    return _one_of(f"contains({text}, {_text(letter)})" for letter in txt.FOLDING_LETTERS)


def _worth_matching(rules, language: str, text: str, lowered: str) -> str:
    """False only if no active rule can match anything in ``text``."""
    by_langs: dict = {}
    for rule, langs in rules:
        by_langs.setdefault(langs, {}).setdefault(rule.needles, rule)
    tests = [
        f"({_speaks(language, langs)} AND {_one_of(_may_match(r, lowered) for r in group.values())})"
        for langs, group in by_langs.items()
    ]
    return _one_of([*tests, _folds(text)])


def candidate_lines(files: DataFrame, rules, keys, radius: int) -> DataFrame:
    """One row per line that some rule may match, with its context cut out.

    Context is cut while the lines are still an array, so no row ever carries the whole file.
    """
    split = files.select(*keys, "language", txt.lines("content").alias("_lines"))
    worth = _worth_matching(rules, "language", "r.text", "r.low")
    first = f"greatest(r.n - {radius}, 1)"
    # explode_outer: Spark would otherwise add (and evaluate twice) a "size > 0" filter below.
    kept = f"""explode_outer(transform(
        filter(
            transform(_lines, (line, i) -> struct(i + 1 AS n, line AS text, lower(line) AS low)),
            r -> {worth}),
        r -> struct(r.n, r.text, r.low,
            slice(_lines, {first}, r.n + {radius} - {first} + 1) AS window)))"""
    return (
        split.select(*keys, "language", F.expr(kept).alias("_c"))
        .where("_c IS NOT NULL")
        .select(
            *keys, "language", F.col("_c.n").alias("line_number"),
            F.col("_c.text").alias("_text"), F.col("_c.low").alias("_low"),
            F.col("_c.window").alias("_window"),
        )
    )


def match_count(rules) -> Column:
    """Number of matches in ``_lines`` of a file in ``language``, without making rows of them."""
    worth = _worth_matching(rules, "language", "r.text", "r.low")
    per_rule = " + ".join(
        f"""CASE WHEN {_speaks("language", langs)} AND ({_may_match(rule, "r.low")} OR {_folds("r.text")})
            THEN size(regexp_extract_all(r.text, {_text(rule.java_pattern)}, 0)) ELSE 0 END"""
        for rule, langs in rules
    )
    return F.expr(f"""aggregate(
        filter(transform(_lines, line -> struct(line AS text, lower(line) AS low)), r -> {worth}),
        0L, (n, r) -> n + {per_rule})""")


def file_counts(
    files: DataFrame, options: ScanOptions = ScanOptions(), families: tuple = BUILTIN_FAMILIES,
    keys=("file_path",),
) -> DataFrame:
    """Lines and findings of every file, in one pass over the text."""
    rules = active_rules(families, options.languages, options.confidence_threshold)
    if not all(rule.native for rule, _ in rules):
        raise ValueError("some rule needs a Python scan: count the rows of detect() instead")
    split = files.select(*keys, "language", txt.lines("content").alias("_lines"))
    found = match_count(rules) if rules else F.lit(0).cast("long")
    return split.select(
        *keys, "language", F.size("_lines").cast("long").alias("lines"), found.alias("findings")
    )


def _native_matches(files: DataFrame, rules, keys, radius: int) -> DataFrame:
    lines = candidate_lines(files, rules, keys, radius)
    found = ",\n".join(
        f"""struct({_text(rule.rule_id)} AS rule_id, CASE
            WHEN {_speaks("language", langs)} AND ({_may_match(rule, "_low")} OR {_folds("_text")})
            THEN regexp_extract_all(_text, {_text(rule.java_pattern)}, 0) END AS found)"""
        for rule, langs in rules
    )
    place = [*keys, "language", "line_number", "_window"]
    hits = (
        lines.select(
            *place, "_text",
            F.expr(f"explode_outer(filter(array({found}), h -> size(h.found) > 0))").alias("_h"),
        )
        .where("_h IS NOT NULL")
        .select(*place, "_text", F.col("_h.rule_id").alias("rule_id"), F.col("_h.found").alias("_found"))
    )
    # Text between matches: a literal pattern per rule, so each is compiled once per task.
    arms = "\n".join(
        f"WHEN {_text(rule.rule_id)} THEN split(_text, {_text(rule.java_pattern)}, -1)"
        for rule, _ in rules
    )
    steps = hits.select(
        *place, "rule_id",
        F.expr(f"""zip_with(slice(CASE rule_id {arms} END, 1, size(_found)), _found,
            (gap, hit) -> struct(length(gap) AS gap, hit AS hit))""").alias("_steps"),
    )
    # Offsets add up what lies before a match: whole blocks first, then within the block.
    advance = "aggregate({}, 0, (sum, s) -> sum + s.gap + length(s.hit))"
    before = advance.format(f"slice(_steps, 1, b * {BLOCK})")
    blocks = f"""explode_outer(transform(
        sequence(0, CAST(floor((size(_steps) - 1) / {BLOCK}) AS int)),
        b -> struct({before} AS base, slice(_steps, b * {BLOCK} + 1, {BLOCK}) AS part)))"""
    inside = advance.format("slice(_b.part, 1, i)")
    placed = f"""explode_outer(transform(_b.part,
        (s, i) -> struct(_b.base + {inside} + s.gap + 1 AS at, s.hit AS hit)))"""
    return (
        steps.select(*place, "rule_id", F.expr(blocks).alias("_b"))
        .select(*place, "rule_id", F.expr(placed).alias("_m"))
        .select(
            *keys, "language", F.col("line_number").cast("long").alias("line_number"), "_window",
            "rule_id",
            F.col("_m.at").cast("long").alias("column_number"),
            (F.col("_m.at") + F.length("_m.hit")).cast("long").alias("end_column_number"),
            F.col("_m.hit").alias("regex_match"),
        )
    )


def _python_matches(files: DataFrame, rules, keys, radius: int) -> DataFrame:
    """Rules only a Python scan reproduces (empty matches, Python-only syntax), and large catalogues, Arrow-batched.

    A line is run through one automaton of literals taken from all patterns, and only rules of which it
    holds a literal are tried on it.
    """
    specs = [(rule.rule_id, rule.pattern, langs) for rule, langs in rules]
    fields = [files.schema[key] for key in keys]
    schema = T.StructType(
        fields
        + [
            T.StructField("language", T.StringType()),
            T.StructField("line_number", T.LongType()),
            T.StructField("_window", T.ArrayType(T.StringType())),
            T.StructField("rule_id", T.StringType()),
            T.StructField("column_number", T.LongType()),
            T.StructField("end_column_number", T.LongType()),
            T.StructField("regex_match", T.StringType()),
        ]
    )
    names = [field.name for field in schema]
    key_names = list(keys)

    folding = txt.FOLDING_LETTERS

    def scan(batches):
        import pandas as pd

        chooser = RuleChooser(specs, folding)
        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                lines = record["content"].split("\n")
                for n, line in enumerate(lines, 1):
                    for rule_id, match in chooser.matches(line, record["language"]):
                        window = lines[max(0, n - radius - 1) : n + radius]
                        rows.append(
                            [record[key] for key in key_names]
                            + [record["language"], n, window, rule_id]
                            + [match.start() + 1, match.end() + 1, match.group(0)]
                        )
            yield pd.DataFrame(rows, columns=names)

    wanted = {lang for _, langs in rules for lang in langs}
    return (
        files.where(F.col("language").isin(*wanted))
        .select(*keys, "language", "content")
        .mapInPandas(scan, schema)
    )


def match_rules(
    files: DataFrame,
    options: ScanOptions = ScanOptions(),
    families: tuple = BUILTIN_FAMILIES,
    keys=("file_path",),
    radius: int = SNIPPET_RADIUS,
    most_expressions: int = MOST_EXPRESSIONS,
) -> DataFrame:
    """All non-overlapping matches of each applicable rule on each line, with 1-based columns
    (the end column is exclusive) and the surrounding lines in ``_window``.

    ``files`` needs ``content``, ``language`` and the ``keys`` to carry along. Up to ``most_expressions`` rules are expressions
    of the plan; larger catalogues go through an automaton in Python.
    """
    rules = active_rules(families, options.languages, options.confidence_threshold)
    # A plan with an expression per rule is for catalogues that one plan can hold.
    native = [pair for pair in rules if pair[0].native] if len(rules) <= most_expressions else []
    other = [pair for pair in rules if pair not in native] if native else list(rules)
    if not rules:
        return _python_matches(files.where(F.lit(False)), rules or [_NOTHING], keys, radius)
    parts = []
    if native:
        parts.append(_native_matches(files, native, list(keys), radius))
    if other:
        parts.append(_python_matches(files, other, list(keys), radius))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


_NOTHING = (Rule("none", "", "$^", "LOW", "LOW"), ("none",))


def finding_id(*parts) -> Column:
    """Same finding, same id: repeated or retried scans agree on it."""
    return F.sha2(F.concat_ws("|", *[F.col(part).cast("string") for part in parts]), 256)


def build_findings(
    matches: DataFrame,
    families: tuple = BUILTIN_FAMILIES,
    keys=("file_path",),
    radius: int = SNIPPET_RADIUS,
    prompt_radius: int | None = None,
) -> DataFrame:
    """Rule attributes, location, snippet and metadata for every match.

    With ``prompt_radius``, the radius that the matches were cut with, there is a wider ``prompt_snippet`` too.
    """
    spark = matches.sparkSession
    # The catalogue is a fixed list of rules held by the driver: always small.
    rules = F.broadcast(
        rule_catalog(spark, families).select(
            "rule_id", "title", "description", "severity", "confidence", "cwe_id",
            "owasp_category", "remediation", "references",
        )
    )
    extra = [key for key in keys if key != "file_path"]
    number, window = F.col("line_number").cast("int"), F.col("_window")
    wider = []
    if prompt_radius is not None:
        wider = [txt.snippet("_window", number, prompt_radius).alias("prompt_snippet")]
        # The narrow window is a part of the wide one; both begin at line 1 at the earliest.
        skip = F.least(number - 1, F.lit(prompt_radius)) - F.least(number - 1, F.lit(radius))
        window = F.slice("_window", skip + 1, F.least(number - 1, F.lit(radius)) + radius + 1)
    return matches.join(rules, "rule_id").select(
        *extra,
        finding_id(*extra, "file_path", "rule_id", "line_number", "column_number",
                   "end_column_number").alias("id"),
        F.col("rule_id").alias("vulnerability_type"),
        "title", "description", "severity", "confidence", "file_path", "line_number",
        "column_number",
        F.lit(None).cast("long").alias("end_line_number"),
        "end_column_number",
        txt.snippet(window, number, radius).alias("code_snippet"),
        "cwe_id", "owasp_category", "remediation", "references",
        F.create_map(F.lit("regex_match"), F.col("regex_match")).alias("metadata"),
        F.lit(None).cast("string").alias("ai_explanation"),
        F.lit(None).cast("double").alias("false_positive_likelihood"),
        "language", *wider,
    )


def detect(
    files: DataFrame,
    options: ScanOptions = ScanOptions(),
    families: tuple = BUILTIN_FAMILIES,
    keys=("file_path",),
    prompt_radius: int | None = None,
) -> DataFrame:
    """Findings of files whose ``language`` is known.

    With ``prompt_radius`` each finding also carries that many lines around it as ``prompt_snippet``, cut in the same
    pass, so that a review needs no second look at the files.
    """
    widest = max(SNIPPET_RADIUS, prompt_radius or 0)
    found = match_rules(files, options, families, keys, widest)
    return build_findings(found, families, keys, prompt_radius=None if prompt_radius is None else widest)


def scan_code(
    snippets: DataFrame,
    language: str,
    options: ScanOptions = ScanOptions(),
    families: tuple = BUILTIN_FAMILIES,
    keys=("file_path",),
) -> DataFrame:
    """Findings in a column of code strings, all of one language; the text is taken as it is."""
    if language not in options.languages:
        raise ValueError(f"Language {language} not supported")
    if "file_path" not in snippets.columns:
        snippets = snippets.withColumn("file_path", F.lit("inline"))
    return detect(snippets.withColumn("language", F.lit(language)), options, families, keys)


def detect_custom(files: DataFrame, check, keys=("file_path",), languages=()) -> DataFrame:
    """Run a user's own detector next to the rules.

    ``check(code, file_path, language)`` returns dicts with finding fields. An error in one file
    drops that file's custom findings only. The result unions with :func:`detect` by name.
    """
    extra = [T.StructField(k, files.schema[k].dataType) for k in keys if k != "file_path"]
    shape = T.StructType(
        [*extra, *FINDINGS.fields, T.StructField("language", T.StringType())]
    )
    names, key_names = shape.names, list(keys)

    def run(batches):
        import hashlib

        import pandas as pd

        for batch in batches:
            rows = []
            for record in batch.to_dict("records"):
                try:
                    found = list(
                        check(record["content"], record["file_path"], record["language"])
                    )
                except Exception:
                    found = []
                for finding in found:
                    row = {**{key: record[key] for key in key_names}, **finding}
                    row["language"] = record["language"]
                    place = [row.get(key) for key in key_names]
                    place += [row.get("vulnerability_type"), row.get("line_number")]
                    place += [row.get("column_number"), row.get("end_column_number")]
                    joined = "|".join(str(part) for part in place if part is not None)
                    row.setdefault("id", hashlib.sha256(joined.encode()).hexdigest())
                    rows.append([row.get(name) for name in names])
            frame = pd.DataFrame(rows, columns=names)
            for name in ("line_number", "column_number", "end_line_number", "end_column_number"):
                frame[name] = frame[name].astype("Int64")
            yield frame

    chosen = files.where(F.col("language").isin(*languages)) if languages else files
    columns = dict.fromkeys([*keys, "file_path", "language", "content"])
    return chosen.select(*columns).mapInPandas(run, shape)
