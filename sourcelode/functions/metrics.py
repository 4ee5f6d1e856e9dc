"""Code metrics per file as column expressions: no shuffle, no Python on the executors."""

from pyspark.sql import Column, DataFrame, functions as F

from sourcelode.functions.lookups import (
    COMPLEXITY_WORDS,
    DEFAULT_INDICATOR_WEIGHT,
    ERROR_WORDS,
    HIGH_RISK_INDICATORS,
    INDICATOR_WEIGHTS,
    INDICATORS,
    MAINTAINABLE_WORDS,
    MEDIUM_RISK_INDICATORS,
    NAMING_WORDS,
    RISK_WORDS,
)
from sourcelode.functions.text import as_column, lines, nonblank, strip


def _flag(test: Column) -> Column:
    return test.cast("int")


def _has_any(text: Column, words) -> Column:
    result = F.lit(False)
    for word in words:
        result = result | text.contains(word)
    return result


def _count_where(array, test) -> Column:
    return F.size(F.filter(as_column(array), test))


def occurrences(text, token: str) -> Column:
    """Non-overlapping occurrences of ``token``."""
    column = as_column(text)
    without = F.replace(column, F.lit(token), F.lit(""))
    return ((F.length(column) - F.length(without)) / len(token)).cast("long")


def with_lines(files: DataFrame) -> DataFrame:
    """Add the working columns ``_lines`` and ``_code`` (non-blank lines) used below."""
    return files.withColumn("_lines", lines("content")).withColumn("_code", nonblank("_lines"))


def _share(count: Column, if_empty: float) -> Column:
    total = F.size("_code")
    return F.when(total == 0, F.lit(if_empty)).otherwise(count / total)


def complexity() -> Column:
    """Control and definition words per non-blank line (a word counts inside longer words)."""
    words = F.aggregate(
        F.transform("_code", F.lower),
        F.lit(0).cast("long"),
        lambda total, line: total + sum((_flag(line.contains(w)) for w in COMPLEXITY_WORDS), F.lit(0)),
    )
    return F.least(_share(words, 0.0), F.lit(1.0))


def risk_score(content="content") -> Column:
    """Risk words in the lower-cased code, ten make 1. Words with capitals can never occur."""
    lowered = F.lower(as_column(content))
    found = F.filter(F.array(*[F.lit(w) for w in RISK_WORDS]), lambda w: F.contains(lowered, w))
    return F.least(F.size(found) / 10.0, F.lit(1.0))


def maintainability() -> Column:
    return _share(_count_where("_code", lambda line: _has_any(line, MAINTAINABLE_WORDS)), 1.0)


def code_quality() -> Column:
    """Documentation, structure and error handling raise it, lines over 120 characters lower it."""
    total = F.size("_code")

    def ratio(array, test) -> Column:
        return _count_where(array, test) / total

    documented = ratio(
        "_lines",
        lambda line: line.contains('"""') | line.contains("'''") | strip(line).startswith("#"),
    )
    named = ratio("_code", lambda line: _has_any(F.lower(line), NAMING_WORDS))
    guarded = ratio("_code", lambda line: _has_any(F.lower(line), ERROR_WORDS))
    long_lines = ratio("_code", lambda line: F.length(line) > 120)
    score = (
        F.least(documented * 2, F.lit(0.3))
        + F.least(named * 3, F.lit(0.2))
        + F.least(guarded * 5, F.lit(0.2))
        - long_lines * 0.2
        + 0.3
    )
    return F.when(total == 0, F.lit(1.0)).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    )


def line_stats() -> dict:
    """Line counts and ratios; only ``#`` starts a comment."""
    total, code = F.size("_lines"), F.size("_code")
    comments = _count_where("_lines", lambda line: strip(line).startswith("#"))
    return {
        "total_lines": total.cast("long"),
        "code_lines": code.cast("long"),
        "comment_lines": comments.cast("long"),
        "blank_lines": (total - code).cast("long"),
        "comment_ratio": comments / total,
        "code_density": code / total,
    }


def indentation_levels() -> Column:
    """Indentation level (leading white space // 4) of every non-blank line."""
    return F.transform(
        "_code",
        lambda line: F.floor(
            F.length(F.regexp_extract(line, r"(?U)\A([\s\x1c-\x1f]*)", 1)) / 4
        ).cast("long"),
    )


def indentation_histogram() -> Column:
    """Level -> number of lines, within the row."""
    levels = indentation_levels()
    return F.map_from_entries(
        F.transform(
            F.array_sort(F.array_distinct(levels)),
            lambda level: F.struct(
                level, _count_where(levels, lambda other: other == level).cast("long")
            ),
        )
    )


def _by_language(language, branches, default=0) -> Column:
    """``branches``: (languages, expression) pairs."""
    column, chain = as_column(language), None
    for names, value in branches:
        test = column.isin(*names)
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    return chain.otherwise(F.lit(default).cast("long"))


_SCRIPT = ("javascript", "typescript")


def function_count(language="language") -> Column:
    java = _count_where(
        "_lines",
        lambda line: line.contains("public") & line.contains("(") & line.contains("{"),
    ).cast("long")
    return _by_language(
        language,
        [
            (("python",), occurrences("content", "def ")),
            (_SCRIPT, occurrences("content", "function ") + occurrences("content", "=> ")),
            (("java",), java),
        ],
    )


def class_count(language="language") -> Column:
    return _by_language(
        language, [(("python", "java") + _SCRIPT, occurrences("content", "class "))]
    )


def import_count(language="language") -> Column:
    plain = occurrences("content", "import ")
    return _by_language(
        language,
        [
            (("python",), plain + occurrences("content", "from ")),
            (_SCRIPT, plain + occurrences("content", "require(")),
            (("java",), plain),
        ],
    )


def control_counts(language="language") -> Column:
    """Counts of control structures; the last two exist for Python only (NULL otherwise)."""
    is_python = as_column(language) == "python"
    return F.struct(
        occurrences("content", "if ").alias("if_statements"),
        occurrences("content", "for ").alias("for_loops"),
        occurrences("content", "while ").alias("while_loops"),
        occurrences("content", "try").alias("try_blocks"),
        F.when(is_python, occurrences("content", "with ")).alias("with_statements"),
        F.when(is_python, occurrences("content", "async def")).alias("async_functions"),
    )


def detected_indicators(language="language", content="content") -> Column:
    """Security words of the language (Python's for unknown languages) found in the code."""
    lists = {name: F.array(*[F.lit(w) for w in words]) for name, words in INDICATORS.items()}
    column = as_column(language)
    words = (
        F.when(column == "javascript", lists["javascript"])
        .when(column == "java", lists["java"])
        .otherwise(lists["python"])
    )
    lowered = F.lower(as_column(content))
    return F.filter(words, lambda word: F.contains(lowered, F.lower(word)))


def indicator_risk(found) -> Column:
    """Summed weights of the found words, at most 1."""
    heavy = {}
    for word, weight in INDICATOR_WEIGHTS.items():
        heavy.setdefault(weight, []).append(word)

    def weight_of(word: Column) -> Column:
        chain = None
        for weight, words in heavy.items():
            test = word.isin(*words)
            chain = F.when(test, weight) if chain is None else chain.when(test, weight)
        return chain.otherwise(DEFAULT_INDICATOR_WEIGHT)

    total = F.aggregate(as_column(found), F.lit(0.0), lambda acc, word: acc + weight_of(word))
    return F.least(total, F.lit(1.0))


def high_risk(found) -> Column:
    return F.filter(as_column(found), lambda word: word.isin(*HIGH_RISK_INDICATORS))


def medium_risk(found) -> Column:
    return F.filter(as_column(found), lambda word: word.isin(*MEDIUM_RISK_INDICATORS))


def overall_risk(
    complexity_score, maintainability_score, quality_score, semantic_complexity, entropy,
    pattern_risk, embedding_risk,
) -> Column:
    """Security counts half, structure 30 %, embedding shape 20 %."""
    structure = (
        as_column(complexity_score) * 0.3
        + (1 - as_column(maintainability_score)) * 0.2
        + (1 - as_column(quality_score)) * 0.2
    )
    semantic = as_column(semantic_complexity) * 0.4 + F.least(as_column(entropy), F.lit(0.5)) * 0.3
    security = as_column(pattern_risk) * 0.8 + as_column(embedding_risk) * 0.2
    total = security * 0.5 + structure * 0.3 + semantic * 0.2
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))
