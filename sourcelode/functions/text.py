"""Expressions over source text."""

from pyspark.sql import Column, functions as F

from sourcelode.functions.lookups import REDACTION_MARK, REDACTION_PATTERNS

# White space as Python's str.strip sees it: the Unicode property plus four control characters.
SPACE = r"\s\x1c-\x1f"
NONBLANK = rf"(?U)[^{SPACE}]"
# Letters that fold to plain s, k or i when case is ignored; lower() does not fold them all.
FOLDING_LETTERS = ("ſ", "K", "İ", "ı")


def as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text) -> Column:
    return F.regexp_replace(as_column(text), rf"(?U)\A[{SPACE}]+|[{SPACE}]+\z", "")


def lines(text) -> Column:
    """Lines split at ``\\n`` only; a trailing newline gives a last empty line, '' gives one."""
    return F.split(as_column(text), "\n", -1)


def universal_newlines(text) -> Column:
    return F.regexp_replace(as_column(text), "\r\n?", "\n")


def nonblank(all_lines) -> Column:
    return F.filter(as_column(all_lines), lambda line: line.rlike(NONBLANK))


def is_text(content) -> Column:
    """Judge the first 8192 bytes: empty is text, a NUL is binary, and at least three quarters
    must be printable ASCII, tab or line breaks."""
    head = F.decode(F.substring(as_column(content), 1, 8192), "ISO-8859-1")
    printable = F.length(F.regexp_replace(head, r"[^\x20-\x7e\t\n\r]", ""))
    return (
        F.when(F.length(head) == 0, True)
        .when(F.instr(head, "\0") > 0, False)
        .otherwise(printable / F.length(head) >= 0.75)
    )


def code_hash(text) -> Column:
    return F.sha2(as_column(text).cast("binary"), 256)


def truncate(text, limit: int) -> Column:
    column = as_column(text)
    return F.when(
        F.length(column) > limit, F.concat(F.substring(column, 1, limit), F.lit("..."))
    ).otherwise(column)


def folds(text) -> Column:
    """Whether the text holds a letter that turns into a plain s, k or i when case is ignored."""
    column = as_column(text)
    result = F.lit(False)
    for letter in FOLDING_LETTERS:
        result = result | column.contains(letter)
    return result


def redact(text) -> Column:
    """Mask e-mail addresses, IP addresses and key-like strings, one pattern after another.

    The patterns spell out both cases of every letter class; folding case on top changes a result
    only for texts with a folding letter, and only those pay for it.
    """
    column = as_column(text)
    mail, *rest = REDACTION_PATTERNS

    def masked(flags: str) -> Column:
        # An address needs an @, which most texts do not have.
        result = F.when(
            column.contains("@"), F.regexp_replace(column, flags + mail, REDACTION_MARK)
        ).otherwise(column)
        for pattern in rest:
            plain = flags if "sk-" not in pattern and "ghp_" not in pattern else "(?iuU)"
            result = F.regexp_replace(result, plain + pattern, REDACTION_MARK)
        return result

    return F.when(folds(column), masked("(?iuU)")).otherwise(masked("(?U)"))


def context_window(all_lines, line_number, radius: int) -> Column:
    """The lines within ``radius`` of a 1-based line number."""
    first = F.greatest(line_number - radius, F.lit(1))
    return F.slice(as_column(all_lines), first, line_number + radius - first + 1)


def snippet(window, line_number, radius: int) -> Column:
    """Numbered text of a :func:`context_window`; ``>>> `` marks the line itself."""
    first = F.greatest(line_number - radius, F.lit(1))
    numbered = F.transform(
        as_column(window),
        lambda text, i: F.format_string(
            "%s%4d: %s",
            F.when(first + i == line_number, ">>> ").otherwise("    "),
            first + i,
            text,
        ),
    )
    return F.array_join(numbered, "\n")


def clean_snippet(text) -> Column:
    """Drop the number prefix again: each line keeps what follows its first colon."""
    return F.array_join(
        F.transform(
            lines(text),
            lambda line: F.when(
                F.instr(line, ":") > 0, F.substring(line, F.instr(line, ":") + 1, F.length(line))
            ).otherwise(line),
        ),
        "\n",
    )


def preprocess_code(text, language) -> Column:
    """Stripped, non-empty lines without whole-line comments, joined again."""
    lang = as_column(language)
    return F.array_join(
        F.filter(
            F.transform(lines(text), strip),
            lambda line: (line != "")
            & ~F.coalesce((lang == "python") & line.startswith("#"), F.lit(False))
            & ~F.coalesce((lang == "javascript") & line.startswith("//"), F.lit(False)),
        ),
        "\n",
    )
