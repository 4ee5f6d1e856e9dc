"""Expressions over file paths: names, globs, languages, MIME types, safety checks."""

import re

from pyspark.sql import Column, functions as F

from sourcelode.functions.lookups import (
    DEFAULT_MIME_TYPE,
    FINDING_LANGUAGES,
    LANGUAGE_ALIASES,
    LANGUAGE_EXTENSIONS,
    LANGUAGE_FILENAMES,
    MIME_TYPES,
    SHEBANG_INTERPRETERS,
)
from sourcelode.functions.text import strip


def as_column(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def lookup(key: Column, mapping: dict) -> Column:
    """Value of a fixed literal map, NULL for an unknown key; the key is evaluated once.

    Keys and text values are plain words: they need no escaping.
    """
    # One parsed text instead of a Column object per entry.
    entries = ", ".join(f"{_literal(k)}, {_literal(v)}" for k, v in mapping.items())
    return F.try_element_at(F.expr(f"map({entries})"), key)


def _literal(value) -> str:
    if isinstance(value, str):
        return f"'{value}'"
    return f"{value!r}D" if isinstance(value, float) else repr(value)


def by_key(groups: dict, aliases: dict = LANGUAGE_ALIASES) -> dict:
    """``{language: [keys]}`` -> ``{key: language}`` with aliases resolved."""
    return {
        key: aliases.get(language, language) for language, keys in groups.items() for key in keys
    }


def base_name(path) -> Column:
    return F.substring_index(as_column(path), "/", -1)


def suffix(path) -> Column:
    """Text from the last dot of the name; empty if that dot starts or ends the name."""
    return F.regexp_extract(base_name(path), r"(?s)^.+(\.[^.]+)$", 1)


def last_dot_part(path) -> Column:
    """Lower-case text after the last dot of the whole path (the path itself without a dot)."""
    return F.lower(F.substring_index(as_column(path), ".", -1))


def glob_regex(glob: str) -> str:
    """Shell glob -> Java regex over the whole path; ``*`` crosses ``/``, case is ignored."""
    out, at = [], 0
    while at < len(glob):
        char = glob[at]
        at += 1
        if char == "*":
            out.append(".*")
        elif char == "?":
            out.append(".")
        elif char == "[" and "]" in glob[at + 1 :]:
            end = glob.index("]", at + 1)
            body = re.sub(r"([\\\[\]&~^|])", r"\\\1", glob[at:end].removeprefix("!"))
            out.append(("[^" if glob[at] == "!" else "[") + body + "]")
            at = end + 1
        else:
            out.append(re.escape(char))
    return r"(?ius)\A" + "".join(out) + r"\z"


def matches_any(path, globs) -> Column:
    """Whether the whole path fits any of the globs; false for an empty list."""
    column = as_column(path)
    result = F.lit(False)
    for glob in globs:
        result = result | column.rlike(glob_regex(glob))
    return result


def excluded(path, globs) -> Column:
    return matches_any(path, globs)


def included(path, globs) -> Column:
    """An empty include list keeps every path."""
    return matches_any(path, globs) if globs else F.lit(True)


def below_pruned_dir(path, root, globs) -> Column:
    """Whether some directory between ``root`` and the file is hidden or fits an exclude glob.

    ``root`` itself is never tested.
    """
    column, top = as_column(path), F.rtrim(as_column(root), F.lit("/"))
    parts = F.split(F.substring(column, F.length(top) + 2, F.length(column)), "/")
    dirs = F.slice(parts, 1, F.size(parts) - 1)
    hidden = F.exists(dirs, lambda part: part.startswith("."))
    if not globs:
        return hidden
    # "a/b/c" -> every prefix "root/a", "root/a/b", ...
    prefixes = F.transform(
        dirs, lambda _, i: F.concat_ws("/", top, F.array_join(F.slice(dirs, 1, i + 1), "/"))
    )
    return hidden | F.exists(prefixes, lambda prefix: matches_any(prefix, globs))


def resolve_alias(language) -> Column:
    column = as_column(language)
    return F.coalesce(lookup(column, LANGUAGE_ALIASES), column)


def shebang_language(content) -> Column:
    """Language named by a ``#!`` first line; the first known interpreter in the list wins."""
    first = strip(F.substring_index(as_column(content), "\n", 1))
    known = ", ".join(f"'{text}'" for text, _ in SHEBANG_INTERPRETERS)
    named = F.filter(
        F.expr(f"array({known})"),
        lambda text: first.startswith("#!") & F.contains(first, text),
    )
    return lookup(F.get(named, 0), dict(SHEBANG_INTERPRETERS))


def path_language(path) -> Column:
    """Language by file name, then extension; aliases resolved, NULL if neither is known."""
    return F.coalesce(
        lookup(F.lower(base_name(path)), by_key(LANGUAGE_FILENAMES)),
        lookup(F.lower(suffix(path)), by_key(LANGUAGE_EXTENSIONS)),
    )


def detect_language(path, content) -> Column:
    """File name, then extension, then (without an extension) the shebang line."""
    by_shebang = F.when(suffix(path) == "", shebang_language(content))
    return F.coalesce(path_language(path), by_shebang)


def finding_language(path) -> Column:
    """Language of a stored finding; this map keeps TypeScript apart from JavaScript."""
    return lookup(last_dot_part(path), FINDING_LANGUAGES)


def mime_type(path) -> Column:
    column = as_column(path)
    found = lookup(last_dot_part(column), MIME_TYPES)
    return F.when(column.contains("."), F.coalesce(found, F.lit(DEFAULT_MIME_TYPE))).otherwise(
        DEFAULT_MIME_TYPE
    )


def sanitize_path(path) -> Column:
    """Path with forward slashes, or NULL if any part could leave the tree or hides a file.

    Every part must be non-empty and must not start with a dot, except ``.git``/``.github``;
    that also rules out ``../``, ``/..`` and a leading ``./``.
    """
    slashed = F.replace(as_column(path), F.lit("\\"), F.lit("/"))
    bad = F.exists(
        F.split(slashed, "/"),
        lambda part: (part == "")
        | (part.startswith(".") & ~part.isin(".git", ".github")),
    )
    return F.when(~bad, slashed)


def supported_languages() -> list:
    """Every language a path can be recognised as, sorted (aliases not resolved)."""
    return sorted({*LANGUAGE_EXTENSIONS, *LANGUAGE_FILENAMES})


def extensions_for(language: str) -> list:
    """Extensions analysed as ``language`` or its alias target."""
    wanted = LANGUAGE_ALIASES.get(language, language)
    return [ext for ext, found in by_key(LANGUAGE_EXTENSIONS).items() if found == wanted]


def is_supported_language(language: str) -> bool:
    return language in supported_languages()
