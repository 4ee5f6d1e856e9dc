"""SQL (DuckDB) building blocks shared by several oracles."""

from sourcelode.functions.lookups import (
    LANGUAGE_ALIASES,
    LANGUAGE_EXTENSIONS,
    LANGUAGE_FILENAMES,
    MIME_TYPES,
)
from sourcelode.functions.rules import BUILTIN_FAMILIES, active_rules
from workload.registry import literal, sql_case

# White space as Python's str.strip sees it.
WS = r"[\s\x0b\x1c-\x1f\x85\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def strip(expression: str) -> str:
    return f"regexp_replace({expression}, '^{WS}+|{WS}+$', '', 'g')"


def _flat(groups: dict) -> dict:
    return {k: LANGUAGE_ALIASES.get(v, v) for v, keys in groups.items() for k in keys}


NAME = "split_part(file_path, '/', -1)"
SUFFIX = f"regexp_extract({NAME}, '(?s)^.+(\\.[^.]+)$', 1)"
FIRST_LINE = strip("split_part(content, chr(10), 1)")
SHEBANG = f"""CASE WHEN NOT starts_with({FIRST_LINE}, '#!') THEN NULL
 WHEN contains({FIRST_LINE}, 'python') THEN 'python' WHEN contains({FIRST_LINE}, 'node') THEN 'javascript'
 WHEN contains({FIRST_LINE}, 'sh') THEN 'shell' WHEN contains({FIRST_LINE}, 'ruby') THEN 'ruby'
 WHEN contains({FIRST_LINE}, 'perl') THEN 'perl' WHEN contains({FIRST_LINE}, 'php') THEN 'php' END"""
LANGUAGE = f"""coalesce({sql_case(f"lower({NAME})", _flat(LANGUAGE_FILENAMES))},
 {sql_case(f"lower({SUFFIX})", _flat(LANGUAGE_EXTENSIONS))},
 CASE WHEN {SUFFIX} = '' THEN {SHEBANG} END)"""


def mime(path: str) -> str:
    found = sql_case(f"lower(split_part({path}, '.', -1))", MIME_TYPES)
    return f"CASE WHEN contains({path}, '.') THEN coalesce({found}, 'text/plain') ELSE 'text/plain' END"


ALL_FILES = f"all_files AS (SELECT *, {LANGUAGE} AS language FROM src_files)"
FILES = f"{ALL_FILES},\nfiles AS (SELECT * FROM all_files WHERE language IN ('python', 'javascript'))"


def rule_values(families=BUILTIN_FAMILIES, languages=("python", "javascript"), threshold=0.5) -> str:
    rows = []
    for rule, langs in active_rules(families, languages, threshold):
        texts = (
            rule.rule_id, rule.title, rule.severity, rule.confidence, rule.cwe_id,
            rule.owasp_category, rule.description, rule.remediation, "(?i)" + rule.pattern,
        )
        langs_sql = "[" + ", ".join(literal(lang) for lang in langs) + "]"
        rows.append("(" + ", ".join(literal(text) for text in texts) + f", {langs_sql})")
    return (
        "rules(rule_id, title, severity, confidence, cwe_id, owasp_category, description, "
        "remediation, pattern, langs) AS (VALUES " + ",\n ".join(rows) + ")"
    )


def findings(source: str = FILES, rules: str | None = None, radius: int = 3) -> str:
    """``finds``: one row per match with position, snippet and rule attributes."""
    return f"""{source},
{rules or rule_values()},
src_lines AS (SELECT file_id, repo, file_path, language, string_split(content, chr(10)) AS lines FROM files),
one_line AS (SELECT file_id, repo, file_path, language, lines, unnest(lines) AS line,
  generate_subscripts(lines, 1) AS line_number FROM src_lines),
hits AS (SELECT l.*, r.*, regexp_extract_all(l.line, r.pattern, 0) AS m,
  string_split_regex(l.line, r.pattern) AS g
 FROM one_line l JOIN rules r ON list_contains(r.langs, l.language) WHERE regexp_matches(l.line, r.pattern)),
placed AS (SELECT *, unnest(m) AS regex_match, generate_subscripts(m, 1) AS k FROM hits),
spots AS (SELECT *, CAST(1 + list_sum(list_transform(g[1:k], lambda x: length(x)))
   + coalesce(list_sum(list_transform(m[1:k-1], lambda x: length(x))), 0) AS BIGINT) AS column_number FROM placed),
finds AS (SELECT *, rule_id AS vulnerability_type, column_number + length(regex_match) AS end_column_number,
  array_to_string(list_transform(range(greatest(line_number - {radius}, 1), least(line_number + {radius}, len(lines)) + 1),
   lambda k2: (CASE WHEN k2 = line_number THEN '>>> ' ELSE '    ' END) || format('{{:4d}}', k2) || ': ' || lines[k2]), chr(10)) AS code_snippet
 FROM spots)"""
