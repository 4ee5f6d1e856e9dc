"""The rule catalogue: which regex marks a weakness in which language."""

import re
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema

from sourcelode.functions.lookups import CONFIDENCE_SCORE, DEFAULT_CONFIDENCE_SCORE
from sourcelode.schemas import RULES

# Java flags that make a pattern behave like a case-insensitive one applied to a single line:
# i ignore case, u Unicode case folding, m multi-line, d only \n ends a line, U Unicode classes.
JAVA_FLAGS = "(?iumdU)"


# Escapes that both regex languages read alike; escaped punctuation is too.
_ALIKE = frozenset((r"\s", r"\d", r"\D", r"\t", r"\n", r"\r", r"\f"))
# Groups other than plain ones, braces that are no counted repeat, and doubled quantifiers.
_FOREIGN = re.compile(r"\(\?(?!:)|(?<!\\)(?:\\\\)*\{(?!\d+(?:,\d*)?\})|[*+?}]\+")


@dataclass(frozen=True)
class Rule:
    """One regex rule. ``needles`` speeds up matching: a line can only match if, in lower case,
    it contains at least one text of every group. Leave it empty when unsure."""

    rule_id: str
    title: str
    pattern: str
    severity: str
    confidence: str
    cwe_id: str | None = None
    owasp_category: str | None = None
    description: str = ""
    remediation: str | None = None
    references: tuple = ()
    languages: tuple = ()
    metadata: dict = field(default_factory=dict, hash=False)
    enabled: bool = True
    needles: tuple = ()

    @property
    def score(self) -> float:
        return CONFIDENCE_SCORE.get(self.confidence, DEFAULT_CONFIDENCE_SCORE)

    @property
    def java_pattern(self) -> str:
        return JAVA_FLAGS + _wide_space(self.pattern)

    @property
    def native(self) -> bool:
        """Whether Spark's own regex functions give the same matches as a Python scan.

        Only patterns made of parts that both languages read alike are: ASCII literals, ``.``, groups, alternatives,
        anchors, plain bracket classes, counted repeats and the escapes in ``_ALIKE``. Word boundaries and word classes treat
        combining marks differently, ``{,n}`` and brackets inside brackets have other meanings.
        """
        if not self.pattern.isascii() or _FOREIGN.search(self.pattern):
            return False
        tokens = list(_tokens(self.pattern))
        for token, inside in tokens:
            if len(token) > 1 and token not in _ALIKE and (token[1].isalnum() or token[1].isspace()):
                return False
            # U+001C to U+001F are space in Python only, which can be mended for a plain \s alone.
            if inside and token in (r"\s", "[", "&"):
                return False
        # Empty matches are cut differently. Without its anchors a pattern matches "" if and
        # only if it can match an empty piece of some line.
        bare = "".join(token for token, inside in tokens if inside or token not in ("^", "$"))
        return re.compile(bare, re.IGNORECASE).search("") is None

    def applies_to(self, language: str) -> bool:
        return not self.languages or language in self.languages


def _tokens(pattern: str):
    """Characters and escapes of a pattern, each with whether it stands in brackets."""
    inside = False
    for token in re.findall(r"\\.|.", pattern, re.DOTALL):
        if token == "[" and not inside:
            yield token, False
            inside = True
        else:
            inside = inside and token != "]"
            yield token, inside


def _wide_space(pattern: str) -> str:
    r"""``\s`` outside brackets also has to match U+001C to U+001F, as it does in Python."""
    return "".join(
        r"[\s\x1c-\x1f]" if token == r"\s" and not inside else token
        for token, inside in _tokens(pattern)
    )


@dataclass(frozen=True)
class Family:
    """Rules about one kind of weakness and the languages they are meant for."""

    name: str
    description: str
    severity: str
    cwe_id: str | None
    languages: tuple
    rules: tuple

    def supports(self, language: str) -> bool:
        return not self.languages or language in self.languages


_SQL_WORDS = ("select", "insert", "update", "delete", "drop", "create", "alter")
_QUOTES = ('"', "'")
_ASSIGN = ("=", ":")

# OWASP classes and reference addresses quoted in findings.
_A02 = "A02:2021 - Cryptographic Failures"
_A03 = "A03:2021 - Injection"
_A07 = "A07:2021 - Identification and Authentication Failures"
_A08 = "A08:2021 - Software and Data Integrity Failures"
_OWASP = {
    _A02: "https://owasp.org/Top10/A02_2021-Cryptographic_Failures/",
    _A03: "https://owasp.org/Top10/A03_2021-Injection/",
    _A07: "https://owasp.org/Top10/A07_2021-Identification_and_Authentication_Failures/",
    _A08: "https://owasp.org/Top10/A08_2021-Software_and_Data_Integrity_Failures/",
}
_CWE = "https://cwe.mitre.org/data/definitions/{}.html"


def _rule(rule_id, title, pattern, severity, confidence, cwe, owasp, about, advice, langs, needles):
    return Rule(
        rule_id, title, pattern, severity, confidence, cwe, owasp, about, advice,
        (_OWASP[owasp], _CWE.format(cwe.removeprefix("CWE-"))), langs, needles=needles,
    )


# Rule ids, titles, patterns, severities, classes and texts decide the findings.
# The last argument of each rule (needles) is our own speed-up.
BUILTIN_FAMILIES = (
    Family(
        "SQL Injection", "Detection of potential SQL injection vulnerabilities", "HIGH", "CWE-89",
        ("python", "javascript", "php", "java", "csharp"),
        (
            _rule(
                "sql_injection_python_format", "SQL Injection via String Formatting",
                r"(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\s+.*%\s*\(",
                "HIGH", "HIGH", "CWE-89", _A03,
                "SQL query constructed using string formatting, vulnerable to injection",
                "Use parameterized queries or prepared statements",
                ("python",), (_SQL_WORDS, ("%",), ("(",)),
            ),
            _rule(
                "sql_injection_python_fstring", "SQL Injection via F-String",
                r'f["\'].*?(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\s+.*?\{.*?\}',
                "HIGH", "HIGH", "CWE-89", _A03,
                "SQL query constructed using f-strings, vulnerable to injection",
                "Use parameterized queries or prepared statements",
                ("python",), (('f"', "f'"), ("{",), ("}",), _SQL_WORDS),
            ),
            _rule(
                "sql_injection_js_concatenation", "SQL Injection via String Concatenation",
                r'(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\s+.*?\+\s*["\']?[a-zA-Z_][a-zA-Z0-9_]*',
                "HIGH", "MEDIUM", "CWE-89", _A03,
                "SQL query constructed using string concatenation, vulnerable to injection",
                "Use parameterized queries or prepared statements",
                ("javascript",), (("+",), _SQL_WORDS),
            ),
            _rule(
                "sql_injection_js_template", "SQL Injection via Template Literals",
                r"`.*?(SELECT|INSERT|UPDATE|DELETE|DROP|CREATE|ALTER)\s+.*?\$\{.*?\}",
                "HIGH", "HIGH", "CWE-89", _A03,
                "SQL query constructed using template literals, vulnerable to injection",
                "Use parameterized queries or prepared statements",
                ("javascript",), (("`",), ("${",), ("}",), _SQL_WORDS),
            ),
        ),
    ),
    Family(
        "Cross-Site Scripting (XSS)", "Detection of potential XSS vulnerabilities", "HIGH",
        "CWE-79", ("javascript", "python", "php", "java", "csharp"),
        (
            _rule(
                "xss_innerhtml", "XSS via innerHTML",
                r'\.innerHTML\s*=\s*["\']?[a-zA-Z_][a-zA-Z0-9_]*|\.innerHTML\s*=\s*.*?\+',
                "HIGH", "HIGH", "CWE-79", _A03,
                "Direct assignment to innerHTML with user input can lead to XSS",
                "Use textContent instead of innerHTML, or sanitize input",
                ("javascript",), ((".innerhtml",), ("=",)),
            ),
            _rule(
                "xss_eval", "XSS via eval()",
                r"eval\s*\([^)]*[a-zA-Z_][a-zA-Z0-9_]*",
                "CRITICAL", "HIGH", "CWE-79", _A03,
                "Use of eval() with user input can lead to XSS and code injection",
                "Avoid eval() entirely, use JSON.parse() for data parsing",
                ("javascript",), (("eval",), ("(",)),
            ),
            _rule(
                "xss_python_render_template", "XSS via Template Rendering",
                r"render_template\s*\([^)]*\|\s*safe|render_template_string\s*\([^)]*[a-zA-Z_][a-zA-Z0-9_]*",
                "HIGH", "MEDIUM", "CWE-79", _A03,
                "Template rendering with user input can lead to XSS",
                "Escape user input properly or use auto-escaping templates",
                ("python",), (("render_template",), ("(",)),
            ),
        ),
    ),
    Family(
        "Weak Cryptography", "Detection of weak cryptographic practices", "MEDIUM", "CWE-327",
        ("python", "javascript", "java", "csharp"),
        (
            _rule(
                "weak_crypto_md5", "Weak Hash Algorithm (MD5)",
                r"hashlib\.md5\s*\(|md5\s*\(",
                "MEDIUM", "HIGH", "CWE-327", _A02,
                "MD5 is cryptographically broken and should not be used",
                "Use SHA-256 or SHA-3 instead",
                ("python",), (("md5",), ("(",)),
            ),
            _rule(
                "weak_crypto_sha1", "Weak Hash Algorithm (SHA1)",
                r"hashlib\.sha1\s*\(|sha1\s*\(",
                "MEDIUM", "HIGH", "CWE-327", _A02,
                "SHA1 is cryptographically weak and should not be used",
                "Use SHA-256 or SHA-3 instead",
                ("python",), (("sha1",), ("(",)),
            ),
            _rule(
                "weak_crypto_js_math_random", "Weak Random Number Generation",
                r"Math\.random\s*\(\s*\)",
                "MEDIUM", "HIGH", "CWE-338", _A02,
                "Math.random() is not cryptographically secure",
                "Use crypto.getRandomValues() for security-sensitive operations",
                ("javascript",), (("math.random",), ("(",)),
            ),
        ),
    ),
    Family(
        "Hardcoded Secrets", "Detection of hardcoded secrets and credentials", "HIGH", "CWE-798",
        ("python", "javascript", "java", "csharp", "go"),
        (
            _rule(
                "hardcoded_password", "Hardcoded Password",
                r'(password|passwd|pwd)\s*[=:]\s*["\'][^"\']{8,}["\']',
                "HIGH", "MEDIUM", "CWE-798", _A07,
                "Hardcoded passwords in source code are a security risk",
                "Use environment variables or secure configuration management",
                (), (("password", "passwd", "pwd"), _ASSIGN, _QUOTES),
            ),
            _rule(
                "hardcoded_api_key", "Hardcoded API Key",
                r'(api_key|apikey|api-key)\s*[=:]\s*["\'][A-Za-z0-9]{20,}["\']',
                "HIGH", "HIGH", "CWE-798", _A07,
                "Hardcoded API keys should not be stored in source code",
                "Use environment variables or secure key management",
                (), (("api_key", "apikey", "api-key"), _ASSIGN, _QUOTES),
            ),
            _rule(
                "hardcoded_db_connection", "Hardcoded Database Connection",
                r"(mysql|postgresql|mongodb|redis)://[^:]+:[^@]+@[^/]+",
                "HIGH", "HIGH", "CWE-798", _A07,
                "Database connection strings with credentials should not be hardcoded",
                "Use environment variables or secure configuration management",
                (), (("mysql://", "postgresql://", "mongodb://", "redis://"), ("@",)),
            ),
        ),
    ),
    Family(
        "Insecure Deserialization", "Detection of insecure deserialization vulnerabilities",
        "HIGH", "CWE-502", ("python", "javascript", "java", "csharp"),
        (
            _rule(
                "insecure_pickle", "Insecure Pickle Deserialization",
                r"pickle\.loads?\s*\([^)]*[a-zA-Z_][a-zA-Z0-9_]*",
                "HIGH", "HIGH", "CWE-502", _A08,
                "Deserializing untrusted data with pickle is dangerous",
                "Use JSON or implement input validation and sanitization",
                ("python",), (("pickle.load",), ("(",)),
            ),
            _rule(
                "insecure_eval_deserialize", "Insecure Eval-based Deserialization",
                r"eval\s*\(\s*[a-zA-Z_][a-zA-Z0-9_]*\s*\)",
                "CRITICAL", "HIGH", "CWE-502", _A08,
                "Using eval() to deserialize data is extremely dangerous",
                "Use JSON.parse() instead of eval()",
                ("javascript",), (("eval",), ("(",), (")",)),
            ),
        ),
    ),
)


def without_family(families: tuple, name: str) -> tuple:
    """Drop the first family called ``name``; compare lengths to learn whether one was found."""
    names = [family.name for family in families]
    if name not in names:
        return families
    at = names.index(name)
    return families[:at] + families[at + 1 :]


def with_rules_enabled(families: tuple, rule_ids, enabled: bool) -> tuple:
    """Switch the rules in ``rule_ids`` on or off."""
    chosen = set(rule_ids)
    return tuple(
        replace(
            family,
            rules=tuple(
                replace(rule, enabled=enabled) if rule.rule_id in chosen else rule
                for rule in family.rules
            ),
        )
        for family in families
    )


def active_rules(families: tuple, languages, threshold: float = 0.0) -> list:
    """(rule, languages it runs on) for every rule that can produce a kept finding.

    Rule confidence is fixed per rule, so the confidence filter is decided here, before any plan.
    """
    chosen = []
    for family in families:
        for rule in family.rules:
            langs = tuple(l for l in languages if family.supports(l) and rule.applies_to(l))
            if rule.enabled and langs and rule.score >= threshold:
                chosen.append((rule, langs))
    return chosen


def rule_catalog(spark: SparkSession, families: tuple = BUILTIN_FAMILIES) -> DataFrame:
    """The catalogue as a table: one row per rule, a fixed small list."""
    rows = [
        (
            rule.rule_id, family.name, rule.title, rule.pattern, rule.severity, rule.confidence,
            rule.cwe_id, rule.owasp_category, rule.description, rule.remediation,
            list(rule.references), list(rule.languages), list(family.languages), rule.enabled,
        )
        for family in families
        for rule in family.rules
    ]
    # As an Arrow table the rows become a local relation of known size.
    columns = dict(zip(RULES.names, map(list, zip(*rows)))) if rows else {n: [] for n in RULES.names}
    return spark.createDataFrame(pa.table(columns, schema=to_arrow_schema(RULES)), RULES)
