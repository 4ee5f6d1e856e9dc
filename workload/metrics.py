"""Queries on code metrics and embedding vectors."""

from pyspark.sql import functions as F

from sourcelode.functions import metrics as m, paths as pth, vectors as v
from sourcelode.functions.lookups import (
    COMPLEXITY_WORDS,
    ERROR_WORDS,
    INDICATOR_WEIGHTS,
    INDICATORS,
    MAINTAINABLE_WORDS,
    NAMING_WORDS,
    RISK_WORDS,
)
from sourcelode.operators import similar as sim
from sourcelode.session import scratch_path
from sourcelode.sources.vectorindex import VectorIndex
from sourcelode.plans.scan import profile_text, profile_vectors
from workload import sqlparts as sp
from workload.detection import scanned
from workload.registry import literal, query

# Test vectors are random directions: .8 never occurs, this threshold does.
NEAR = 0.3
TARGET = 3


def files(t):
    return m.with_lines(scanned(t).select("file_id", "file_path", "content", "language"))


def _any(expression: str, words) -> str:
    return "(" + " OR ".join(f"contains({expression}, {literal(w)})" for w in words) + ")"


_SOLID = sp.strip("l") + " <> ''"
def every(t):
    """All files with their language, also those of no configured one."""
    source = t("src_files").select("file_id", "file_path", "content")
    return m.with_lines(source.withColumn("language", pth.detect_language("file_path", "content")))


LINED = f"""{sp.FILES},
lined AS (SELECT *, string_split(content, chr(10)) AS lines FROM files),
code AS (SELECT *, list_filter(lines, lambda l: {_SOLID}) AS nb FROM lined)"""


def _ratio(array: str, test: str) -> str:
    return f"(len(list_filter({array}, lambda l: {test})) / len(nb))"


_WORDS = " + ".join(f"CAST(contains(lower(l), {literal(w)}) AS INTEGER)" for w in COMPLEXITY_WORDS)
COMPLEXITY = f"CASE WHEN len(nb) = 0 THEN 0.0::DOUBLE ELSE least(list_sum(list_transform(nb, lambda l: {_WORDS})) / len(nb), 1.0::DOUBLE) END"
RISK = "least((" + " + ".join(f"CAST(contains(lower(content), {literal(w)}) AS INTEGER)" for w in RISK_WORDS) + ") / 10.0::DOUBLE, 1.0::DOUBLE)"
MAINTAIN = f"CASE WHEN len(nb) = 0 THEN 1.0::DOUBLE ELSE {_ratio('nb', _any('l', MAINTAINABLE_WORDS))} END"
_TRIPLE = (literal('"""'), literal("'''"))
_DOC = f"contains(l, {_TRIPLE[0]}) OR contains(l, {_TRIPLE[1]}) OR starts_with({sp.strip('l')}, '#')"
QUALITY = f"""CASE WHEN len(nb) = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, least({_ratio('lines', _DOC)} * 2, 0.3::DOUBLE)
 + least({_ratio('nb', _any('lower(l)', NAMING_WORDS))} * 3, 0.2::DOUBLE) + least({_ratio('nb', _any('lower(l)', ERROR_WORDS))} * 5, 0.2::DOUBLE)
 - {_ratio('nb', 'length(l) > 120')} * 0.2::DOUBLE + 0.3::DOUBLE)) END"""


def metric(name: str, sql: str, column):
    @query(name, f"SELECT file_id, round({sql}, 9) AS {name} FROM code", ["src_files"], LINED)
    def _(t):
        return files(t).select("file_id", F.round(column(), 9).alias(name))


metric("complexity", COMPLEXITY, m.complexity)
metric("risk_score", RISK, m.risk_score)
metric("maintainability", MAINTAIN, m.maintainability)
metric("code_quality", QUALITY, m.code_quality)


_COMMENTS = f"len(list_filter(lines, lambda l: starts_with({sp.strip('l')}, '#')))"


@query(
    "line_stats",
    f"""SELECT file_id, CAST(len(lines) AS BIGINT) AS total_lines, CAST(len(nb) AS BIGINT) AS code_lines, CAST({_COMMENTS} AS BIGINT) AS comment_lines,
 CAST(len(lines) - len(nb) AS BIGINT) AS blank_lines, {_COMMENTS} / len(lines) AS comment_ratio, len(nb) / len(lines) AS code_density FROM code""",
    ["src_files"],
    LINED,
)
def _(t):
    return files(t).select("file_id", *[c.alias(n) for n, c in m.line_stats().items()])


@query(
    "indentation",
    f"""SELECT file_id, level, count(*) AS lines FROM (SELECT file_id, CAST(floor(length(regexp_extract(unnest(nb), '^{sp.WS}*')) / 4) AS BIGINT) AS level FROM code) GROUP BY ALL""",
    ["src_files"],
    LINED,
)
def _(t):
    return (
        files(t).select("file_id", F.explode(m.indentation_levels()).alias("level"))
        .groupBy("file_id", "level").agg(F.count(F.lit(1)).alias("lines"))
    )


def _count(token: str) -> str:
    return f"CAST((length(content) - length(replace(content, {literal(token)}, ''))) / {len(token)} AS BIGINT)"


@query(
    "count_functions",
    f"""SELECT file_id, CASE WHEN language = 'python' THEN {_count('def ')} WHEN language IN ('javascript', 'typescript') THEN {_count('function ')} + {_count('=> ')}
 WHEN language = 'java' THEN len(list_filter(string_split(content, chr(10)), lambda l: contains(l, 'public') AND contains(l, '(') AND contains(l, '{{'))) ELSE 0 END AS functions FROM all_files""",
    ["src_files"],
    sp.ALL_FILES,
)
def _(t):
    return every(t).select("file_id", m.function_count().alias("functions"))


@query(
    "count_classes",
    f"SELECT file_id, CASE WHEN language IN ('python', 'javascript', 'typescript', 'java') THEN {_count('class ')} ELSE 0 END AS classes FROM all_files",
    ["src_files"],
    sp.ALL_FILES,
)
def _(t):
    return every(t).select("file_id", m.class_count().alias("classes"))


@query(
    "count_imports",
    f"""SELECT file_id, CASE WHEN language = 'python' THEN {_count('import ')} + {_count('from ')} WHEN language IN ('javascript', 'typescript') THEN {_count('import ')} + {_count('require(')}
 WHEN language = 'java' THEN {_count('import ')} ELSE 0 END AS imports FROM all_files""",
    ["src_files"],
    sp.ALL_FILES,
)
def _(t):
    return every(t).select("file_id", m.import_count().alias("imports"))


@query(
    "control_counts",
    f"""SELECT file_id, {_count('if ')} AS if_statements, {_count('for ')} AS for_loops, {_count('while ')} AS while_loops, {_count('try')} AS try_blocks,
 CASE WHEN language = 'python' THEN {_count('with ')} END AS with_statements, CASE WHEN language = 'python' THEN {_count('async def')} END AS async_functions FROM all_files""",
    ["src_files"],
    sp.ALL_FILES,
)
def _(t):
    return every(t).select("file_id", m.control_counts().alias("c")).select("file_id", "c.*")


def _words(language: str) -> str:
    return "[" + ", ".join(literal(w) for w in INDICATORS[language]) + "]"


def _found(source: str) -> str:
    return f"""found AS (SELECT *, list_filter(CASE WHEN language = 'javascript' THEN {_words('javascript')} WHEN language = 'java' THEN {_words('java')} ELSE {_words('python')} END,
 lambda w: contains(lower(content), lower(w))) AS words FROM {source})"""


_FOUND = _found("code")
_WEIGHT = "CASE w " + " ".join(f"WHEN {literal(w)} THEN {x}" for w, x in INDICATOR_WEIGHTS.items()) + " ELSE 0.1 END"
_INDICATED = f"least(coalesce(list_sum(list_transform(words, lambda w: CAST({_WEIGHT} AS DOUBLE))), 0), 1.0::DOUBLE)"


@query(
    "security_indicators",
    f"""SELECT file_id, array_to_string(words, ' ') AS detected, CAST(len(words) AS BIGINT) AS pattern_count, round({_INDICATED}, 6) AS risk,
 array_to_string(list_filter(words, lambda w: w IN ('eval(', 'exec(', 'os.system', 'Runtime.exec')), ' ') AS high_risk,
 array_to_string(list_filter(words, lambda w: w IN ('subprocess', 'innerHTML', 'document.write')), ' ') AS medium_risk FROM found""",
    ["src_files"],
    f"{sp.ALL_FILES},\n{_found('all_files')}",
)
def _(t):
    found = every(t).withColumn("w", m.detected_indicators())
    return found.select(
        "file_id", F.array_join("w", " ").alias("detected"),
        F.size("w").cast("long").alias("pattern_count"),
        F.round(m.indicator_risk("w"), 6).alias("risk"),
        F.array_join(m.high_risk("w"), " ").alias("high_risk"),
        F.array_join(m.medium_risk("w"), " ").alias("medium_risk"),
    )


# --- vectors ---------------------------------------------------------------------------------

VECS = "vecs AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e, len(embedding) AS n, list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE))) AS a FROM embeddings)"
_VAR = "(list_sum(list_transform(e, lambda x: x * x)) / n - pow(list_sum(e) / n, 2))"
_TOTAL = "list_sum(a)"
ENTROPY = f"(-list_sum(list_transform(a, lambda x: x / {_TOTAL} * log2(x / {_TOTAL} + 1e-10))) / log2(n))"
SEMANTIC = f"greatest(0, least(1, ({_VAR} * 0.4 + (list_max(e) - list_min(e)) * 0.4 + (1 - len(list_filter(a, lambda x: x < 0.01)) / n) * 0.2) / 2))"
SIGNAL = f"least(1, (list_max(a) * 0.3 + list_sum(a) / n * 0.3 + {_VAR} * 0.4) / 3)"
DIVERSITY = """greatest(0, least(1, 1 - list_sum(list_transform(range(0, 8), lambda i: coalesce(list_sum(list_transform(range(i + 1, 8),
 lambda j: list_cosine_similarity(e[i * 8 + 1 : i * 8 + 8], e[j * 8 + 1 : j * 8 + 8]))), 0))) / 28))"""


def vector_metric(name: str, sql: str, column):
    @query(name, f"SELECT vec_id, round(CAST({sql} AS DOUBLE), 6) AS {name} FROM vecs", ctes=VECS)
    def _(t):
        return t("embeddings").select("vec_id", F.round(column("embedding"), 6).alias(name))


vector_metric("vec_norm", "sqrt(list_sum(list_transform(e, lambda x: x * x)))", v.norm)
vector_metric("vec_entropy", ENTROPY, v.entropy)
vector_metric("vec_complexity", SEMANTIC, v.semantic_complexity)
vector_metric("vec_diversity", DIVERSITY, v.pattern_diversity)
vector_metric("vec_risk", SIGNAL, v.security_signal)


_PROFILED = f"""{LINED},
{_FOUND},
{VECS},
scored AS (SELECT file_id, {COMPLEXITY} AS cx, {MAINTAIN} AS mt, {QUALITY} AS q, {_INDICATED} AS risk, {ENTROPY} AS en, {SEMANTIC} AS sc, {SIGNAL} AS em
 FROM found LEFT JOIN vecs ON file_id = vec_id)"""
_OVERALL = """greatest(0, least(1, 0.5 * (risk * 0.8 + em * 0.2) + 0.3 * (cx * 0.3 + (1 - mt) * 0.2 + (1 - q) * 0.2) + 0.2 * (sc * 0.4 + least(en, 0.5) * 0.3)))"""


def profiled(t):
    vectors = t("embeddings").select(F.col("vec_id").alias("file_id"), "embedding")
    # Texts are measured where they are; only the measures meet the vectors.
    measured = profile_text(scanned(t).select("file_id", "content", "language"))
    return profile_vectors(measured.join(vectors, "file_id", "left"))


@query(
    "overall_risk",
    f"SELECT file_id, CASE WHEN en IS NOT NULL THEN round(CAST({_OVERALL} AS DOUBLE), 6) END AS overall_risk FROM scored",
    ["src_files"],
    _PROFILED,
)
def _(t):
    return profiled(t).select("file_id", F.round("overall_risk_score", 6).alias("overall_risk"))


@query(
    "profile_code",
    f"""SELECT f.file_id, round(CAST({COMPLEXITY} AS DOUBLE), 6) AS complexity_score, round({RISK}, 6) AS security_risk_score, round(CAST({MAINTAIN} AS DOUBLE), 6) AS maintainability_score,
 round(CAST({QUALITY} AS DOUBLE), 6) AS code_quality_score, round(CAST({ENTROPY} AS DOUBLE), 6) AS embedding_entropy, CASE WHEN vec_id IS NOT NULL THEN round(CAST({DIVERSITY} AS DOUBLE), 6) END AS pattern_diversity,
 CAST(len(lines) AS BIGINT) AS total_lines, CAST(len(words) AS BIGINT) AS pattern_count, {_count('class ')} AS class_count, CAST(length(content) AS BIGINT) AS code_length,
 CASE WHEN vec_id IS NULL THEN 'no embedding' END AS error
 FROM found f LEFT JOIN vecs ON file_id = vec_id""",
    ["src_files"],
    f"{LINED},\n{_FOUND},\n{VECS}",
)
def _(t):
    return profiled(t).select(
        "file_id",
        *[
            F.round(c, 6).alias(c)
            for c in (
                "complexity_score", "security_risk_score", "maintainability_score",
                "code_quality_score", "embedding_entropy", "pattern_diversity",
            )
        ],
        "total_lines", "pattern_count", "class_count",
        F.col("analysis_metadata.code_length").alias("code_length"), "error",
    )


# --- similarity ------------------------------------------------------------------------------

_COS = "list_cosine_similarity(a.e, b.e)"


def target(t):
    return t("embeddings").where(F.col("vec_id") == TARGET).select("embedding")


@query(
    "cosine",
    f"SELECT a.vec_id, round({_COS}, 6) AS similarity FROM vecs a JOIN vecs b ON b.vec_id = {TARGET}",
    ctes=VECS,
)
def _(t):
    aimed = t("embeddings").withColumn("target", target(t).scalar())
    return aimed.select("vec_id", F.round(v.cosine("embedding", "target"), 6).alias("similarity"))


@query(
    "find_similar",
    f"""SELECT a.vec_id, round({_COS}, 6) AS similarity FROM vecs a JOIN vecs b ON b.vec_id = {TARGET}
 WHERE {_COS} >= 0.1 ORDER BY {_COS} DESC, a.vec_id LIMIT 20""",
    ctes=VECS,
)
def _(t):
    return sim.find_similar(t("embeddings"), target(t), 0.1).withColumn(
        "similarity", F.round("similarity", 6)
    )


@query(
    "similar_findings",
    f"""SELECT a.vec_id, d.doc_id IS NOT NULL AS has_code, round({_COS}, 6) AS similarity_score FROM vecs a JOIN vecs b ON b.vec_id = {TARGET}
 LEFT JOIN documents d ON d.doc_id = a.vec_id WHERE a.vec_id <> {TARGET} AND {_COS} >= 0.1 ORDER BY {_COS} DESC, a.vec_id LIMIT 20""",
    ctes=VECS,
)
def _(t):
    near = sim.similar_findings(t("embeddings"), TARGET, 0.1, row_id="vec_id")
    code = t("documents").select(F.col("doc_id").alias("vec_id"), F.lit(True).alias("has_code"))
    return near.join(code, "vec_id", "left").select(
        "vec_id", F.coalesce("has_code", F.lit(False)).alias("has_code"),
        F.round("similarity_score", 6).alias("similarity_score"),
    )


_ALL = f"""ranked AS (SELECT a.vec_id AS target_id, b.vec_id AS similar_id, {_COS} AS s,
 row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM vecs a JOIN vecs b ON a.vec_id <> b.vec_id WHERE {_COS} >= {NEAR})"""


@query(
    "similar_pairs",
    "SELECT target_id, similar_id, round(s, 6) AS similarity FROM ranked",
    ctes=f"{VECS},\n{_ALL}",
)
def _(t):
    """Every pair within the threshold, however many partners a row has."""
    return sim.similar_all(t("embeddings"), NEAR, top=None).select(
        "target_id", "similar_id", F.round("similarity", 6).alias("similarity")
    )


@query(
    "top_similar",
    "SELECT target_id, similar_id, rank FROM ranked WHERE rank <= 3",
    ctes=f"{VECS},\n{_ALL}",
)
def _(t):
    return sim.similar_all(t("embeddings"), NEAR, top=3).select("target_id", "similar_id", "rank")


def vector_index(t):
    """A stored index of all vectors, by their id as text."""
    index = VectorIndex(t.spark, scratch_path(t.spark, "vector-index"))
    return index.build(t("embeddings").select(F.lpad(F.col("vec_id").cast("string"), 12, "0").alias("code_hash"), "embedding"))


_NEAREST = f"""ranked AS (SELECT a.vec_id AS query_id, b.vec_id, {_COS} AS s, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank
 FROM vecs a JOIN vecs b ON a.vec_id % 100 = 0 WHERE {_COS} >= 0.3)"""


@query(
    "index_search",
    "SELECT query_id, rank, vec_id, round(s, 6) AS similarity FROM ranked WHERE rank <= 10",
    ctes=f"{VECS},\n{_NEAREST}",
)
def _(t):
    """The rows nearest to every hundredth row, exactly, from the lists that may hold them."""
    asked = t("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = vector_index(t).search(asked, 0.3, 10, exact=True)
    return found.select("query_id", "rank", F.col("code_hash").cast("long").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query(
    "index_find",
    f"""SELECT a.vec_id, round({_COS}, 6) AS similarity FROM vecs a JOIN vecs b ON b.vec_id = {TARGET}
 WHERE {_COS} >= 0.1 ORDER BY {_COS} DESC, a.vec_id LIMIT 20""",
    ctes=VECS,
)
def _(t):
    aim = target(t).first()[0]
    found = vector_index(t).find(aim, 0.1, exact=True)
    return found.select(F.col("code_hash").cast("long").alias("vec_id"), F.round("similarity", 6).alias("similarity"))


@query(
    "embed_corpus",
    "SELECT DISTINCT sha256(content) AS code_hash, CAST(64 AS BIGINT) AS dimensions, 1.0::DOUBLE AS length FROM files",
    ["src_files"],
    sp.FILES,
)
def _(t):
    """One unit vector per distinct code."""
    found = sim.embed_corpus(scanned(t).select("file_id", "content", "language"), "file_id")
    return found.select(
        "code_hash", F.size("embedding").cast("long").alias("dimensions"),
        F.round(v.norm("embedding"), 6).alias("length"),
    )
