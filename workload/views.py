"""Input views derived from the test tables, as SQL that runs in Spark and in DuckDB."""

from pyspark.sql import DataFrame, SparkSession

SNIPPETS = """SELECT * FROM (VALUES
 (0,'python','query = f"SELECT * FROM users WHERE id = {user_id}"'),
 (1,'python','sql = "DELETE FROM t WHERE n = %s" % (name,)'),
 (2,'python','return render_template_string(template)'),
 (3,'python','h = hashlib.md5(a) + md5 (b)'),
 (4,'python','t = hashlib.sha1(data)'),
 (5,'python','obj = pickle.loads(data)'),
 (6,'any','password = "super_secret_password123"'),
 (7,'any','API_KEY: "ak1234567890abcdef1234567890abcdef"'),
 (8,'any','url = "postgresql://user:pw@localhost/mydb"'),
 (9,'javascript','const q = "SELECT * FROM users WHERE id = " + userId;'),
 (10,'javascript',concat('const q = `SELECT * FROM users WHERE id = ', chr(36), '{userId}`;')),
 (11,'javascript','el.innerHTML = userInput; eval(code)'),
 (12,'javascript','const t = Math.random().toString(36);'),
 (13,'any','def safe(x): return x'),
 (14,'any','if ok: import os  # fine')) AS s(k, hint, line)"""

SRC_FILES = """SELECT d.doc_id AS file_id, concat('repo-', cast(d.doc_id % 7 AS string)) AS repo,
 concat('/corpus/repo-', cast(d.doc_id % 7 AS string),
   CASE d.doc_id % 11 WHEN 0 THEN '/node_modules/x' WHEN 1 THEN '/.hidden' WHEN 2 THEN '/dist/a' ELSE '/src' END,
   '/f', cast(d.doc_id AS string),
   CASE d.doc_id % 9 WHEN 0 THEN '.js' WHEN 1 THEN '.ts' WHEN 2 THEN '.JSX' WHEN 3 THEN '.java' WHEN 4 THEN '' WHEN 5 THEN '.md' ELSE '.py' END) AS file_path,
 concat(CASE WHEN d.doc_id % 9 = 4 THEN concat('#!/usr/bin/env python3', chr(10)) ELSE '' END,
   d.text, chr(10), a.line, chr(10), b.line, chr(10)) AS content
FROM documents d JOIN snippets a ON d.doc_id % 15 = a.k JOIN snippets b ON (d.doc_id * 7 + 3) % 15 = b.k"""

SCAN_RECORDS = """SELECT cast(o_orderkey AS bigint) AS scan_id, concat('repo-', cast(o_custkey AS string)) AS target_path, o_orderdate AS scan_timestamp,
 o_totalprice AS scan_duration, cast(o_orderkey % 97 AS bigint) AS files_scanned, cast(o_orderkey % 9973 AS bigint) AS total_lines_scanned,
 (o_orderpriority LIKE '1%') AS ai_analysis_enabled FROM orders"""

VULNERABILITY_RECORDS = """SELECT cast(l_orderkey * 10 + l_linenumber AS bigint) AS finding_id, cast(l_orderkey AS bigint) AS scan_id,
 CASE l_partkey % 5 WHEN 0 THEN 'sql_injection_python_fstring' WHEN 1 THEN 'xss_eval' WHEN 2 THEN 'weak_crypto_md5' WHEN 3 THEN 'hardcoded_password' ELSE 'insecure_pickle' END AS vulnerability_type,
 CASE l_partkey % 5 WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'MEDIUM' ELSE 'HIGH' END AS severity,
 CASE l_partkey % 5 WHEN 3 THEN 'MEDIUM' ELSE 'HIGH' END AS confidence,
 concat('src/f', cast(l_suppkey % 3 AS string), CASE WHEN l_partkey % 5 = 1 THEN '.js' ELSE '.py' END) AS file_path,
 CASE WHEN l_quantity >= 49 THEN NULL ELSE cast(l_linenumber AS bigint) END AS line_number,
 CASE l_returnflag WHEN 'R' THEN 'fixed' WHEN 'A' THEN 'false_positive' ELSE 'open' END AS status, l_shipdate AS created_at FROM lineitem"""

LLM_USAGE = """SELECT event_id AS usage_id, ts, cast(user_id AS bigint) AS scan_id,
 CASE event_id % 6 WHEN 0 THEN 'openai' WHEN 1 THEN 'OpenAI' WHEN 2 THEN 'anthropic' WHEN 3 THEN 'azure' WHEN 4 THEN 'ollama' ELSE 'acme' END AS provider,
 CASE event_id % 7 WHEN 0 THEN 'gpt-4-32k' WHEN 1 THEN 'gpt-4-turbo-preview' WHEN 2 THEN 'claude-3-haiku-20240307' WHEN 3 THEN 'gpt-3.5-turbo-16k' WHEN 4 THEN 'claude-2.1' WHEN 5 THEN 'llama3' ELSE 'GPT-4' END AS model,
 cast(floor(abs(value) * 10) AS bigint) AS prompt_tokens, cast(event_id % 500 AS bigint) AS completion_tokens, (event_type <> 'error') AS ok FROM events"""

VERDICTS = """SELECT doc_id AS file_id, CASE WHEN doc_id % 10 = 9 THEN 'not json' ELSE
 concat('{"analysis":"a', cast(doc_id AS string), '","severity_assessment":"', CASE WHEN toxic = 1 THEN 'critical' WHEN quality = 1 THEN 'LOW' ELSE 'UNKNOWN' END,
 '","confidence":"', CASE WHEN quality = 1 THEN 'high' ELSE 'LOW' END, '","false_positive_likelihood":', cast(doc_id % 11 AS string), 'e-1,"remediation":"use parameterised queries, and validate"}') END AS verdict_json FROM labels"""

RAW_PATHS = """SELECT page_id AS path_id, CASE page_id % 8 WHEN 0 THEN '../etc/passwd' WHEN 1 THEN '.github/workflows/ci.yml' WHEN 2 THEN concat('src', chr(92), 'a', cast(page_id AS string), '.py')
 WHEN 3 THEN 'dir/../../etc/shadow' WHEN 4 THEN '/abs/x.py' WHEN 5 THEN 'docs/.hidden/x.md' WHEN 6 THEN '' ELSE split_part(url, '//', 2) END AS raw_path FROM pages"""

# view -> (SQL, tables and views it reads)
VIEWS = {
    "snippets": (SNIPPETS, ()),
    "src_files": (SRC_FILES, ("documents", "snippets")),
    "scan_records": (SCAN_RECORDS, ("orders",)),
    "vulnerability_records": (VULNERABILITY_RECORDS, ("lineitem",)),
    "llm_usage": (LLM_USAGE, ("events",)),
    "verdicts": (VERDICTS, ("labels",)),
    "raw_paths": (RAW_PATHS, ("pages",)),
}


# Tables whose views feed heavy work, and the key that spreads them.
SPREAD_BY = {"lineitem": "l_orderkey", "orders": "o_orderkey"}


def _src_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return src_files_of(spark, sf_dir, spread(spark, load(spark, sf_dir, "documents"), "doc_id"))


def spread(spark: SparkSession, table: DataFrame, key: str) -> DataFrame:
    """Text and grouping work costs more than reading, so a table that Spark reads in fewer tasks
    than there are cores is spread before it; large files are read in many tasks."""
    cores = spark.sparkContext.defaultParallelism
    return table.repartition(cores, key) if table.rdd.getNumPartitions() < cores else table


def src_files_of(spark: SparkSession, sf_dir: str, documents: DataFrame) -> DataFrame:
    """The source file view over given documents, a table or a stream."""
    sql = SRC_FILES.replace("FROM documents", "FROM {documents}")
    sql = sql.replace("JOIN snippets", "JOIN {snippets}")
    return spark.sql(sql, documents=documents, snippets=load(spark, sf_dir, "snippets"))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table or a view over test tables."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    if name == "src_files":
        return _src_files(spark, sf_dir)
    sql, inputs = VIEWS[name]
    frames = {source: load(spark, sf_dir, source) for source in inputs}
    for source, key in SPREAD_BY.items():
        if source in frames:
            frames[source] = spread(spark, frames[source], key)
    sql = sql.replace("{", "{{").replace("}", "}}") if inputs else sql
    for source in inputs:
        sql = sql.replace(f"FROM {source}", f"FROM {{{source}}}")
    return spark.sql(sql, **frames) if frames else spark.sql(sql)


def duck(name: str) -> str:
    return VIEWS[name][0].replace("AS string", "AS varchar")


def with_views(*names: str) -> str:
    """A ``WITH`` list defining the views for DuckDB, inputs first."""
    needed: list = []
    for name in names:
        for source in (*VIEWS[name][1], name):
            if source in VIEWS and source not in needed:
                needed.append(source)
    return "WITH " + ",\n".join(f"{name} AS ({duck(name)})" for name in needed)
