"""Streaming queries: the test tables read as streams, the written tables read back."""

from pyspark.sql import functions as F

from sourcelode.session import scratch_path
from sourcelode.streaming import scans as sts, tables as stt, usage as stu
from workload.detection import FINDS
from workload.history import _USAGE, STATUS_SQL, UPDATES_CTE, VULNS, _shown, tracked_findings
from workload.registry import query
from workload.usage import PRICED
from workload.views import LLM_USAGE, VULNERABILITY_RECORDS, load, src_files_of


# Bytes a batch takes from a table where the order of arrival does not matter.
BATCH = 64 * 2**30


def stream(t, table: str, batch: int | None = BATCH):
    """A test table, one file or a folder of them, as a file stream. ``batch`` None: all of it
    in one batch."""
    reader = t.spark.readStream.schema(load(t.spark, t.sf_dir, table).schema)
    if batch:
        reader = reader.option("maxBytesPerTrigger", batch)
    # As a pattern, the path may be a single file as well.
    return reader.parquet(f"{t.sf_dir.rstrip('/')}/{table}.parque[t]")


def written(t, frame, label: str):
    """Run the stream over all data present, then read what it wrote."""
    base = scratch_path(t.spark, label)
    stt.append_to(frame, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return t.spark.read.schema(frame.schema).parquet(f"{base}/table")


@query(
    "stream_scan",
    "SELECT file_id, vulnerability_type, line_number, column_number, severity FROM finds",
    ["src_files"],
    FINDS,
)
def _(t):
    files = src_files_of(t.spark, t.sf_dir, stream(t, "documents"))
    found = sts.stream_scan(files, keys=("file_id", "file_path")).select(
        "file_id", "vulnerability_type", "line_number", "column_number", "severity"
    )
    return written(t, found, "stream-scan")


@query("stream_dedupe", "SELECT DISTINCT sha256(text) AS code_hash FROM documents")
def _(t):
    """Documents arrive one per second; the delay spans all of them."""
    arrivals = stream(t, "documents").select("text", F.timestamp_seconds(F.col("doc_id") + 1_700_000_000).alias("ts"))
    unique = sts.stream_dedupe(arrivals, "ts", "3650 days", "text").select("code_hash", "ts")
    return written(t, unique, "stream-dedupe").select("code_hash")


def closed_totals(t, totals, label: str):
    """Totals of all windows of the usage table, the last ones included.

    The table holds events of any time, so it is put in order first: quarters by time arrive one after
    another, a batch each. A last run brings one row two days past the end, which closes the windows still open.
    """
    base = scratch_path(t.spark, label)
    events = t("events")
    closing = events.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"))
    markers = closing.select(
        *[
            F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name)
            for f in events.schema
        ]
    )
    sql = LLM_USAGE.replace("FROM events", "FROM {events}")
    out, cuts = None, events.agg(F.percentile_approx("ts", [0.25, 0.5, 0.75])).first()[0] or []
    edges = [None, *sorted(set(cuts)), None]
    quarters = [
        events.where((F.lit(True) if low is None else F.col("ts") >= low) & (F.lit(True) if high is None else F.col("ts") < high))
        for low, high in zip(edges[:-1], edges[1:], strict=True)
    ]
    for arrived in (*quarters, markers):
        arrived.write.mode("append").parquet(f"{base}/events")
        arrivals = t.spark.readStream.schema(events.schema).parquet(f"{base}/events")
        rows = t.spark.sql(sql, events=arrivals)
        out = totals(rows.withColumn("ts", F.col("ts").cast("timestamp")))
        stt.append_to(out, f"{base}/table", f"{base}/checkpoint").awaitTermination()
    return t.spark.read.schema(out.schema).parquet(f"{base}/table")


_CLOSED = "closed AS (SELECT *, date_trunc('day', ts) AS d FROM costs)"


@query(
    "stream_cost",
    """SELECT strftime(d, '%Y-%m-%d') AS day, provider, count(*) AS total_requests, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(sum(total_cost), 9) AS cost_usd
 FROM closed GROUP BY d, provider""",
    ["llm_usage"],
    f"{PRICED},\n{_CLOSED}",
)
def _(t):
    totals = closed_totals(t, stu.stream_cost, "stream-cost")
    return totals.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "provider", "total_requests",
        "total_tokens", F.round("cost_usd", 9).alias("cost_usd"),
    )


@query(
    "stream_budget",
    """SELECT strftime(d, '%Y-%m-%d') AS day, round(sum(total_cost), 9) AS cost_usd,
 CASE WHEN sum(total_cost) >= 10 THEN 'exceeded' WHEN sum(total_cost) >= 8 THEN 'warning' ELSE 'ok' END AS state FROM closed GROUP BY d""",
    ["llm_usage"],
    f"{PRICED},\n{_CLOSED}",
)
def _(t):
    daily = closed_totals(t, stu.stream_budget, "stream-budget")
    return daily.select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"),
        F.round("cost_usd", 9).alias("cost_usd"), "state",
    )


@query("stream_status", STATUS_SQL, [VULNS], UPDATES_CTE)
def _(t):
    sql = UPDATES_CTE[len("updates AS (") : -1].replace("varchar", "string")
    rows = t.spark.sql(sql.replace("FROM lineitem", "FROM {lineitem}"), lineitem=stream(t, "lineitem"))
    base = scratch_path(t.spark, "stream-status")
    log = stt.StatusLog(t.spark, f"{base}/log")
    updates = rows.withColumn("finding_id", F.col("finding_id").cast("long"))
    log.follow(updates, f"{base}/checkpoint").awaitTermination()
    return log.current(tracked_findings(t)).withColumn(
        "fixed_at", F.date_format("fixed_at", "yyyy-MM-dd")
    )


@query("stream_pattern_usage", "SELECT * FROM usage", [VULNS], _USAGE)
def _(t):
    sql = VULNERABILITY_RECORDS.replace("FROM lineitem", "FROM {lineitem}")
    base = scratch_path(t.spark, "stream-rules")
    counters = stt.RuleCounters(t.spark, f"{base}/table")
    counters.follow(
        t.spark.sql(sql, lineitem=stream(t, "lineitem")), f"{base}/checkpoint"
    ).awaitTermination()
    return _shown(counters.current())
