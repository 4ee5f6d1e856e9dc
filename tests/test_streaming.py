"""Streams give what the batch operators give, also over several batches and retries."""

from datetime import datetime

from pyspark.sql import functions as F

from sourcelode.operators import detect as det, history as his
from sourcelode.streaming import scans as sts, tables as stt, usage as stu

USAGE = "usage_id long, ts timestamp, provider string, model string, prompt_tokens long, completion_tokens long"


def follow(spark, path, schema):
    return spark.readStream.schema(schema).parquet(str(path))


def drop_in(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path))


def at(day, hour):
    return datetime(2024, 1, day, hour)


def test_scan_stream_equals_batch(spark, tmp_path):
    schema = "file_path string, content string"
    for name in ("a", "b"):
        drop_in(spark, tmp_path / "in", [(f"{name}.py", "x\nmd5(y) + md5(z)")], schema)
    found = sts.stream_scan(follow(spark, tmp_path / "in", schema)).select("id", "column_number")
    stt.append_to(found, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    batch = det.detect(det.with_language(spark.read.schema(schema).parquet(str(tmp_path / "in"))))
    want = {(r.id, r.column_number) for r in batch.collect()}
    assert {(r.id, r.column_number) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == want
    assert len(want) == 4


def test_late_usage_is_dropped(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")

    def run():
        frame = stu.stream_cost(follow(spark, source, USAGE)).withColumn("day", F.to_date("window_start"))
        stt.append_to(frame, out, str(tmp_path / "cp")).awaitTermination()
        return {(r.day.day, r.provider): r.total_requests for r in spark.read.parquet(out).collect()}

    drop_in(spark, source, [(1, at(1, 5), "openai", "gpt-4", 10, 1), (2, at(2, 3), "openai", "gpt-4", 10, 1)], USAGE)
    assert run() == {(1, "openai"): 1}
    # Day 1 is closed by now; day 2 is not.
    drop_in(spark, source, [(3, at(1, 6), "openai", "gpt-4", 10, 1), (4, at(2, 2), "openai", "gpt-4", 10, 1),
                            (5, at(3, 9), "azure", "gpt-4", 10, 1)], USAGE)
    assert run() == {(1, "openai"): 1, (2, "openai"): 2}


def test_budget_states(spark, tmp_path):
    rows = [(1, at(1, 1), "openai", "gpt-4", 300_000, 0), (2, at(2, 1), "openai", "gpt-4", 400_000, 0),
            (3, at(4, 9), "openai", "gpt-4", 1, 0)]
    drop_in(spark, tmp_path / "in", rows, USAGE)
    frame = stu.stream_budget(follow(spark, tmp_path / "in", USAGE))
    stt.append_to(frame, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("window_start").collect()
    assert [(r.cost_usd, r.state) for r in got] == [(9.0, "warning"), (12.0, "exceeded")]


def test_dedupe_forgets_after_the_delay(spark, tmp_path):
    schema = "ts timestamp, content string"
    source, out = tmp_path / "in", str(tmp_path / "out")

    def run():
        unique = sts.stream_dedupe(follow(spark, source, schema), "ts", "1 hour")
        stt.append_to(unique, out, str(tmp_path / "cp")).awaitTermination()
        return spark.read.parquet(out).count()

    drop_in(spark, source, [(at(1, 1), "a"), (at(1, 1), "a"), (at(1, 1), "b")], schema)
    assert run() == 2
    drop_in(spark, source, [(at(1, 1), "a"), (at(1, 9), "c")], schema)
    assert run() == 3
    drop_in(spark, source, [(at(1, 10), "a")], schema)
    assert run() == 4


UPDATES = "finding_id long, status string, updated_at timestamp_ntz, seq long, fixed_in_commit string"


def test_status_log_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    log = stt.StatusLog(spark, str(tmp_path / "log"))
    table = spark.createDataFrame(
        [(n, "open", None, None, None) for n in range(4)],
        "finding_id long, status string, fixed_at timestamp_ntz, fixed_in_commit string, updated_at timestamp_ntz",
    )
    parts = [
        [(0, "fixed", at(1, 1), 1, "c1"), (0, "open", at(1, 2), 2, None), (1, "fixed", at(1, 5), 3, None)],
        [(1, "ignored", at(1, 4), 4, "c4"), (2, "fixed", at(1, 1), 5, ""), (0, "fixed", at(1, 3), 6, None)],
    ]
    for rows in parts:
        drop_in(spark, source, rows, UPDATES)
        log.follow(follow(spark, source, UPDATES), str(tmp_path / "cp")).awaitTermination()
    got = sorted(map(str, log.current(table).collect()))
    everything = spark.read.schema(UPDATES).parquet(str(source))
    assert got == sorted(map(str, his.update_status(table, everything).collect()))
    # A retried batch replaces its own folder.
    log.follow(follow(spark, source, UPDATES), str(tmp_path / "cp2")).awaitTermination()
    assert sorted(map(str, log.current(table).collect())) == got


def test_rule_counters(spark, tmp_path):
    schema = "vulnerability_type string, status string, severity string, created_at timestamp_ntz"
    source = tmp_path / "in"
    counters = stt.RuleCounters(spark, str(tmp_path / "table"))
    for rows in (
        [("a", "open", "HIGH", at(1, 1)), ("a", "false_positive", "LOW", at(1, 2))],
        [("a", "fixed", "HIGH", at(1, 3)), ("b", "open", "LOW", at(1, 1))],
    ):
        drop_in(spark, source, rows, schema)
        counters.follow(follow(spark, source, schema), str(tmp_path / "cp")).awaitTermination()
    got = {r.pattern_name: (r.times_triggered, r.true_positives, round(r.accuracy_rate, 4)) for r in counters.current().collect()}
    assert got == {"a": (3, 2, 0.6667), "b": (1, 1, 1.0)}


STATUS = "finding_id long, status string, updated_at timestamp_ntz, seq long, fixed_in_commit string"


def test_status_log_is_merged_and_stays_small(spark, tmp_path):
    """Several batches, one of them twice, rows that come late: as one batch, and in few folders."""
    import random

    rng = random.Random(3)
    rows = [(rng.randrange(12), rng.choice(["open", "fixed", "false_positive"]), at(1 + rng.randrange(20), 1), n, rng.choice(["", "c1", None, "c2"])) for n in range(120)]
    findings = spark.createDataFrame(
        [(i, "open", None, None, None) for i in range(14)], "finding_id long, status string, fixed_at timestamp_ntz, fixed_in_commit string, updated_at timestamp_ntz"
    )
    log = stt.StatusLog(spark, str(tmp_path / "log"), merge_every=4)
    assert log.current(findings).count() == 14
    sizes = []
    for number in range(10):
        batch = spark.createDataFrame(rows[12 * number : 12 * number + 12], STATUS)
        log.keep(batch, number)
        if number in (2, 3, 7):
            log.keep(batch, number)  # the batch is tried again, also after it has been merged
        sizes.append((len(list((tmp_path / "log" / "data").iterdir())), log.updates().count()))
    assert max(n for n, _ in sizes) <= 8 and max(n for _, n in sizes) <= 4 * 12 + 12
    whole = stt.StatusLog(spark, str(tmp_path / "whole"))
    whole.keep(spark.createDataFrame(rows, STATUS), 0)
    assert sorted(map(tuple, log.current(findings).collect())) == sorted(map(tuple, whole.current(findings).collect()))


def test_first_seen_forgets_codes_by_timer(spark, tmp_path):
    schema = "content string, ts timestamp"
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        # (hour, code): a comes again and again, b once and much later once more, the rest once each.
        batches = [[(1, "a"), (1, "b"), (1, "a")], [(5, "a"), (5, "c")], [(9, "a"), (9, "d"), (8, "c")], [(13, "a"), (13, "e")], [(17, "a"), (17, "b")], [(21, "a")]]
        states = []
        for number, batch in enumerate(batches):
            drop_in(spark, tmp_path / "in", [(code, at(1, hour)) for hour, code in batch], schema)
            frame = sts.stream_first_seen(follow(spark, tmp_path / "in", schema), "ts", 6 * 3600)
            query = stt.append_to(frame, str(tmp_path / "out"), str(tmp_path / "cp"))
            query.awaitTermination()
            states.append(max((op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]), default=0))
        got = sorted((r.code_hash[:6], r.first_seen.hour) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    finally:
        spark.conf.unset(provider)
    import hashlib

    short = lambda code: hashlib.sha256(code.encode()).hexdigest()[:6]
    assert states[-1] <= max(states[:3]) and len(states) == 6  # codes of the last hours only
    assert got == sorted([(short("a"), 1), (short("b"), 1), (short("c"), 5), (short("d"), 9), (short("e"), 13), (short("b"), 17)])
