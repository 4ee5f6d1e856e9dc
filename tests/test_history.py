"""History, usage and grouping operators on small tables with hand-computed results."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sourcelode.operators import history as his, reports as rep, summary as agg, usage as use
from sourcelode.schemas import SCAN_RECORDS
from sourcelode.sources import sinks
from sourcelode.sources.store import Conflict, HistoryStore, Manifests

FIND = "scan_id long, finding_id long, vulnerability_type string, severity string, file_path string, line_number long"


def findings(spark, rows):
    return spark.createDataFrame(rows, FIND)


def scans(spark, rows):
    return spark.createDataFrame(
        rows, "scan_id long, target_path string, scan_timestamp timestamp_ntz"
    )


def day(n, hour=0):
    return datetime(2024, 1, n, hour)


def test_compare_scans_null_lines_and_missing(spark):
    found = findings(spark, [
        (1, 1, "a", "LOW", "f", 1), (1, 2, "a", "LOW", "f", None), (1, 3, "b", "LOW", "f", 2),
        (1, 4, "b", "LOW", "f", 2), (2, 5, "a", "LOW", "f", None), (2, 6, "c", "LOW", "f", None),
    ])
    known = scans(spark, [(1, "t", day(1)), (2, "t", day(2))])
    row = his.compare_scans(known, found, 1, 2).first()
    assert (row.new_vulnerabilities, row.fixed_vulnerabilities, row.persistent_vulnerabilities) == (1, 2, 1)
    assert row.overall_trend == "improved"
    assert his.compare_scans(known, found, 2, 1).first().overall_trend == "degraded"
    assert his.compare_scans(known, found, 1, 1).first().overall_trend == "stable"
    assert his.compare_scans(known, found, 1, 9).count() == 0
    assert [r.vulnerability_type for r in his.new_findings(found, 1, 2).collect()] == ["c"]
    assert his.fixed_findings(found, 1, 2).count() == 2


def test_severity_shift(spark):
    found = findings(spark, [
        (1, 1, "a", "LOW", "f", 1), (2, 2, "a", "HIGH", "f", 1), (1, 3, "b", "CRITICAL", "f", 1),
        (2, 4, "b", "MEDIUM", "f", 1), (1, 5, "c", "LOW", "f", 1), (2, 6, "d", "CRITICAL", "f", 1),
    ])
    known = scans(spark, [(1, "t", day(1)), (2, "t", day(2))])
    row = his.scan_trend(known, found).first()
    assert (row.baseline_scan_id, row.current_scan_id) == (1, 2)
    assert (row.severity_increased, row.severity_decreased) == (1, 1)
    assert row.risk_score_change == (3 - 1) + (2 - 4) + (0 - 1) + (4 - 0)


@pytest.mark.parametrize("bucket", ["hour", "day", "month", "year"])
def test_scan_order_in_every_bucket_size(spark, bucket):
    rows = []
    for n in range(60):
        rows.append((n, f"t{n % 7 % 3}", datetime(2024, 1 + n % 4, 1 + n * 5 % 28, n % 2)))
    expected = {}
    for target in {r[1] for r in rows}:
        ordered = sorted((r[2], r[0]) for r in rows if r[1] == target)
        for at, (_, scan) in enumerate(ordered):
            expected[scan] = (
                ordered[at - 1][1] if at else None,
                ordered[at + 1][1] if at + 1 < len(ordered) else None,
            )
    rows += [(100, None, datetime(2024, 1, 1)), (101, None, None), (102, "t9", None), (103, "t9", datetime(2024, 1, 1))]
    expected |= {100: (101, None), 101: (None, 100), 102: (None, 103), 103: (102, None)}
    got = his.scan_order(scans(spark, rows), bucket).collect()
    assert {r.scan_id: (r.previous_scan_id, r.next_scan_id) for r in got} == expected


def test_scan_without_findings_has_a_trend(spark):
    known = scans(spark, [(1, "t", day(1)), (2, "t", day(2)), (3, "t", day(3))])
    found = findings(spark, [(3, 1, "a", "LOW", "f", 1)])
    got = {r.current_scan_id: (r.new_vulnerabilities, r.overall_trend) for r in his.scan_trend(known, found).collect()}
    assert got == {2: (0, "stable"), 3: (1, "degraded")}
    degraded = his.degraded_comparisons(his.scan_trend(known, found)).collect()
    assert [r.current_scan_id for r in degraded] == [3]


def test_statistics(spark):
    rows = [(f"s{i}", day(i), 4.0 + i, 10 * i, 5 * i) for i in (1, 2, 3)]
    frame = spark.createDataFrame(
        rows, "scan_id string, scan_timestamp timestamp_ntz, scan_duration double, files_scanned long, total_vulnerabilities long"
    )
    row = his.scan_statistics(frame).first()
    assert tuple(row) == (3, 30, 10.0, 60, 6.0)
    assert his.scan_statistics(frame, "2024-01-02", "2024-01-03").first().total_scans == 2
    assert tuple(his.scan_statistics(frame, "2025-01-01").first()) == (0, 0, 0.0, 0, 0.0)


def test_update_status(spark):
    table = spark.createDataFrame(
        [(1, "open", None, "c0"), (2, "open", None, None), (3, "open", None, None)],
        "finding_id long, status string, fixed_at timestamp_ntz, fixed_in_commit string",
    )
    updates = spark.createDataFrame(
        [
            (1, "fixed", day(2), 1, ""), (1, "open", day(3), 2, None), (2, "fixed", day(2), 1, "abc"),
            (2, "ignored", day(2), 2, None), (9, "fixed", day(2), 1, "x"),
        ],
        "finding_id long, status string, updated_at timestamp_ntz, seq long, fixed_in_commit string",
    )
    got = {
        r.finding_id: (r.status, r.fixed_at, r.fixed_in_commit)
        for r in his.update_status(table.withColumn("updated_at", F.lit(None).cast("timestamp_ntz")), updates).collect()
    }
    assert got == {
        1: ("open", day(2), "c0"), 2: ("ignored", day(2), "abc"), 3: ("open", None, None),
    }


def test_retention_and_orphans(spark):
    known = scans(spark, [(1, "t", datetime(2023, 9, 1)), (2, "t", datetime(2024, 1, 1))])
    assert [r.scan_id for r in his.expired_scans(known, "2024-01-01").collect()] == [1]
    assert [r.scan_id for r in his.retained_scans(known, "2024-01-01").collect()] == [2]
    rows = findings(spark, [(1, 1, "a", "LOW", "f", 1), (7, 2, "a", "LOW", "f", 1)])
    assert [r.scan_id for r in his.known_scans_only(rows, known).collect()] == [1]
    assert [r.scan_id for r in his.orphans(rows, known).collect()] == [7]


def hot_findings(spark, n=3000):
    """One scan and file owning most rows, and some ordinary ones."""
    return spark.range(n).select(
        F.when(F.col("id") < n * 2 // 3, 0).otherwise(F.col("id") % 50).cast("long").alias("scan_id"),
        F.col("id").alias("finding_id"), F.col("id").cast("string").alias("id"),
        F.lit("weak_crypto_md5").alias("vulnerability_type"), F.lit("LOW").alias("severity"),
        F.lit("f.py").alias("file_path"), (F.col("id") % 97).alias("line_number"),
    )


def test_hot_file_is_listed_in_order(spark):
    rows = hot_findings(spark)
    listed = agg.findings_by_file(rows.repartition(7), row_id="finding_id")
    got = [(r.scan_id, r.file_path, r.line_number, r.finding_id) for r in listed.collect()]
    assert got == sorted(got) and len(got) == 3000
    totals = {r.scan_id: r.finding_count for r in agg.file_totals(rows).collect()}
    assert totals[0] == sum(g[0] == 0 for g in got) and sum(totals.values()) == 3000


def test_documents_of_a_hot_scan(spark, tmp_path):
    none = F.lit(None).cast("string")
    rows = hot_findings(spark, 900).withColumns({
        "title": F.lit("t"), "description": F.lit("d \"q\""), "confidence": F.lit("HIGH"),
        "column_number": F.lit(1).cast("long"), "end_line_number": F.lit(0).cast("long"),
        "end_column_number": F.lit(None).cast("long"), "code_snippet": F.lit(">>>    1: a: b\nplain"),
        "cwe_id": none, "owasp_category": F.lit(""), "remediation": none, "ai_explanation": F.lit("see a@b.io"),
        "references": F.array(F.lit("u")), "metadata": F.create_map(F.lit("k"), F.lit("v")),
        "false_positive_likelihood": F.lit(0.25),
    })
    known = scans(spark, [(n, "t", day(1)) for n in [*range(50), 99]]).withColumns({
        "scan_duration": F.lit(0.0), "repository_url": none, "branch": none, "commit_hash": none,
    })
    # Two equal rows, and a finding of an unknown scan.
    rows = rows.unionByName(rows.where("finding_id = 5")).unionByName(
        rows.where("finding_id = 6").withColumn("scan_id", F.lit(1000).cast("long"))
    )
    sinks.write_sarif(known, rows, str(tmp_path / "sarif"))
    runs = [run for log in written(tmp_path / "sarif").values() for run in log["runs"]]
    documents = [{"runs": [run]} for run in sorted(runs, key=lambda run: int(run["automationDetails"]["id"].split("/")[0]))]
    assert len(documents) == 51
    ids = []
    for document in documents:
        run = document["runs"][0]
        assert "versionControlProvenance" not in run
        ids.append([int(x["properties"]["scanner_id"]) for x in run["results"]])
        lines = [x["locations"][0]["physicalLocation"]["region"]["startLine"] for x in run["results"]]
        assert lines == sorted(lines)
        assert len(run["artifacts"]) == (1 if run["results"] else 0)
    assert ids[-1] == [] and len(ids[0]) > 600  # scans in order: 99 is the last, 0 the first
    assert sorted(sum(ids, [])) == sorted([*range(900), 5])
    result = documents[0]["runs"][0]["results"][0]
    region = result["locations"][0]["physicalLocation"]["region"]
    assert region["endLine"] == region["startLine"] and region["endColumn"] == 1
    assert region["snippet"]["text"] == " a: b\nplain" and result["ruleIndex"] == 2 and result["level"] == "note"
    assert result["properties"]["ai_analysis"] == "see [REDACTED]" and "cwe" not in result["properties"]
    assert "owasp_category" not in result["properties"] and "fixes" not in result
    sinks.write_json(known, rows, str(tmp_path / "json"))
    plain = sorted((d for file in written(tmp_path / "json").values() for d in file), key=lambda d: d["scan_id"])
    assert [d["scan_id"] for d in plain] == [*range(50), 99] and plain[-1]["vulnerabilities"] == []
    assert sum(len(d["vulnerabilities"]) for d in plain) == 901
    details = rep.check_details(known.withColumns({"files_scanned": F.lit(1), "total_lines_scanned": F.lit(2)}), rows)
    got = [(r.scan_id, r.section, r.line_number) for r in details.where("scan_id = 0").collect()]
    assert got[0][1] == 0 and got[1][1] == 1 and {g[1] for g in got[2:]} == {2}
    assert [g[2] for g in got[2:]] == sorted(g[2] for g in got[2:])


def written(folder):
    """What the files of a report hold; each of them parses alone."""
    import json

    files = sorted(folder.glob("part-*/report-*"))
    assert files and not list(folder.glob("_staging*"))
    return {f"{path.parent.name}/{path.name}": json.loads(path.read_text()) for path in files}


def report_scans(spark, ids):
    none = F.lit(None).cast("string")
    return scans(spark, [(n, "t", day(1)) for n in ids]).withColumns({
        "scan_duration": F.lit(0.0), "repository_url": none, "branch": none, "commit_hash": none,
    })


def report_findings(spark, n):
    none = F.lit(None).cast("string")
    return hot_findings(spark, n).withColumns({
        "title": F.lit("t"), "description": F.lit("d"), "confidence": F.lit("HIGH"), "column_number": F.lit(1).cast("long"),
        "end_line_number": F.lit(0).cast("long"), "end_column_number": F.lit(None).cast("long"), "code_snippet": F.lit("x"), "cwe_id": none,
        "owasp_category": none, "remediation": none, "ai_explanation": none, "references": F.array(F.lit("u")),
        "metadata": F.create_map(F.lit("k"), F.lit("v")), "false_positive_likelihood": F.lit(0.25),
    })


@pytest.mark.parametrize(("file_bytes", "part_rows"), [(1, 100), (200_000, 100), (64 << 20, 50_000)])
def test_report_files_hold_whole_documents(spark, tmp_path, file_bytes, part_rows):
    known, rows = report_scans(spark, [*range(50), 99]), report_findings(spark, 900)
    counts = {r.scan_id: r["count"] for r in rows.groupBy("scan_id").count().collect()}
    sinks.write_sarif(known, rows, str(tmp_path / "s"), file_bytes, part_rows)
    logs = written(tmp_path / "s")
    index = {(r.scan_id, r.part): r.file for r in sinks.report_index(spark, str(tmp_path / "s")).collect()}
    found = {}
    for file, log in logs.items():
        for run in log["runs"]:
            scan, part = run["automationDetails"]["id"].split("/")
            assert index.pop((scan, int(part))) == file
            assert len({x["location"]["uri"] for x in run["artifacts"]}) == len(run["artifacts"]) and len(run["results"]) <= 2 * part_rows
            found.setdefault(int(scan), []).extend(x["properties"]["scanner_id"] for x in run["results"])
    assert not index and {k: len(v) for k, v in found.items()} == {k: counts.get(k, 0) for k in [*range(50), 99]}
    assert sum(len(set(v)) for v in found.values()) == 900
    assert (file_bytes == 1) == all(len(log["runs"]) == 1 for log in logs.values())
    sinks.write_json(known, rows, str(tmp_path / "j"), file_bytes, part_rows)
    documents = [d for file in written(tmp_path / "j").values() for d in file]
    assert sum(len(d["vulnerabilities"]) for d in documents) == 900 and {d["scan_id"] for d in documents} == set(found)


def test_a_failed_report_leaves_no_file(spark, tmp_path):
    broken = F.udf(lambda x: 1 // 0 if x > 40 else "x", "string")
    lines = spark.range(50).select(
        F.col("id").cast("string").alias("scan_id"), F.lit(0).alias("part"), F.lit(True).alias("opens"), F.lit(True).alias("closes"), broken("id").alias("line"),
    )
    spark.dataSource.register(sinks.reportfiles.ReportFiles)
    with pytest.raises(Exception):
        lines.write.format("report_files").mode("append").options(prefix="[", suffix="]", extension="json", fileBytes="9").save(str(tmp_path / "f"))
    assert not list(tmp_path.glob("f/part-*"))


def test_check_texts(spark):
    counts = spark.createDataFrame(
        [("a", 0, 0, 0, 0, 0), ("b", 3, 1, 0, 2, 0)],
        "scan_id string, total_vulnerabilities long, critical_count long, high_count long, medium_count long, low_count long",
    )
    got = {r.scan_id: r.summary for r in rep.check_summary(counts).collect()}
    assert got["a"].endswith("No security vulnerabilities found!")
    assert got["b"] == "🔍 Found 3 security issue(s): | 🔴 1 Critical | 🟡 2 Medium"


def test_history_store(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "h"), "day")
    known = scans(spark, [(1, "t", day(1)), (2, "t", day(2))])
    rows = findings(spark, [(1, 1, "a", "HIGH", "x.ts", 3), (1, 2, "a", "LOW", "x.py", 3), (5, 3, "a", "LOW", "x.py", 3)])
    rows = rows.withColumnRenamed("finding_id", "id").withColumns({
        "ai_explanation": F.lit(None).cast("string"), "false_positive_likelihood": F.lit(None).cast("double"),
    })
    store.save(known, rows)
    store.save(scans(spark, [(5, "t", day(2))]), rows.where("scan_id = 5"), persist_vulnerabilities=False)
    saved = {r.scan_id: r for r in store.scans().collect()}
    assert saved["1"].languages_detected == ["python", "typescript"]
    assert (saved["1"].total_vulnerabilities, saved["1"].high_count, saved["2"].total_vulnerabilities) == (2, 1, 0)
    assert set(SCAN_RECORDS.names) < set(store.scans().columns)
    assert sorted(r.scan_id for r in store.findings().collect()) == ["1", "1"]
    assert {r.status for r in store.findings().collect()} == {"open"}


def stored(spark, path):
    """Two old scans and a new one with a finding each, the old ones of one period."""
    store = HistoryStore(spark, str(path), "month")
    known = scans(spark, [(1, "t", datetime(2023, 9, 1)), (2, "t", datetime(2023, 9, 2)), (3, "t", day(3))])
    rows = findings(spark, [(n, n, "a", "HIGH", "x.py", 3) for n in (1, 2, 3)])
    rows = rows.withColumnRenamed("finding_id", "id").withColumns({
        "ai_explanation": F.lit(None).cast("string"), "false_positive_likelihood": F.lit(None).cast("double"),
    })
    store.save(known, rows)
    return store, known, rows


def test_saving_again_replaces(spark, tmp_path):
    store, known, rows = stored(spark, tmp_path / "h")
    store.save(known, rows)
    assert sorted(r.scan_id for r in store.scans().collect()) == ["1", "2", "3"]
    assert store.findings().count() == 3
    # Scan 2 moves to another month and loses its finding; scan 1 shares its old period.
    store.save(scans(spark, [(2, "t", day(9))]), rows.where("scan_id = 7"))
    got = {r.scan_id: (r.scan_period.month, r.total_vulnerabilities) for r in store.scans().collect()}
    assert got == {"1": (9, 1), "2": (1, 0), "3": (1, 1)}
    assert sorted(r.scan_id for r in store.findings().collect()) == ["1", "3"]


def files_below(folder):
    return {str(path): path.stat().st_mtime_ns for path in folder.rglob("*.parquet")}


def test_rows_are_written_once_and_long_periods_without_a_shuffle(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "h"), "year")
    known = scans(spark, [(1, "t", datetime(2022, 9, 1)), (2, "t", datetime(2023, 9, 2))])
    rows = findings(spark, [(n, 10 * n + k, "a", "HIGH", file, 3) for n in (1, 2) for k, file in enumerate(("x.py", "y.ts", "z"))])
    rows = rows.withColumnRenamed("finding_id", "id").withColumns({
        "ai_explanation": F.lit(None).cast("string"), "false_positive_likelihood": F.lit(None).cast("double"),
    })
    staged = []
    plain = store._staged
    store._staged = lambda *given: (staged.append(plain(*given)), staged[-1])[1]
    written = store._write
    plans = []
    store._write = lambda frame, *rest: (plans.append(frame._jdf.queryExecution().toString()), written(frame, *rest))[1]
    store.save(known, rows)
    # What was staged is the table: new periods are not written again.
    assert len(plans) == 2 and not any("Rebalance" in plan for plan in plans)
    first = files_below(tmp_path / "h" / "data")
    assert {f.folder for f in staged} == {path.split("/data/")[1].split("/")[0] for path in first}
    assert {r.scan_id: (r.total_vulnerabilities, r.languages_detected) for r in store.scans().collect()} == {str(n): (3, ["python", "typescript"]) for n in (1, 2)}
    # A period with other rows is written anew, and the staged rows of it go.
    store.save(scans(spark, [(3, "t", datetime(2023, 5, 1)), (4, "t", datetime(2024, 5, 1))]), rows.where("scan_id = 9"))
    assert {r.scan_id: r.scan_period.year for r in store.scans().collect()} == {"1": 2022, "2": 2023, "3": 2023, "4": 2024}
    left = store.manifests.read(store.version())["tables"]["scan_records"]
    assert left["2024-01-01"] == staged[-1].folder != left["2023-01-01"]
    assert [path.name for path in (tmp_path / "h" / "data" / staged[-1].folder / "scan_records").glob("_at=*")] == ["_at=2024-01-01"]
    assert first.items() <= files_below(tmp_path / "h" / "data").items() and store.findings().count() == 6
    version = store.version()
    assert store.expire("2010-01-01", 90) == version and store.vacuum(keep=1, grace_seconds=0) == 0 and store.scans().count() == 4


def test_stored_scan_without_time(spark, tmp_path):
    store, _, rows = stored(spark, tmp_path / "h")
    for _ in range(2):
        store.save(scans(spark, [(8, "t", None)]), rows.withColumn("scan_id", F.lit(8)))
    assert store.scans().where("scan_id = '8'").count() == 1
    assert store.findings().where("scan_id = '8'").count() == 3


def test_stored_status(spark, tmp_path):
    store, _, _ = stored(spark, tmp_path / "h")
    updates = spark.createDataFrame(
        [(1, "fixed", day(20), 1, "abc"), (9, "fixed", day(20), 1, "x")],
        "id long, status string, updated_at timestamp_ntz, seq long, fixed_in_commit string",
    )
    store.update_status(updates)
    got = {r.id: (r.status, r.fixed_in_commit) for r in store.findings().collect()}
    assert got == {"1": ("fixed", "abc"), "2": ("open", None), "3": ("open", None)}


def test_expiry_takes_children_along(spark, tmp_path):
    store, _, _ = stored(spark, tmp_path / "h")
    archive = HistoryStore(spark, str(tmp_path / "a"), "month")
    pairs = [("1", "2", day(1)), ("2", "3", day(1)), ("3", "4", day(1))]
    store.put("scan_comparisons", spark.createDataFrame(
        pairs, "baseline_scan_id string, current_scan_id string, comparison_timestamp timestamp_ntz"
    ))
    metrics = [("1", "openai", None, 2), ("3", "openai", None, 5)]
    frame = spark.createDataFrame(metrics, "scan_id string, provider string, model string, total_requests long")
    store.put("usage_metrics", frame)
    store.put("usage_metrics", frame)  # no time, no model: still replaced, not added
    assert store.table("usage_metrics").count() == 2
    for _ in range(2):
        store.expire("2024-01-10", 90, archive)
    assert [r.scan_id for r in store.scans().collect()] == ["3"]
    assert [r.id for r in store.findings().collect()] == ["3"]
    assert [(r.baseline_scan_id) for r in store.table("scan_comparisons").collect()] == ["3"]
    assert [r.scan_id for r in store.table("usage_metrics").collect()] == ["3"]
    assert sorted(r.scan_id for r in archive.scans().collect()) == ["1", "2"]
    assert sorted(r.id for r in archive.findings().collect()) == ["1", "2"]
    assert archive.table("scan_comparisons").count() == 2
    assert [r.total_requests for r in archive.table("usage_metrics").collect()] == [2]


def counted(store):
    return sorted(r.scan_id for r in store.scans().collect()), sorted(r.id for r in store.findings().collect())


def test_a_writer_lost_before_its_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    store, known, rows = stored(spark, tmp_path / "h")
    before, version = counted(store), store.version()

    def lost(*_):
        raise OSError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(Manifests, "create", lost)  # data is written, the manifest is not
        for change in (
            lambda: store.save(scans(spark, [(1, "t", datetime(2023, 9, 5)), (7, "t", datetime(2023, 9, 5))]), rows.where("scan_id = 9")),
            lambda: store.expire("2024-01-10", 90),
            lambda: store.put("scan_records", scans(spark, [(2, "t", day(1))])),
        ):
            with pytest.raises(OSError):
                change()
    assert (counted(store), store.version()) == (before, version)
    store.save(scans(spark, [(7, "t", datetime(2023, 9, 5))]), rows.where("scan_id = 9"))
    assert counted(store)[0] == ["1", "2", "3", "7"]
    assert store.vacuum(keep=1, grace_seconds=0) >= 2  # what lost writers left
    assert counted(store)[0] == ["1", "2", "3", "7"]


def test_writers_cannot_overwrite_each_other(spark, tmp_path):
    store, known, rows = stored(spark, tmp_path / "h")
    other, met = HistoryStore(spark, store.path, "month"), []
    plain = store._replaced

    def slow(content, name, *rest):
        plain(content, name, *rest)
        if name == "scan_records" and not met:
            met.append(other.save(scans(spark, [(2, "u", datetime(2023, 9, 9)), (8, "u", datetime(2023, 9, 9))]), rows.where("scan_id = 2")))

    store._replaced = slow
    first = store.version()
    last = store.save(scans(spark, [(1, "u", datetime(2023, 9, 7))]), rows.where("scan_id = 1"))
    assert met == [first + 1] and last == first + 2
    got = {r.scan_id: r.target_path for r in store.scans().collect()}
    assert got == {"1": "u", "2": "u", "3": "t", "8": "u"}
    assert counted(store)[1] == ["1", "2", "3"]
    # A number is taken once.
    assert store.manifests.create(last + 1, {"tables": {}}) and not store.manifests.create(last + 1, {"tables": {"x": {}}})
    assert store.manifests.read(last + 1)["tables"] == {}


def test_a_writer_gives_up_when_others_are_always_faster(spark, tmp_path, monkeypatch):
    store, known, rows = stored(spark, tmp_path / "h")
    before = counted(store)
    monkeypatch.setattr(Manifests, "create", lambda *_: False)
    with pytest.raises(Conflict):
        store.put("scan_records", scans(spark, [(9, "t", day(1))]))
    assert counted(store) == before and store.vacuum(keep=5, grace_seconds=0) == 0


def test_older_versions_stay_readable(spark, tmp_path):
    store, known, rows = stored(spark, tmp_path / "h")
    old, frozen = store.version(), store.at()
    plan = frozen.scans()
    store.expire("2024-01-10", 90)
    assert counted(store) == (["3"], ["3"]) and counted(store.at(old)) == (["1", "2", "3"], ["1", "2", "3"])
    assert counted(frozen)[0] == ["1", "2", "3"] and plan.count() == 3
    assert store.at(0).scans().count() == 0
    with pytest.raises(ValueError):
        frozen.put("scan_records", known)
    assert [str(p.scan_period) for p in store.at(old).table("scan_records", ["2023-09-01"]).select("scan_period").distinct().collect()] == ["2023-09-01"]
    store.vacuum(keep=1)
    assert store.versions() == [old + 1] and plan.count() == 3  # younger than the grace time
    store.vacuum(keep=1, grace_seconds=0)
    assert counted(store) == (["3"], ["3"])


def test_unchanged_periods_keep_their_files(spark, tmp_path):
    store, known, rows = stored(spark, tmp_path / "h")
    before = store.manifests.read(store.version())["tables"]["scan_records"]
    store.put("scan_records", scans(spark, [(4, "t", day(4))]))
    after = store.manifests.read(store.version())["tables"]["scan_records"]
    assert after["2023-09-01"] == before["2023-09-01"] and after["2024-01-01"] != before["2024-01-01"]
    assert store.update_status(spark.createDataFrame([], "id long, status string, updated_at timestamp_ntz, seq long, fixed_in_commit string")) == store.version()


def test_empty_store(spark, tmp_path):
    store = HistoryStore(spark, str(tmp_path / "none"))
    assert store.scans().count() == 0 and store.pattern_usage().count() == 0
    store.expire("2024-01-10")
    store.save(scans(spark, []), findings(spark, []).withColumnRenamed("finding_id", "id").withColumns({
        "ai_explanation": F.lit(None).cast("string"), "false_positive_likelihood": F.lit(None).cast("double"),
    }))
    assert store.findings().count() == 0


def usage(spark, rows):
    return spark.createDataFrame(
        rows, "provider string, model string, prompt_tokens long, completion_tokens long"
    )


def test_prices(spark):
    cases = {
        ("OpenAI", "GPT-4-32k"): (0.03, 0.06), ("openai", "gpt-3.5-turbo-16k"): (0.0005, 0.0015),
        ("anthropic", "claude-2.1"): (0.008, 0.024), ("anthropic", "other"): (0.015, 0.075),
        ("ollama", "llama"): (0.0, 0.0), ("azure", "x"): (0.03, 0.06), ("acme", "gpt-4"): (0.0, 0.0),
    }
    frame = usage(spark, [(p, m, 1000, 1000) for p, m in cases])
    for r in use.with_cost(frame).collect():
        assert (r.prompt_cost, r.completion_cost) == pytest.approx(cases[(r.provider, r.model)])


def test_breakdown_and_budget(spark):
    frame = usage(spark, [("OpenAI", "gpt-4", 1000, 0), ("openai", "gpt-4", 0, 501), ("ollama", "m", 5, 5)])
    row = use.provider_breakdown(frame, "OPENAI").first()
    assert (row.provider, row.requests, row.total_tokens, row.avg_tokens_per_request) == ("OPENAI", 2, 1501, 750)
    none = use.provider_breakdown(frame, "nobody").first()
    assert none.requests == 0 and none.total_cost_usd == 0.0 and none.avg_tokens_per_request == 0
    total = use.cost_summary(frame).where("provider IS NULL").first()
    assert total.total_requests == 3 and total.total_tokens == 1511
    assert use.cost_summary(frame.limit(0)).where("provider IS NULL").count() <= 1
    states = spark.createDataFrame([(7.9,), (8.0,), (10.0,)], "c double").select(use.budget_state("c"))
    assert [r[0] for r in states.collect()] == ["ok", "warning", "exceeded"]


def test_group_limits_reach_the_tasks(spark):
    """Per-group limits are applied before the shuffle."""
    shown = his.show_scan(
        scans(spark, [(1, "t", day(1))]), findings(spark, [(1, 1, "a", "LOW", "f", 1)])
    )
    assert "WindowGroupLimit" in shown._jdf.queryExecution().executedPlan().toString()


def test_compressed_reports_hold_the_same(spark, tmp_path):
    import gzip
    import json

    known, rows = report_scans(spark, [*range(50)]), report_findings(spark, 300)
    sinks.write_sarif(known, rows, str(tmp_path / "plain"))
    sinks.write_sarif(known, rows, str(tmp_path / "small"), compression="gzip")
    plain, small = [sorted((tmp_path / name).glob("part-*/report-*")) for name in ("plain", "small")]
    assert [f"{path.parent.name}/{path.name}.gz" for path in plain] == [f"{path.parent.name}/{path.name}" for path in small]
    assert [path.read_bytes() for path in plain] == [gzip.decompress(path.read_bytes()) for path in small]
    assert 4 * sum(path.stat().st_size for path in small) < sum(path.stat().st_size for path in plain)
    assert {r.file for r in sinks.report_index(spark, str(tmp_path / "small")).collect()} == {f"{path.parent.name}/{path.name}" for path in small}
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "report-*").text(str(tmp_path / "small"))
    assert json.loads(gzip.decompress(small[0].read_bytes())) and lines.where("value LIKE '%scanner_id%'").count() == 300


def test_what_all_documents_repeat_does_not_travel(spark):
    moved = []

    def place(rows, *order):
        moved.append(rows.agg(F.max(F.length("_text"))).first()[0])
        return rows.orderBy(*order)

    known, rows = report_scans(spark, [1, 2]), report_findings(spark, 50)
    heads = rep.run_lines(known, rows, ("scan_id",), place).where(F.col("section") == rep.HEAD).collect()
    assert moved[0] < len(rep.tool_json()) and all(rep.tool_json() in row.line for row in heads)


def test_a_null_line_fails_the_report(spark, tmp_path):
    from sourcelode.sources import reportfiles

    spark.dataSource.register(reportfiles.ReportFiles)
    rows = spark.createDataFrame([("1", 0, True, True, None)], reportfiles.SHAPE)
    with pytest.raises(Exception, match="NULL"):
        rows.write.format(reportfiles.NAME).mode("append").options(prefix="[", suffix="]", extension="json", fileBytes="1").save(str(tmp_path / "x"))


def odd_reports(spark):
    """Scans that are unknown to findings, listed twice or NULL; findings of unknown and NULL scans, of no file, and repeated ones."""
    known = report_scans(spark, [1, 2, 2, 3, None])
    rows = findings(spark, [
        (1, 1, "b", "LOW", "f", 2), (1, 2, "a", "LOW", "f", 2), (1, 3, "a", "LOW", None, None), (1, 4, "a", "LOW", "g", 1), (1, 5, "a", "LOW", "f", 9),
        (2, 6, "a", "LOW", "h", 1), (2, 7, "a", "LOW", "h", None), (8, 8, "a", "LOW", "f", 1), (None, 9, "a", "LOW", "f", 1),
    ])
    return known, report_findings(spark, 1).drop("scan_id", "finding_id", "vulnerability_type", "severity", "file_path", "line_number", "id").limit(1).crossJoin(
        rows.withColumn("id", F.col("finding_id").cast("string"))
    )


def dealt_once(rows, *order):
    return rows.repartition(3, "scan_id").sortWithinPartitions(*order)


def test_dealt_documents_are_the_sorted_ones(spark):
    known, rows = odd_reports(spark)
    plain = [(r.scan_id, r.section, r.line) for r in rep.sarif_lines(known, rows).collect() if r.section != rep.HEAD]
    dealt = [(r.scan_id, r.section, r.line) for r in rep.run_lines(known, rows, ("scan_id",), dealt_once).collect() if r.section != rep.HEAD]
    as_sorted = sorted(dealt, key=lambda line: -1 if line[0] is None else line[0])
    assert [line for line in as_sorted if line[1] != rep.TAIL] == [line for line in plain if line[1] != rep.TAIL]
    assert sum(section == rep.RESULTS for _, section, _ in dealt) == 9  # two of them twice
    plain = [(r.scan_id, r.section, r.line) for r in rep.scan_lines(known, rows).collect()]
    dealt = [(r.scan_id, r.section, r.line) for r in rep.scan_lines(known, rows, ("scan_id",), dealt_once).collect()]
    assert sorted(dealt, key=lambda line: -1 if line[0] is None else line[0]) == plain


@pytest.mark.parametrize("lines", [rep.run_lines, rep.scan_lines])
def test_documents_travel_once(spark, lines):
    known, rows = odd_reports(spark)
    keys = ("scan_id",)
    plan = lines(known, rows.localCheckpoint(), keys, dealt_once)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1


def test_reports_store_what_they_show(spark, tmp_path):
    import glob
    import json

    from sourcelode.session import shared_dir

    before = set(glob.glob(f"{shared_dir(spark)}/findings-*"))
    known, rows = odd_reports(spark)
    twice = rows.where("scan_id = 1").unionByName(rows.where("finding_id = 3"))
    sinks.write_sarif(known.where("scan_id = 1"), twice.withColumn("unseen", F.lit("x" * 500)), str(tmp_path / "s"), 1, 2)
    [stored] = set(glob.glob(f"{shared_dir(spark)}/findings-*")) - before
    assert set(spark.read.parquet(stored).columns) == {"scan_id", *rep.PLACE, *rep.SARIF_FIELDS}
    runs = [run for log in written(tmp_path / "s").values() for run in log["runs"]]
    ids = [x["properties"]["scanner_id"] for run in runs for x in run["results"]]
    assert sorted(ids) == ["1", "2", "3", "3", "4", "5"] and len(runs) == 3 and json.dumps(runs).count("xxx") == 0
