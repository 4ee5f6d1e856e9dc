"""Trees on disk: which files are listed, read and scanned."""

import base64
import json
import os

from pyspark.sql import functions as F

from sourcelode.functions import paths as pth, text as txt
from sourcelode.options import ScanOptions, config_snapshot
from sourcelode.plans import scan
from sourcelode.sources import files as src, repos, sinks


def put(root, path, data):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as out:
        out.write(data if isinstance(data, bytes) else data.encode())


def tree(tmp_path):
    root = str(tmp_path / "repo")
    put(root, "__init__.py", "h = md5(x)\r\nk = 1\r")
    put(root, "_private/a.py", "pickle.loads(x)\n")
    put(root, "deep/b/c/d/e.py", "sha1(x)")
    put(root, ".hidden/x.py", "md5(x)")
    put(root, "node_modules/lib/y.js", "eval(x)")
    put(root, "src/z.TS", "eval(x)")
    put(root, "src/.dotfile.py", "md5(x)")
    put(root, "bad.py", b"md5(x) \xff\xfe")
    put(root, "bom.py", "﻿md5(x)")
    put(root, "notes.md", "md5(x)")
    put(root, "tool", "#!/usr/bin/python\nmd5(x)")
    put(root, "empty.py", "")
    os.symlink(os.path.join(root, "deep"), os.path.join(root, "linked"))
    return root


def names(frame, root):
    return sorted(r.file_path[len(root) + 1 :] for r in frame.select("file_path").collect())


def test_listing_and_path_filters(spark, tmp_path):
    root = tree(tmp_path)
    listed = src.list_files(spark, [root])
    # node_modules itself is entered ("*/node_modules/*" needs something below), its folders not.
    assert names(listed, root) == sorted([
        "__init__.py", "_private/a.py", "deep/b/c/d/e.py", "src/z.TS", "src/.dotfile.py", "bad.py",
        "bom.py", "notes.md", "tool", "empty.py",
    ])
    assert names(src.list_files(spark, [root], split_depth=1), root) == names(listed, root)
    assert src.list_files(spark, [root + "/none"]).count() == 0
    small = ScanOptions(max_file_size_mb=10 / 1024 / 1024)
    assert "_private/a.py" not in names(src.within_size(listed, small), root)
    everything = ScanOptions(include_patterns=())
    assert "tool" in names(src.select_paths(listed, everything), root)
    assert "tool" not in names(src.select_paths(listed), root)
    assert names(src.cap_files(listed, 2), root) == ["__init__.py", "_private/a.py"]
    assert src.cap_files(listed, 0).count() == 10
    assert src.cap_files(listed, 3, per="root").count() == 3


def test_scan_tree(spark, tmp_path):
    root = tree(tmp_path)
    files, findings = scan.scan_tree(spark, [root], ScanOptions(include_patterns=()))
    assert names(files, root) == sorted([
        "__init__.py", "_private/a.py", "deep/b/c/d/e.py", "src/z.TS", "src/.dotfile.py", "bom.py",
        "tool", "empty.py",
    ])
    found = {(r.file_path[len(root) + 1 :], r.line_number, r.column_number) for r in findings.collect()}
    assert ("bom.py", 1, 2) in found and ("src/z.TS", 1, 1) in found and ("tool", 2, 1) in found
    assert len(findings.collect()) == 8
    record = scan.scan_records(files, findings, "s1", "2024-01-01 00:00:00", 1.5).first()
    # "h\nk\n" after newline conversion is three lines.
    assert record.files_scanned == 8 and record.total_lines_scanned == 3 + 2 + 1 + 1 + 1 + 1 + 2 + 1
    assert record.repository_name == "repo"
    assert scan.scan_records(files, None, "s1", "2024-01-01 00:00:00", 1.5).first().asDict() == record.asDict()


def test_scan_file(spark, tmp_path):
    root = tree(tmp_path)
    _, findings = scan.scan_file(spark, root + "/_private/a.py")
    assert [r.vulnerability_type for r in findings.collect()] == ["insecure_pickle"]
    files, findings = scan.scan_file(spark, root + "/missing.py")
    assert files.count() == 0 and findings.count() == 0


def test_file_info_and_text_check(spark, tmp_path):
    root = str(tmp_path / "r")
    put(root, "a.PY", "x = 1\n")
    put(root, "bin", b"\x00\x01abc")
    put(root, "noise", bytes(range(128, 228)))
    put(root, "none", b"")
    put(root, "late", b"a" * 8192 + b"\x00")
    info = {r.name: r for r in src.file_info(src.read_bytes(src.list_files(spark, [root]))).collect()}
    assert {n: r.is_text for n, r in info.items()} == {
        "a.PY": True, "bin": False, "noise": False, "none": True, "late": True,
    }
    assert info["a.PY"].extension == ".py" and info["a.PY"].size == 6 and info["bin"].extension == ""


def test_globs(spark):
    rows = [("/r/a/build",), ("/r/BUILD/x.py",), ("/r/a[1].py",), ("/r/ab.py",), ("/r/b.py",)]
    frame = spark.createDataFrame(rows, "file_path string")

    def kept(*globs):
        return [r.file_path for r in frame.where(pth.matches_any("file_path", globs)).collect()]

    assert kept("*/build") == ["/r/a/build"]
    assert kept("*/build/*") == ["/r/BUILD/x.py"]
    assert kept("*/?.py") == ["/r/BUILD/x.py", "/r/b.py"]
    assert kept("/r/[!a].py") == ["/r/b.py"]
    assert kept("*a[[]1].py") == ["/r/a[1].py"]
    assert kept("/r/[a-b][a-b].py") == ["/r/ab.py"]
    assert kept() == []


def test_excluded_directory_glob(spark):
    rows = [("/r", "/r/build/x.py"), ("/r", "/r/src/x.py"), ("/.r", "/.r/x.py"), ("/r", "/r/a/.b/c.py")]
    frame = spark.createDataFrame(rows, "root string, file_path string")
    kept = src.prune_dirs(frame, ScanOptions(exclude_patterns=("*/build",)))
    assert [r.file_path for r in kept.collect()] == ["/r/src/x.py", "/.r/x.py"]


def test_languages(spark):
    cases = {
        "a.py": "python", "a.TSX": "javascript", "x/Dockerfile": "dockerfile", "setup.cfg": "ini",
        ".env.local": "env", "a.unknown": None, "noext": "shell", ".bashrc": "shell", "a.": "shell",
    }
    frame = spark.createDataFrame([(p,) for p in cases], "file_path string").withColumn(
        "content", F.lit("#! /bin/zsh \nrest")
    )
    got = frame.select("file_path", pth.detect_language("file_path", "content").alias("l")).collect()
    assert {r.file_path: r.l for r in got} == cases
    assert ".ts" in pth.extensions_for("javascript") and ".ts" in pth.extensions_for("typescript")
    assert pth.is_supported_language("typescript") and not pth.is_supported_language("perl")


def test_safe_paths(spark):
    kept = ["src/main.py", "README.md", ".github/workflows/ci.yml", "docs/api/index.md"]
    dropped = [
        "../etc/passwd", "../../secret", ".././../config", "dir/../../../etc/shadow",
        "./../sensitive", "", None, ".gitignore", "/abs", "a//b", "a/",
    ]
    frame = spark.createDataFrame([(p,) for p in kept + dropped], "p string")
    got = [r[0] for r in frame.select(pth.sanitize_path("p")).collect()]
    assert got == kept + [None] * len(dropped)
    back = spark.createDataFrame([("src\\a.py",)], "p string")
    assert back.select(pth.sanitize_path("p")).first()[0] == "src/a.py"


def test_repository_tables(spark):
    wrapped = base64.encodebytes(("x = 1\n" * 40).encode()).decode()
    rows = [
        ("a.py", wrapped), ("../b.py", wrapped), ("c.bin", base64.b64encode(b"\xff\xfe").decode()),
        ("d.py", base64.b64encode(b"y" * 300).decode()), ("e.py", "%%%"),
    ]
    blobs = spark.createDataFrame(rows, "file_path string, blob string")
    kept = repos.decode_blobs(blobs, 240).collect()
    assert [(r.file_path, r.content) for r in kept] == [("a.py", "x = 1\n" * 40)]
    lost = {r.file_path: r.reason for r in repos.skipped_blobs(blobs, 240).collect()}
    assert lost == {"../b.py": "unsafe path", "c.bin": "not text", "d.py": "too large", "e.py": "not base64"}
    assert sorted(r.file_path for r in repos.decode_blobs(blobs).collect()) == ["a.py", "d.py"]


def test_redaction(spark):
    texts = [
        "mail a.b@c.org from 10.0.0.1", "sk-" + "a" * 48, "ghp_" + "B" * 36, "plain text",
        "key " + "Zz9" * 12, "ſk-" + "c" * 48, None,
    ]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in frame.select(txt.redact("t")).collect()]
    assert got[0] == "mail [REDACTED] from [REDACTED]" and got[3] == "plain text" and got[6] is None
    assert got[1].endswith("[REDACTED]") and "aaaa" not in got[1]
    assert "BBBB" not in got[2] and got[4] == "key [REDACTED]" and "cccc" not in got[5]


def text_of(folder):
    return "".join(path.read_text() for path in sorted(folder.glob("part-*")))


def test_written_files(spark, tmp_path):
    root = tree(tmp_path)
    files, findings = scan.scan_tree(spark, [root])
    record = scan.scan_records(files, findings, "s1", "2024-01-01 00:00:00", 1.25)
    record = record.withColumns({
        "repository_url": F.lit("https://code.example/x"), "branch": F.lit("main"),
        "commit_hash": F.lit(None).cast("string"),
    })
    keyed = findings.withColumn("scan_id", F.concat_ws(":", F.lit("s1"), "root"))
    sinks.write_json(record, keyed, str(tmp_path / "json"))
    [file] = (tmp_path / "json").glob("part-*/report-*.json")
    [document] = json.loads(file.read_text())
    assert document["files_scanned"] == files.count()
    assert len(document["vulnerabilities"]) == findings.count()
    assert document["vulnerabilities"][0]["location"]["line_number"] == 1
    assert document["vulnerabilities"][0]["metadata"] == {"regex_match": "md5("}
    sinks.write_sarif(record, keyed, str(tmp_path / "sarif"))
    [file] = (tmp_path / "sarif").glob("part-*/report-*.sarif.json")
    sarif = json.loads(file.read_text())
    run = sarif["runs"][0]
    assert sarif["version"] == "2.1.0" and len(run["tool"]["driver"]["rules"]) == 5
    assert len(run["results"]) == findings.count()
    assert run["invocations"][0]["startTimeUtc"] == "2024-01-01T00:00:00Z"
    assert run["invocations"][0]["endTimeUtc"] == "2024-01-01T00:00:01.250000Z"
    assert run["versionControlProvenance"] == [
        {"repositoryUri": "https://code.example/x", "branch": "main"}
    ]
    assert [a["location"]["uri"] for a in run["artifacts"]] == sorted(
        {r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for r in run["results"]}
    )
    sinks.export_csv(findings.select("file_path", "line_number", "references"), str(tmp_path / "tsv"), "\t")
    back = spark.read.option("header", True).option("sep", "\t").csv(str(tmp_path / "tsv"))
    assert back.columns == ["file_path", "line_number", "references"] and back.count() == findings.count()


def test_snapshot_has_no_secrets():
    options = ScanOptions(extra={
        "llm": {"model": "m", "api_key_env": "K", "max_tokens": 5}, "database": {"host": "h", "password": "p"},
    })
    kept = json.loads(config_snapshot(options))
    assert kept["llm"] == {"model": "m", "max_tokens": 5} and kept["database"] == {"host": "h"}
    assert kept["scanner"]["max_file_size_mb"] == 0
