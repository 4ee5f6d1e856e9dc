"""The source tree data source against the distributed listing, and as a stream."""

import os

import pytest
from pyspark.sql import functions as F

from sourcelode.operators.detect import with_language
from sourcelode.options import ScanOptions
from sourcelode.plans.scan import scan_tree
from sourcelode.sources import files as src, tree
from sourcelode.streaming.scans import stream_scan


@pytest.fixture
def roots(tmp_path):
    texts = {
        "a/x.py": "import hashlib\r\nh = hashlib.md5(a)\n", "a/_under.py": "obj = pickle.loads(d)", "a/.dot.py": "x = 1", "a/.git/no.py": "eval(x)",
        "a/node_modules/n.js": "eval(x)", "a/deep/er/still/y.js": "el.innerHTML = userInput", "b/z.ts": "const t = Math.random().toString(36);",
        "b/readme.md": "no", "b/empty.py": "", "b/sub/.hidden/q.py": "eval(x)", "a/ünï code.py": "é = 1",
    }
    for name, text in texts.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(text.encode())
    (tmp_path / "a" / "binary.py").write_bytes(b"\xff\xfe\x00")
    os.symlink(tmp_path / "a", tmp_path / "b" / "link")
    return [str(tmp_path / "a"), str(tmp_path / "b")]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_same_rows_as_a_scan(spark, roots):
    files, findings = scan_tree(spark, roots)
    read = with_language(tree.read_tree(spark, roots))
    columns = ("root", "file_path", "length", "content", "language")
    assert rows(read, *columns) == rows(files, *columns) and read.count() == 7
    found = stream_scan(read.drop("language"), keys=("root", "file_path"))
    assert rows(found, "id", "line_number") == rows(findings, "id", "line_number")
    small = ScanOptions(max_file_size_mb=20 / 1024 / 1024, include_patterns=("*.py", "*.md"))
    assert {os.path.basename(r[0]) for r in rows(tree.read_tree(spark, roots, small), "file_path")} == {".dot.py", "readme.md", "empty.py", "ünï code.py"}
    assert tree.read_tree(spark, [roots[0] + "/none"]).count() == 0


def test_filters_reach_the_listing(spark, roots):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        all_files = tree.read_tree(spark, roots)
        for condition in ("endswith(file_path, '.js')", "length < 20 AND file_path IS NOT NULL", "contains(file_path, 'x.py')", f"startswith(file_path, '{roots[1]}')"):
            want = [r for r in all_files.collect() if spark.createDataFrame([r], all_files.schema).where(condition).count()]
            assert rows(all_files.where(condition), "file_path") == sorted((r["file_path"],) for r in want) and want
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    found = tree.Tree({"path": roots[0]})
    reader = tree.FilteringTreeReader(found)
    left = list(reader.pushFilters([tree.StringEndsWith(("file_path",), ".js"), tree.EqualTo(("content",), "x"), tree.IsNotNull(("file_path",))]))
    assert left == [tree.EqualTo(("content",), "x")]
    assert [os.path.basename(f[1]) for p in reader.partitions() for f in p.files] == ["y.js"]


def test_what_cannot_be_read_has_a_reason(spark, roots, monkeypatch):
    found = tree.read_tree(spark, [*roots, roots[0] + "/none"], errors=True).where("error IS NOT NULL")
    assert {(os.path.basename(r["file_path"]), r["error"]) for r in found.collect()} == {("binary.py", "UnicodeDecodeError"), ("none", "FileNotFoundError")}


def test_groups_are_bounded(monkeypatch):
    monkeypatch.setattr(tree, "PART_BYTES", 100)
    monkeypatch.setattr(tree, "PART_FILES", 3)
    files = [("r", str(i), size, 0, None) for i, size in enumerate([10] * 7 + [500, 60, 60])]
    assert [len(p.files) for p in tree.Tree.parts(files)] == [3, 3, 1, 1, 1, 1] and tree.Tree.parts([]) == []


def test_files_that_arrive_are_scanned_once(spark, roots, tmp_path):
    base = tmp_path / "stream"

    def run():
        found = stream_scan(tree.stream_tree(spark, roots, str(base / "log")), keys=("root", "file_path"))
        query = (
            found.select("file_path", "vulnerability_type", "line_number").writeStream.format("parquet").option("path", str(base / "out"))
            .option("checkpointLocation", str(base / "checkpoint")).start()
        )
        query.processAllAvailable()
        return query

    def seen():
        return sorted((os.path.basename(r[0]), r[1], r[2]) for r in spark.read.parquet(str(base / "out")).collect())

    query = run()
    first = seen()
    assert ("x.py", "weak_crypto_md5", 2) in first and len(first) == len(set(first))
    with open(roots[1] + "/new.py", "w") as file:
        file.write("h = hashlib.md5(b)")
    query.processAllAvailable()
    query.stop()
    assert seen() == sorted([*first, ("new.py", "weak_crypto_md5", 1)])
    with open(roots[1] + "/later.py", "w") as file:  # while no stream runs
        file.write("h = hashlib.md5(c)")
    run().stop()
    run().stop()
    assert seen() == sorted([*first, ("new.py", "weak_crypto_md5", 1), ("later.py", "weak_crypto_md5", 1)])


def test_listing_tells_what_it_could_not_read(spark, roots):
    missing = roots[0] + "/none"
    listed = src.list_files(spark, [*roots, missing], problems=True)
    assert [(r["file_path"], r["error"]) for r in listed.where("error IS NOT NULL").collect()] == [(missing, "FileNotFoundError")]
    assert listed.where("error IS NULL").count() == src.list_files(spark, roots).count()
    paths = src.list_files(spark, roots).unionByName(src.file_table(spark, [missing + ".py"]))
    read = src.read_bytes(paths, problems=True)
    assert [(r["file_path"], r["error"]) for r in read.where("content IS NULL").collect()] == [(missing + ".py", "FileNotFoundError")]
    assert src.read_bytes(paths).count() == read.count() - 1


def test_a_folder_is_listed_entry_by_entry(tmp_path, monkeypatch):
    for n in range(20):
        (tmp_path / f"f{n}.py").write_text("x" * n)
    (tmp_path / "below").mkdir()
    (tmp_path / ".hidden").mkdir()
    (tmp_path / "gone").symlink_to(tmp_path / "none")
    (tmp_path / "linked").symlink_to(tmp_path / "below")
    seen, scandir = [], os.scandir

    class Counted:
        def __init__(self, top):
            self.found = scandir(top)

        def __enter__(self):
            return (seen.append(entry.name) or entry for entry in self.found)

        def __exit__(self, *_):
            self.found.close()

    monkeypatch.setattr(src.os, "scandir", Counted)
    entries = src.local_entries(str(tmp_path))
    first = next(entries)
    assert len(seen) <= 4  # no more than one file and what is passed over
    rest = {path.rpartition("/")[2]: (size, folder, error) for path, size, _, folder, error in [first, *entries]}
    assert rest == {f"f{n}.py": (n, False, None) for n in range(20)} | {"below": (None, True, None)}
    assert [e[-1] for e in src.local_entries(str(tmp_path / "none"))] == ["FileNotFoundError"]
    assert src.READ_BATCH_BYTES <= 8 * 1024 * 1024
