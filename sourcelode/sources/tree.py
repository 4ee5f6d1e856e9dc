"""Source trees as a data source: ``spark.read.format("source_tree")`` and ``spark.readStream``."""

import json
import os
import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual,
    StringContains, StringEndsWith, StringStartsWith,
)
from pyspark.sql.types import StructType

from sourcelode.functions.paths import glob_regex
from sourcelode.options import ScanOptions
from sourcelode.sources.files import READ_BATCH_BYTES, SKIPPED

NAME = "source_tree"
SHAPE = "root string, file_path string, length long, modified timestamp, content string, error string"
# Bytes and files of a partition at most, and threads that list folders.
PART_BYTES, PART_FILES, LISTERS = 64 << 20, 1000, 16


def _system(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Part(InputPartition):
    """Files of one task: (root, path, length, modified in microseconds, error)."""

    files: list


class Tree:
    """Which files below the roots belong to a scan, by the options of the data source."""

    def __init__(self, options: dict):
        self.roots = json.loads(options["paths"]) if "paths" in options else [options["path"]]
        defaults = ScanOptions()
        given = lambda name, default: tuple(json.loads(options[name])) if name in options else default
        compiled = lambda globs: [re.compile(glob_regex(g).replace(r"\z", r"\Z")) for g in globs]
        self.include = compiled(given("include", defaults.include_patterns))
        self.exclude = compiled(given("exclude", defaults.exclude_patterns))
        self.max_bytes = int(options.get("maxbytes", 0))
        self.errors = options.get("errors", "false").lower() == "true"
        #: Tests on single files that filters of a query add.
        self.tests: list = []

    def _wanted(self, path: str, size: int) -> bool:
        if self.max_bytes and size > self.max_bytes or any(p.match(path) for p in self.exclude):
            return False
        if self.include and not any(p.match(path) for p in self.include):
            return False
        return all(test(path, size) for test in self.tests)

    def _entries(self, job: tuple) -> tuple[list, list]:
        """Files and further folders of one folder."""
        root, top = job
        system, path = _system(top)
        try:
            found = system.get_file_info(fs.FileSelector(path, recursive=False))
        except SKIPPED as error:
            return ([(root, top, None, None, type(error).__name__)] if self.errors else []), []
        local, files, folders = isinstance(system, fs.LocalFileSystem), [], []
        for info in found:
            full = top.rstrip("/") + "/" + info.base_name
            if info.type == fs.FileType.File:
                if self._wanted(full, info.size):
                    files.append((root, full, info.size, info.mtime_ns // 1000 if info.mtime_ns is not None else None, None))
            elif info.type == fs.FileType.Directory:
                linked = local and os.path.islink(info.path)
                if not (info.base_name.startswith(".") or linked or any(p.match(full) for p in self.exclude)):
                    folders.append((root, full))
        return files, folders

    def files(self) -> list:
        """All wanted files by path; folders are listed by several threads at once."""
        out, level = [], [(root, root) for root in self.roots]
        with ThreadPoolExecutor(LISTERS) as pool:
            while level:
                following = []
                for files, folders in pool.map(self._entries, level):
                    out += files
                    following += folders
                level = following
        return sorted(out, key=lambda f: (f[0], f[1]))

    @staticmethod
    def parts(files: list) -> list[Part]:
        """Files in groups of bounded bytes; a large file is a group of its own."""
        parts, held, size = [], [], 0
        for file in files:
            if held and (size + (file[2] or 0) > PART_BYTES or len(held) >= PART_FILES):
                parts.append(Part(held))
                held, size = [], 0
            held.append(file)
            size += file[2] or 0
        return [*parts, Part(held)] if held else parts

    def read(self, part: Part | None):
        """The texts of a group's files: strict UTF-8, line ends as ``\\n``. Files that are gone, unreadable or no text are
        left out, or have an ``error`` with the option ``errors``."""
        if part is None:  # a listing without files is one empty task
            return
        names = ["root", "file_path", "length", "modified", "content", "error"]
        types = [pa.string(), pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.string(), pa.string()]
        rows, held = [], 0
        for root, path, length, modified, error in part.files:
            text = None
            if error is None:
                try:
                    system, inner = _system(path)
                    with system.open_input_stream(inner) as stream:
                        text = stream.read().decode("utf-8").replace("\r\n", "\n").replace("\r", "\n")
                except SKIPPED as problem:
                    error = type(problem).__name__
                except UnicodeDecodeError:
                    error = "UnicodeDecodeError"
            if error is None or self.errors:
                rows.append((root, path, length, modified, text, error))
                held += len(text or "")
            if held > READ_BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)


def _test(condition):
    """A filter of a query as a test on path and length, or None if this source cannot apply it."""
    value = getattr(condition, "value", None)
    path = {
        EqualTo: lambda p, _: p == value, In: lambda p, _: p in value, StringStartsWith: lambda p, _: p.startswith(value),
        StringEndsWith: lambda p, _: p.endswith(value), StringContains: lambda p, _: value in p,
    }
    length = {EqualTo: lambda _, n: n == value, LessThan: lambda _, n: n < value, LessThanOrEqual: lambda _, n: n <= value}
    tests = {("file_path",): path, ("length",): length}.get(condition.attribute, {})
    return tests.get(type(condition))


class TreeReader(DataSourceReader):
    def __init__(self, tree: Tree):
        self.tree = tree

    def partitions(self):
        return Tree.parts(self.tree.files())

    def read(self, partition):
        return self.tree.read(partition)


class FilteringTreeReader(TreeReader):
    """Spark accepts a reader with this method only where filter pushdown is switched on."""

    def pushFilters(self, filters):
        """Tests on path and length are made while listing, so other files are not opened."""
        for condition in filters:
            test = _test(condition)
            if test is not None and not self.tree.errors:
                self.tree.tests.append(test)
            elif not (isinstance(condition, IsNotNull) and condition.attribute in (("file_path",), ("root",))):
                yield condition


class TreeStream(DataSourceStreamReader):
    """Offsets are numbers of listings. A listing writes the files it is the first to see (by path, time and size) to a log,
    which tells after a restart what has been seen, and what a batch consists of."""

    def __init__(self, tree: Tree, log: str):
        self.tree, (self.system, self.log) = tree, _system(log)
        self.seen, self.last = set(), 0
        self.system.create_dir(self.log, recursive=True)
        for info in self.system.get_file_info(fs.FileSelector(self.log)):
            if info.base_name.endswith(".json"):
                number = int(info.base_name.removesuffix(".json"))
                self.last = max(self.last, number)
                self.seen.update(tuple(f[1:4]) for f in self._logged(number))

    def _file(self, number: int) -> str:
        return f"{self.log}/{number:012d}.json"

    def _logged(self, number: int) -> list:
        with self.system.open_input_stream(self._file(number)) as stream:
            return [tuple(f) for f in json.loads(stream.read())]

    def initialOffset(self):
        return {"listing": 0}

    def latestOffset(self):
        fresh = [f for f in self.tree.files() if tuple(f[1:4]) not in self.seen]
        if fresh:
            number = self.last + 1
            with self.system.open_output_stream(f"{self.log}/.{number}") as stream:
                stream.write(json.dumps(fresh).encode())
            self.system.move(f"{self.log}/.{number}", self._file(number))
            self.seen.update(tuple(f[1:4]) for f in fresh)
            self.last = number
        return {"listing": self.last}

    def partitions(self, start, end):
        files = [f for number in range(start["listing"] + 1, end["listing"] + 1) for f in self._logged(number)]
        return Tree.parts(files)

    def read(self, partition):
        return self.tree.read(partition)

    def commit(self, end):
        pass


class SourceTree(DataSource):
    """Text files below one or more roots, hidden names of files included, as rows of ``SHAPE``.

    Options: ``include`` and ``exclude`` (JSON lists of globs, by default those of a scan), ``maxBytes`` (0: none), ``errors``
    (also rows for what could not be read, with the reason), and for streams ``log``, a folder of the stream's own. Hidden
    or excluded folders are not entered, linked ones not followed. The listing is held on the driver, as Spark's own file
    sources do; for trees beyond that use ``list_files``. With the option ``pushdown``, for which
    ``spark.sql.python.filterPushdown.enabled`` has to be set, conditions on path and length are applied before files are opened.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SHAPE

    def reader(self, schema: StructType) -> TreeReader:
        kind = FilteringTreeReader if self.options.get("pushdown", "false").lower() == "true" else TreeReader
        return kind(Tree(self.options))

    def streamReader(self, schema: StructType) -> TreeStream:
        return TreeStream(Tree(self.options), self.options["log"])


def _options(options: ScanOptions) -> dict:
    return {
        "include": json.dumps(options.include_patterns), "exclude": json.dumps(options.exclude_patterns), "maxBytes": str(int(options.max_bytes)),
    }


def read_tree(spark: SparkSession, roots: list[str], options: ScanOptions = ScanOptions(), errors: bool = False) -> DataFrame:
    spark.dataSource.register(SourceTree)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    reader = spark.read.format(NAME).option("pushdown", pushdown).options(**_options(options)).option("paths", json.dumps(list(roots)))
    return reader.option("errors", str(errors).lower()).load()


def stream_tree(spark: SparkSession, roots: list[str], log: str, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Files as they arrive or change; each version of a file once."""
    spark.dataSource.register(SourceTree)
    return spark.readStream.format(NAME).options(**_options(options)).option("paths", json.dumps(list(roots))).option("log", log).load()
