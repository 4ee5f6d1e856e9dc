"""Source trees as tables: list paths, filter them, read the text of the survivors.

Spark's file sources hide names starting with ``_`` or ``.``; trees are therefore listed and read
inside tasks through Arrow file systems (local mounts, HDFS, object stores).
"""

import os
import stat
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sourcelode.functions import paths as pth, text as txt
from sourcelode.options import ScanOptions
from sourcelode.schemas import PATHS
from sourcelode.session import scratch_path

# Bytes of files, and rows of a listing, that a task holds before it hands them on.
READ_BATCH_BYTES, LISTED_ROWS = 4 * 1024 * 1024, 10_000
EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
# Lasting states of a path: it is passed over. Any other error fails the task.
SKIPPED = (FileNotFoundError, PermissionError, IsADirectoryError, NotADirectoryError)


def _tasks(spark: SparkSession, tasks: int | None) -> int:
    return tasks or 4 * spark.sparkContext.defaultParallelism


def local_entries(top: str, skip=()):
    """(path, size, time, is a folder, error) of what is in a folder, one after the other: it may hold more files than fit in memory.

    Folders that are hidden, linked or fit a pattern of ``skip`` are left out, and so is what is neither file nor folder.
    """
    try:
        with os.scandir(top) as found:
            for entry in found:
                try:
                    facts = entry.stat()
                except FileNotFoundError:
                    continue
                full = top.rstrip("/") + "/" + entry.name
                if stat.S_ISREG(facts.st_mode):
                    yield full, facts.st_size, EPOCH + timedelta(microseconds=facts.st_mtime_ns // 1000), False, None
                elif stat.S_ISDIR(facts.st_mode) and not (entry.name.startswith(".") or entry.is_symlink() or any(p.match(full) for p in skip)):
                    yield full, None, None, True, None
    except SKIPPED as problem:
        yield top, None, None, False, type(problem).__name__


def list_files(
    spark: SparkSession, roots, options: ScanOptions = ScanOptions(), split_depth: int = 2,
    tasks: int | None = None, problems: bool = False,
) -> DataFrame:
    """All files below ``roots`` (a list, or a DataFrame with a ``root`` column).

    With ``problems`` there is an ``error`` column, and folders that could not be listed are rows with the reason.

    Listing goes in rounds of ``split_depth`` levels until no directory is left: the directories
    a round stops at are spread over ``tasks`` for the next one, so no subtree stays in one task.
    Rounds are written to the shared folder; a path is listed once, and stays listed when an
    executor is lost. Directories that are hidden or fit an exclude glob are not entered; linked
    directories are not followed.
    """
    if not isinstance(roots, DataFrame):
        roots = spark.createDataFrame([(root,) for root in roots], "root string")
    shape = "root string, file_path string, length long, modified timestamp, is_dir boolean, error string"
    prune = [pth.glob_regex(glob).replace(r"\z", r"\Z") for glob in options.exclude_patterns]

    def walk(batches):
        import os
        import re

        import pandas as pd
        from pyarrow import fs

        skip = [re.compile(pattern) for pattern in prune]

        def entries(top):
            if "://" not in top:
                yield from local_entries(top, skip)
                return
            system, path = fs.FileSystem.from_uri(top)
            try:
                found = system.get_file_info(fs.FileSelector(path, recursive=False))
            except SKIPPED as problem:
                yield top, None, None, False, type(problem).__name__
                return
            local = isinstance(system, fs.LocalFileSystem)
            for info in found:
                full = top.rstrip("/") + "/" + info.base_name
                if info.type == fs.FileType.File:
                    yield full, info.size, info.mtime, False, None
                elif info.type == fs.FileType.Directory:
                    hidden = info.base_name.startswith(".")
                    linked = local and os.path.islink(info.path)
                    if not (hidden or linked or any(p.match(full) for p in skip)):
                        yield full, None, None, True, None

        def framed(rows):
            frame = pd.DataFrame(rows, columns=["root", "file_path", "length", "modified", "is_dir", "error"])
            frame["length"] = frame["length"].astype("Int64")
            frame["modified"] = pd.to_datetime(frame["modified"], utc=True)
            return frame

        for batch in batches:
            rows = []
            for root, path in batch.itertuples(index=False):
                level = [path]
                for depth in range(1, split_depth + 1):
                    below = []
                    for top in level:
                        for full, size, mtime, directory, error in entries(top):
                            if directory and depth < split_depth:
                                below.append(full)
                            else:
                                rows.append((root, full, size, mtime, directory, error))
                            if len(rows) >= LISTED_ROWS:
                                yield framed(rows)
                                rows = []
                    level = below
            yield framed(rows)

    base = scratch_path(spark, "listing")
    level = roots.select("root", F.col("root").alias("file_path"))
    rounds = 0
    while True:
        path = f"{base}/round={rounds}"
        spread = level.repartition(_tasks(spark, tasks), "file_path")
        spread.mapInPandas(walk, shape).write.parquet(path)
        below = spark.read.schema(shape).parquet(path).where("is_dir")
        rounds += 1
        if below.isEmpty():
            break
        level = below.select("root", "file_path")
    listed = spark.read.schema(shape).parquet(*[f"{base}/round={n}" for n in range(rounds)])
    if problems:
        return listed.where("NOT is_dir").select(*PATHS.names, "error")
    return listed.where("NOT is_dir AND error IS NULL").select(*PATHS.names)


def file_table(spark: SparkSession, file_paths) -> DataFrame:
    """A path table for single files; a missing file simply has no text later."""
    rows = [(path.rsplit("/", 1)[0], path, None, None) for path in file_paths]
    return spark.createDataFrame(rows, PATHS)


def within_size(paths: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Drop files over the size limit, if one is set, and files whose size could not be read."""
    if options.max_bytes <= 0:
        return paths.where(F.col("length").isNotNull())
    return paths.where(F.col("length") <= options.max_bytes)


def exclude_paths(paths: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    return paths.where(~pth.excluded("file_path", options.exclude_patterns))


def include_paths(paths: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    return paths.where(pth.included("file_path", options.include_patterns))


def prune_dirs(paths: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Drop files below a hidden or excluded directory of their ``root``."""
    return paths.where(~pth.below_pruned_dir("file_path", "root", options.exclude_patterns))


def select_paths(paths: DataFrame, options: ScanOptions = ScanOptions()) -> DataFrame:
    """Every path test of a scan, decided before any content is read."""
    return include_paths(
        prune_dirs(exclude_paths(within_size(paths, options), options), options), options
    )


def cap_files(paths: DataFrame, limit: int, per: str | None = None) -> DataFrame:
    """The first ``limit`` files by path, of all or per value of ``per``; 0 keeps every file.

    Spark cuts each task's rows to ``limit`` per group before the shuffle.
    """
    if limit <= 0:
        return paths
    if per is None:
        return paths.orderBy("file_path").limit(limit)
    window = Window.partitionBy(per).orderBy("file_path")
    return paths.withColumn("_n", F.row_number().over(window)).where(F.col("_n") <= limit).drop("_n")


def read_bytes(paths: DataFrame, tasks: int | None = None, problems: bool = False) -> DataFrame:
    """Add the bytes of every file that exists and may be read, in batches of bounded size. With ``problems`` the others
    are rows without bytes and with an ``error``.

    Other errors, such as a store that answers too slowly, fail the task, which Spark repeats.
    """
    spark = paths.sparkSession
    shape = "root string, file_path string, length long, modified timestamp, content binary, error string"
    most = READ_BATCH_BYTES

    def read(batches):
        import pandas as pd
        from pyarrow import fs

        columns = ["root", "file_path", "length", "modified", "content", "error"]
        def framed(rows):
            frame = pd.DataFrame(rows, columns=columns)
            frame["length"] = frame["length"].astype("Int64")
            return frame

        rows, held = [], 0
        for batch in batches:
            for root, path, _, modified in batch.itertuples(index=False):
                try:
                    system, inner = fs.FileSystem.from_uri(path) if "://" in path else (
                        fs.LocalFileSystem(), path)
                    with system.open_input_stream(inner) as stream:
                        data = stream.read()
                except SKIPPED as problem:
                    rows.append((root, path, None, modified, None, type(problem).__name__))
                    continue
                rows.append((root, path, len(data), modified, data, None))
                held += len(data)
                if held > most:
                    yield framed(rows)
                    rows, held = [], 0
        if rows:
            yield framed(rows)

    # Only paths are moved here; spreading them keeps big files from meeting in one task.
    spread = paths.select(*PATHS.names).repartition(_tasks(spark, tasks), "file_path")
    found = spread.mapInPandas(read, shape)
    return found if problems else found.where("error IS NULL").drop("error")


def decode_text(files: DataFrame) -> DataFrame:
    """Strict UTF-8: undecodable files are dropped, line ends become ``\\n``, a BOM stays."""
    return files.where(F.is_valid_utf8(F.col("content").cast("string"))).withColumn(
        "content", txt.universal_newlines(F.col("content").cast("string"))
    )


def read_source(paths: DataFrame, tasks: int | None = None) -> DataFrame:
    return decode_text(read_bytes(paths, tasks))


def file_info(files: DataFrame) -> DataFrame:
    """Path, size, time, text flag, extension and name of files read as bytes."""
    return files.select(
        F.col("file_path").alias("path"),
        F.col("length").alias("size"),
        "modified",
        txt.is_text("content").alias("is_text"),
        F.lower(pth.suffix("file_path")).alias("extension"),
        pth.base_name("file_path").alias("name"),
    )
