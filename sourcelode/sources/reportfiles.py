"""A data source that writes documents of many lines to files that parse alone."""

import json
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME = "report_files"
INDEX = "index.jsonl"
SHAPE = "scan_id string, part int, opens boolean, closes boolean, line string"


def _system(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class Gzipped:
    """A stream whose bytes are compressed on the way."""

    def __init__(self, stream):
        self.stream, self.packer = stream, zlib.compressobj(6, zlib.DEFLATED, 31)

    def write(self, data) -> None:
        self.stream.write(self.packer.compress(data))

    def close(self) -> None:
        self.stream.write(self.packer.flush())
        self.stream.close()


@dataclass
class Written(WriterCommitMessage):
    """The folder of one task, as it was written and as it shall be called."""

    folder: str
    name: str
    files: int


class ReportWriter(DataSourceArrowWriter):
    """Lines of documents, in order, become files of whole documents.

    Every attempt of a task writes a folder of its own below a staging folder of the job; the job's commit renames the folders of the
    attempts that Spark accepted, so neither a lost task nor a second attempt leaves a file in the result. Each folder has an
    index of its files: which document, or part of one, is where.
    """

    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")
        self.prefix, self.suffix, self.extension = options["prefix"], options["suffix"], options["extension"]
        self.file_bytes = int(options["filebytes"])
        self.gzip = {"none": False, "gzip": True}[options.get("compression", "none")]
        self.staging = f"_staging-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        system, path = _system(self.path)
        task = TaskContext.get().partitionId()
        name, folder = f"part-{task:05d}", f"{path}/{self.staging}/{task:05d}-{uuid.uuid4().hex}"
        stream = index = None
        files = size = 0

        def close():
            nonlocal stream
            if stream is not None:
                stream.write((self.suffix + "\n").encode())
                stream.close()
                stream = None

        try:
            for batch in iterator:
                lines = pc.binary_join_element_wise(
                    batch.column("line").cast(pa.large_string()), pc.if_else(batch.column("closes"), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string())), pa.scalar("", pa.large_string()),
                )
                if lines.null_count:
                    raise ValueError("a line of a report is NULL")
                data, ends = lines.buffers()[2], np.frombuffer(lines.buffers()[1], np.int64)[lines.offset : lines.offset + len(lines) + 1]
                opens = np.flatnonzero(batch.column("opens").to_numpy(zero_copy_only=False))
                scans, parts = batch.column("scan_id").take(pa.array(opens)).to_pylist(), batch.column("part").take(pa.array(opens)).to_pylist()

                def copy(start, stop):
                    nonlocal size
                    if stop > start:
                        stream.write(data[int(ends[start]) : int(ends[stop])])
                        size += int(ends[stop] - ends[start])

                # Lines before the first that opens a document belong to the one before.
                copy(0, opens[0] if len(opens) else len(lines))
                for scan, part, start, stop in zip(scans, parts, opens, [*opens[1:], len(lines)], strict=True):
                    if stream is not None:
                        if size >= self.file_bytes:
                            close()
                        else:
                            stream.write(b",\n")
                    if stream is None:
                        if index is None:
                            system.create_dir(folder, recursive=True)
                            index = system.open_output_stream(f"{folder}/{INDEX}")
                        files, size = files + 1, 0
                        file = f"report-{task:05d}-{files:05d}.{self.extension}{'.gz' if self.gzip else ''}"
                        stream = system.open_output_stream(f"{folder}/{file}", compression=None)
                        stream = Gzipped(stream) if self.gzip else stream
                        stream.write((self.prefix + "\n").encode())
                    index.write((json.dumps({"scan_id": scan, "part": part, "file": f"{name}/{file}"}) + "\n").encode())
                    copy(start, stop)
            close()
        finally:
            for left in (stream, index):
                if left is not None:
                    left.close()
        return Written(folder if files else "", name, files)

    def commit(self, messages) -> None:
        system, path = _system(self.path)
        system.create_dir(path, recursive=True)
        for message in messages:
            if message is not None and message.folder:
                system.move(message.folder, f"{path}/{message.name}")
        self._clean()

    def abort(self, messages) -> None:
        self._clean()

    def _clean(self) -> None:
        system, path = _system(self.path)
        if system.get_file_info(f"{path}/{self.staging}").type != fs.FileType.NotFound:
            system.delete_dir(f"{path}/{self.staging}")


class ReportFiles(DataSource):
    """Rows of ``SHAPE`` in writing order. Options: ``prefix`` and ``suffix`` (what stands around the documents of a file, which are
    separated by commas), ``extension``, ``compression`` (``none`` or ``gzip``), and ``fileBytes``: a file is closed behind the document
    that reaches it, so a document never begins in one file and ends in another."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SHAPE

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options)
