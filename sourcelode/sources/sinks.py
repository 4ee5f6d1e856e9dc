"""Writing results as JSON, CSV and appended logs."""

import math

from pyspark.sql import DataFrame, SparkSession, functions as F

from sourcelode.operators.reports import HEAD, JSON_FIELDS, PLACE, SARIF_FIELDS, SARIF_FILE, TAIL, run_lines, scan_lines
from sourcelode.session import kept
from sourcelode.sources import reportfiles

# Findings of a document at most, and bytes after which a file is closed behind the document that reaches them.
PART_ROWS, FILE_BYTES = 50_000, 64 << 20
# Findings that a task sorts on average at most, and stored bytes that a task deals out: rows beyond a task's memory go to disk once more.
TASK_ROWS, DEALT_BYTES = 200_000, 16 << 20


def _write_documents(lines, fields: tuple, scans: DataFrame, findings: DataFrame, path: str, around: tuple, extension: str, file_bytes: int, part_rows: int, compression: str) -> None:
    """Documents of bounded size in files that hold whole documents.

    Findings are evaluated once, into the shared folder, with the ``fields`` that a document shows. A scan of more than ``part_rows`` findings is dealt over numbered parts by a
    hash of its findings, each a document of its own; so no document outgrows a task, and documents are
    dealt over tasks, in one shuffle, each of which sorts its own and writes them one after another.
    """
    spark = scans.sparkSession
    spark.dataSource.register(reportfiles.ReportFiles)
    # Spark knows the size of a read by the session only; the kept rows have one of their own.
    reader = spark.newSession()
    reader.conf.set("spark.sql.files.maxPartitionBytes", DEALT_BYTES)
    rows = kept(findings.select("scan_id", *PLACE, *fields), "findings", reader, **{"compression": "zstd", "parquet.block.size": DEALT_BYTES})
    counts = rows.groupBy("scan_id").agg(F.ceil(F.count(F.lit(1)) / part_rows).cast("int").alias("parts"))
    large = F.broadcast(counts.where("parts > 1"))  # at most a row per ``part_rows`` findings
    wide = scans.join(large, "scan_id", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    # Repeated rows are dealt over all parts of a scan, too.
    number = F.pmod(F.xxhash64("file_path", "line_number", "id", F.monotonically_increasing_id()), F.coalesce("parts", F.lit(1))).cast("int")
    parted = rows.join(large, "scan_id", "left").withColumn("part", number).drop("parts")
    # Columns of the scan itself go into its document, the numbers do not.
    documents = wide.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(rows.count() / TASK_ROWS))
    lined = lines(
        documents.drop("parts"), parted, ("scan_id", "part"), DataFrame.sortWithinPartitions, lambda dealt: dealt.repartition(tasks, "scan_id", "part"),
    )
    shown = lined.select(
        F.col("scan_id").cast("string").alias("scan_id"), "part", (F.col("section") == HEAD).alias("opens"), (F.col("section") == TAIL).alias("closes"), "line",
    )
    options = {"prefix": around[0], "suffix": around[1], "extension": extension, "fileBytes": str(file_bytes), "compression": compression}
    shown.write.format(reportfiles.NAME).mode("append").options(**options).save(path)


def write_json(scans: DataFrame, findings: DataFrame, path: str, file_bytes: int = FILE_BYTES, part_rows: int = PART_ROWS, compression: str = "none") -> None:
    """Scan results as JSON files, each a list of whole documents; of a scan with very many findings, of numbered parts.

    ``path`` has a folder per task with its files and an index (:func:`report_index`). ``file_bytes`` 1 gives every
    document a file, counted before compression. ``compression`` is ``none`` or ``gzip``: files end in ``.gz`` then, which Spark reads as
    they are, and what documents repeat, such as the rules in every SARIF run, takes little room. Findings of other scans are left out.
    """
    _write_documents(scan_lines, JSON_FIELDS, scans, findings, path, ("[", "]"), "json", file_bytes, part_rows, compression)


def write_sarif(scans: DataFrame, findings: DataFrame, path: str, file_bytes: int = FILE_BYTES, part_rows: int = PART_ROWS, compression: str = "none") -> None:
    """SARIF files, each a log of whole runs: one run per scan, or per numbered part of a scan with very many findings, named
    ``scan/part`` in its ``automationDetails``. Folders, index and compression as in :func:`write_json`."""
    _write_documents(run_lines, SARIF_FIELDS, scans, findings, path, SARIF_FILE, "sarif.json", file_bytes, part_rows, compression)


def report_index(spark: SparkSession, path: str) -> DataFrame:
    """Which document is in which file of a written report: scan_id, part, file."""
    found = spark.read.schema("scan_id string, part int, file string").option("recursiveFileLookup", "true")
    return found.option("pathGlobFilter", reportfiles.INDEX).json(path)


def export_csv(table: DataFrame, path: str, separator: str = ",") -> None:
    """CSV (or TSV) with a header; lists and maps are written as JSON."""
    flat = [
        F.to_json(field.name).alias(field.name)
        if field.dataType.typeName() in ("array", "map", "struct")
        else F.col(field.name)
        for field in table.schema
    ]
    table.select(*flat).write.option("header", True).option("sep", separator).csv(path)


def append_usage(usage: DataFrame, path: str, batch) -> None:
    """Add token usage rows to the log below ``path``.

    Every batch owns a folder: a batch that is written again replaces itself.
    """
    usage.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")
