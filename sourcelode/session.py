"""Where a job may put data that has to outlive an executor."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``. Only a local master, where
    driver and executors are one process, may fall back to a temporary folder.
    """
    configured = spark.conf.get(CHECKPOINT_CONF, None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_CONF} to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="sourcelode-")
    spark.conf.set(CHECKPOINT_CONF, folder)
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh folder name below the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def kept(df: DataFrame, label: str, reader: SparkSession | None = None, **options) -> DataFrame:
    """Write a frame to the shared folder and read it back: it is evaluated once, and later steps do
    not depend on the executors that did it. ``options`` are those of the Parquet writer; ``reader`` is a session with settings
    for reading."""
    path = scratch_path(df.sparkSession, label)
    df.write.options(**options).parquet(path)
    return (reader or df.sparkSession).read.schema(df.schema).parquet(path)
