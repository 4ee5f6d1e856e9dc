"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sourcelode.session import scratch_path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back: later steps neither repeat its work
    nor depend on the executors that did it."""
    spark: SparkSession = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(df: DataFrame) -> None:
    """Delete the folder of a table that :func:`written` made and nothing reads any more."""
    spark = df.sparkSession
    for name in {file.rpartition("/")[0] for file in df.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(name)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
