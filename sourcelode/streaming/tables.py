"""Tables kept up to date by streams, safe against retried batches."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from sourcelode.operators.history import pattern_usage
from sourcelode.sources.manifests import Manifests


def append_to(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Append a stream to a Parquet table exactly once."""
    return (
        stream.writeStream.outputMode("append").format("parquet")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


class StatusLog:
    """Status updates as a log of batches; readers apply the last one per finding.

    A batch is first reduced to one row per finding and written to a folder of its own; the next manifest then names it under
    the batch's number, so a retried batch replaces itself, and findings are never rewritten by the stream. When ``merge_every``
    batches have come together, they become one with a row per finding, and folders that the last two
    manifests do not name are removed: the log holds a row per finding and a few batches, however long the stream runs.
    """

    def __init__(self, spark: SparkSession, path: str, merge_every: int = 16):
        self.spark, self.path, self.merge_every = spark, path.rstrip("/"), merge_every
        self.manifests = Manifests(spark, f"{self.path}/versions")

    @staticmethod
    def _last(rows: DataFrame) -> DataFrame:
        """One row per finding; ``rows`` may be reduced ones already."""
        order = F.struct("updated_at", "seq")
        return rows.groupBy("finding_id").agg(
            F.max_by("status", order).alias("status"),
            F.max("updated_at").alias("updated_at"),
            F.max_by("seq", order).alias("seq"),
            F.max_by("fixed_in_commit", "commit_order").alias("fixed_in_commit"),
            F.max("commit_order").alias("commit_order"),
            F.max("fixed_at").alias("fixed_at"),
        )

    def _batches(self) -> dict:
        return self.manifests.read(max(self.manifests.versions(), default=0))["tables"].get("log", {})

    def _commit(self, change) -> None:
        while True:
            version = max(self.manifests.versions(), default=0)
            batches = change(dict(self.manifests.read(version)["tables"].get("log", {})))
            if self.manifests.create(version + 1, {"tables": {"log": batches}}):
                return

    def _read(self, folders) -> DataFrame:
        paths = [f"{self.path}/data/{folder}" for folder in sorted(folders)]
        return self.spark.read.parquet(*paths)

    def keep(self, batch: DataFrame, batch_id: int) -> None:
        order = F.struct("updated_at", "seq")
        fresh = uuid.uuid4().hex
        shaped = batch.withColumns({
            "commit_order": F.when(F.col("fixed_in_commit") != "", order),
            "fixed_at": F.when(F.col("status") == "fixed", F.col("updated_at")),
        })
        self._last(shaped).write.parquet(f"{self.path}/data/{fresh}")
        self._commit(lambda batches: batches | {str(batch_id): fresh})
        batches = self._batches()
        if len(batches) >= self.merge_every:
            merged = uuid.uuid4().hex
            self._last(self._read(batches.values())).write.parquet(f"{self.path}/data/{merged}")
            gone = set(batches)
            self._commit(lambda now: {k: v for k, v in now.items() if k not in gone} | {f"to-{batch_id}": merged})
        self._clean()

    def _clean(self) -> None:
        versions = self.manifests.versions()
        for version in versions[:-2]:
            self.manifests.delete(version)
        named = {f for v in versions[-2:] for f in self.manifests.read(v)["tables"].get("log", {}).values()}
        system, data = self.manifests.folder(f"{self.path}/data")
        for status in system.listStatus(data):
            if status.getPath().getName() not in named:
                system.delete(status.getPath(), True)

    def follow(self, updates: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        return (
            updates.writeStream.foreachBatch(self.keep).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )

    def updates(self) -> DataFrame:
        return self._read(self._batches().values())

    def current(self, findings: DataFrame, key: str = "finding_id") -> DataFrame:
        """Findings with every logged update applied."""
        if not self._batches():
            return findings
        latest = self._last(self.updates()).select(
            F.col("finding_id").alias(key), F.col("status").alias("_status"), F.col("updated_at").alias("_updated"),
            F.col("fixed_at").alias("_fixed_at"), F.col("fixed_in_commit").alias("_commit"),
        )
        changed = {
            "status": F.coalesce("_status", "status"),
            "fixed_at": F.coalesce("_fixed_at", "fixed_at"),
            "fixed_in_commit": F.coalesce("_commit", "fixed_in_commit"),
            "updated_at": F.coalesce("_updated", "updated_at"),
        }
        joined = findings.join(latest, key, "left")
        return joined.select(
            *[changed[c].alias(c) if c in changed else F.col(c) for c in findings.columns]
        )


class RuleCounters:
    """Rule counters as versions of a small table: the state has one row per rule."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def follow(self, findings: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
        path = self.path

        def keep(batch: DataFrame, batch_id: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/version={batch_id}")
            # Readers of the version before may still be at work; older ones go.
            at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
            for status in system.listStatus(at):
                number = status.getPath().getName().removeprefix("version=")
                if number.isdigit() and int(number) < batch_id - 1:
                    system.delete(status.getPath(), True)

        return (
            pattern_usage(findings).writeStream.outputMode("complete").foreachBatch(keep)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"availableNow": True})).start()
        )

    def current(self) -> DataFrame:
        versions = self.spark.read.parquet(self.path)
        newest = versions.select(F.max("version")).scalar()
        return versions.where(F.col("version") == newest).drop("version")
