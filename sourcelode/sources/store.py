"""The scan history as versions of Parquet tables: every change is one new version."""

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sourcelode import schemas
from sourcelode.operators import history as his
from sourcelode.operators.summary import SEVERITIES
from sourcelode.functions.lookups import FINDING_LANGUAGES
from sourcelode.functions.paths import finding_language
from sourcelode.sources.manifests import Manifests

PERIOD = "scan_period"
UNDATED = date(1970, 1, 1)
# Times a change is made anew when another writer was faster.
ATTEMPTS = 5
# Periods so long that a task's rows of one fill a file; shorter ones are brought together first.
LONG_PERIODS = ("year", "yyyy", "yy", "quarter")


class Conflict(RuntimeError):
    """Other writers were faster ``ATTEMPTS`` times; nothing was changed."""


@dataclass(frozen=True)
class Stored:
    """A table of the store: what identifies a row, which columns name scans, what dates it."""

    schema: T.StructType
    identity: tuple
    stamp: str
    scans: tuple = ()
    sort: tuple = ()


TABLES = {
    "scan_records": Stored(schemas.SCAN_RECORDS, ("scan_id",), "scan_timestamp", ("scan_id",)),
    "vulnerability_records": Stored(
        schemas.VULNERABILITY_RECORDS, ("scan_id", "id"), "created_at", ("scan_id",), ("severity",)
    ),
    "scan_comparisons": Stored(
        schemas.SCAN_COMPARISONS, ("baseline_scan_id", "current_scan_id"), "comparison_timestamp",
        ("baseline_scan_id", "current_scan_id"),
    ),
    "usage_metrics": Stored(
        schemas.USAGE_METRICS, ("scan_id", "provider", "model"), "created_at", ("scan_id",)
    ),
    "pattern_usage": Stored(
        schemas.PATTERN_USAGE, ("pattern_name", "stats_period_start"), "stats_period_start"
    ),
}


@dataclass(frozen=True)
class Staged:
    """Rows written for a table in its layout, by period, which no version names yet."""

    name: str
    rows: DataFrame
    folder: str
    periods: frozenset


def _shaped(df: DataFrame, schema) -> DataFrame:
    """Columns of ``schema`` in its order and types; absent ones are NULL."""
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema
        ]
    )


def _matching(table: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on the columns of ``keys``; NULL equals NULL."""
    named = keys.select(*[F.col(name).alias(f"_{name}") for name in keys.columns])
    same = [F.col(name).eqNullSafe(F.col(f"_{name}")) for name in keys.columns]
    return table.join(named, reduce(lambda a, b: a & b, same), how)


class HistoryStore:
    """The tables of ``TABLES`` below one folder, by ``period`` (``month``, ``day``, ...), in versions.

    Data files are never changed. A version is a manifest that names, for each table and period, the folder with that
    period's rows. A change writes the periods it touches to a new folder and then makes the next manifest current in one
    atomic step, for all tables together: a driver that is lost before leaves files that no version names, one
    lost after has finished. A writer that finds its version taken makes its change anew on the newer one, so
    writers cannot overwrite each other. ``at`` gives a reader of one version, which stays as it is until
    :meth:`vacuum` removes it. Rows without a time are in the period of ``UNDATED``. The driver holds names of
    periods and folders, nothing that grows with the rows.
    """

    def __init__(self, spark: SparkSession, path: str, period: str = "month", version: int | None = None):
        self.spark, self.path, self.period, self.pinned = spark, path.rstrip("/"), period, version
        self.manifests = Manifests(spark, f"{self.path}/versions")

    # --- reading -----------------------------------------------------------------------------

    def versions(self) -> list[int]:
        return self.manifests.versions()

    def version(self) -> int:
        """The version that is read: the pinned or the latest one; 0 before the first change."""
        return self.pinned if self.pinned is not None else max(self.versions(), default=0)

    def at(self, version: int | None = None) -> "HistoryStore":
        """The store as it was in a version (the latest one if none is named); it cannot be changed."""
        return HistoryStore(self.spark, self.path, self.period, self.version() if version is None else version)

    def _read(self, content: dict, name: str, periods=None) -> DataFrame:
        fields = T.StructType([*TABLES[name].schema.fields, T.StructField(PERIOD, T.DateType())])
        held = content["tables"].get(name, {})
        paths = [f"{self.path}/data/{folder}/{name}/_at={period}" for period, folder in sorted(held.items()) if periods is None or period in periods]
        if not paths:
            return self.spark.createDataFrame([], fields)
        return self.spark.read.schema(fields).parquet(*paths)

    def table(self, name: str, periods=None) -> DataFrame:
        """A stored table, or some of its periods (dates or texts); empty when nothing has been written to it."""
        wanted = None if periods is None else {str(period) for period in periods}
        return self._read(self.manifests.read(self.version()), name, wanted)

    def scans(self) -> DataFrame:
        return self.table("scan_records")

    def findings(self) -> DataFrame:
        return self.table("vulnerability_records")

    # --- writing -----------------------------------------------------------------------------

    def _dated(self, rows: DataFrame, name: str) -> DataFrame:
        shaped = _shaped(rows, TABLES[name].schema)
        start = F.date_trunc(self.period, TABLES[name].stamp).cast("date")
        return shaped.withColumn(PERIOD, F.coalesce(start, F.lit(UNDATED)))

    def _staged(self, rows: DataFrame, name: str) -> Staged:
        """``rows`` in the shape of a table, written once, as the files of a version that may name them."""
        folder = uuid.uuid4().hex
        periods = self._write(self._dated(rows, name), name, folder)
        return Staged(name, self._read({"tables": {name: dict.fromkeys(periods, folder)}}, name), folder, frozenset(periods))

    def _remove(self, path: str) -> None:
        system, folder = self.manifests.folder(path)
        system.delete(folder, True)

    @staticmethod
    def _periods(rows: DataFrame) -> set:
        return {str(row[0]) for row in rows.select(PERIOD).distinct().collect()}

    def _write(self, rows: DataFrame, name: str, folder: str) -> set:
        """Write rows to a new folder, by period, and tell which periods they are of. Adaptive execution evens
        out the files of short periods: a busy one is split, quiet ones share tasks. Of ``LONG_PERIODS`` every task
        writes its own rows, without a shuffle."""
        path = f"{self.path}/data/{folder}/{name}"
        even = rows if self.period.lower() in LONG_PERIODS else rows.hint("rebalance", PERIOD)
        even = even.withColumn("_at", F.col(PERIOD)).sortWithinPartitions("_at", *TABLES[name].sort)
        even.write.partitionBy("_at").parquet(path)
        system, at = self.manifests.folder(path)
        return {s.getPath().getName().removeprefix("_at=") for s in system.listStatus(at) if s.getPath().getName().startswith("_at=")}

    def _replaced(self, content: dict, name: str, keys: DataFrame, fresh: Staged | None, folder: str) -> None:
        """Take out of a table the rows that match ``keys`` and add ``fresh`` ones: periods with such rows
        are written to ``folder``, and ``content`` names them. Fresh periods that have no other rows are named where they are."""
        held = content["tables"].get(name, {})
        added = fresh.periods if fresh is not None else frozenset()
        touched = added & held.keys()
        if held:
            touched |= self._periods(_matching(self._read(content, name), keys, "left_semi"))
        written = {}
        if touched:
            result = _matching(self._read(content, name, touched), keys, "left_anti")
            if touched & added:
                result = result.unionByName(fresh.rows.where(F.col(PERIOD).cast("string").isin(*touched)))
            written = dict.fromkeys(self._write(result, name, folder), folder)
        if touched or added:
            others = {period: at for period, at in held.items() if period not in touched}
            content["tables"][name] = others | written | {period: fresh.folder for period in added - touched}

    def _added(self, staged: list, make: Callable[[dict, str], None]) -> int:
        """:meth:`change` with staged rows; what the new version does not name of them is removed."""
        last = {}

        def noted(content, folder):
            last["tables"] = content["tables"]
            make(content, folder)

        try:
            version = self.change(noted)
        except Conflict:
            for fresh in staged:
                self._remove(f"{self.path}/data/{fresh.folder}")
            raise
        for fresh in staged:
            named = {period for period, folder in last["tables"].get(fresh.name, {}).items() if folder == fresh.folder}
            for period in fresh.periods - named if named else ():
                self._remove(f"{self.path}/data/{fresh.folder}/{fresh.name}/_at={period}")
            if not named:
                self._remove(f"{self.path}/data/{fresh.folder}")
        return version

    def change(self, make: Callable[[dict, str], None]) -> int:
        """Make the next version: ``make(content, folder)`` writes data below ``folder`` and changes the content of
        the latest manifest. If the number is taken meanwhile, the change is made anew. Returns the version."""
        if self.pinned is not None:
            raise ValueError(f"version {self.pinned} cannot be changed")
        for _ in range(ATTEMPTS):
            base, folder = self.version(), uuid.uuid4().hex
            content = self.manifests.read(base)
            before = json.dumps(content["tables"], sort_keys=True)
            make(content, folder)
            if json.dumps(content["tables"], sort_keys=True) == before:
                return base
            if self.manifests.create(base + 1, content):
                return base + 1
            self._remove(f"{self.path}/data/{folder}")
        raise Conflict(f"{ATTEMPTS} attempts to change {self.path} met other writers")

    def vacuum(self, keep: int = 10, grace_seconds: float = 86_400.0) -> int:
        """Remove all but the last ``keep`` versions, and data that none of them names. Folders younger than
        ``grace_seconds`` stay: a writer may be at work there. Returns the number of data folders removed."""
        versions = self.versions()
        for version in versions[: max(0, len(versions) - keep)]:
            self.manifests.delete(version)
        named = {folder.split("/")[0] for v in versions[-keep:] for held in self.manifests.read(v)["tables"].values() for folder in held.values()}
        system, at = self.manifests.folder(f"{self.path}/data")
        if not system.exists(at):
            return 0
        now, removed = self.spark._jvm.java.lang.System.currentTimeMillis(), 0
        for status in system.listStatus(at):
            if status.getPath().getName() not in named and now - status.getModificationTime() >= 1000 * grace_seconds:
                system.delete(status.getPath(), True)
                removed += 1
        return removed

    def put(self, name: str, rows: DataFrame) -> int:
        """Add rows to a table; a stored row with the same identity is replaced."""
        fresh = self._staged(rows, name)
        keys = fresh.rows.select(*TABLES[name].identity)
        return self._added([fresh], lambda content, folder: self._replaced(content, name, keys, fresh, folder))

    def save(self, scans: DataFrame, findings: DataFrame, persist_vulnerabilities: bool = True):
        """Store scans with their counts and languages, and the findings of those scans.

        Both tables change in one version. Saving a scan again replaces it and its findings. The finding's path and language come
        from its location. Findings of unknown scans are dropped by the join that brings the scan
        date. ``findings`` is evaluated once. Without ``persist_vulnerabilities`` only the scans
        are written; findings stored before stay.
        """
        scans = scans.withColumn("scan_id", F.col("scan_id").cast("string"))
        staged = []
        if persist_vulnerabilities:
            dates = scans.select("scan_id", F.col("scan_timestamp").alias("_at"))
            rows = findings.withColumn("scan_id", F.col("scan_id").cast("string")).join(dates, "scan_id")
            for name, value in (
                ("status", F.lit("open")),
                ("ai_analyzed", F.coalesce("ai_explanation", F.lit("")) != ""),
                ("explanation", F.col("ai_explanation")),
                ("false_positive_probability", F.col("false_positive_likelihood")),
                ("created_at", F.col("_at")),  # also dates the partition
                ("updated_at", F.col("_at")),
            ):
                if name not in rows.columns:
                    rows = rows.withColumn(name, value)
            staged.append(self._staged(rows, "vulnerability_records"))
            findings = staged[0].rows
        # A bit per language: numbers are aggregated in place, sets would have every row sorted.
        languages = sorted(set(FINDING_LANGUAGES.values()))
        bits = [F.when(F.col("_language") == name, F.lit(1 << at).cast("long")) for at, name in enumerate(languages)]
        has = lambda at: F.col("_languages").bitwiseAND(F.lit(1 << at).cast("long")) != 0
        facts = findings.withColumn("_language", finding_language("file_path")).groupBy(F.col("scan_id").cast("string").alias("scan_id")).agg(
            F.count(F.lit(1)).alias("total_vulnerabilities"),
            *[
                F.count_if(F.col("severity") == name).alias(f"{name.lower()}_count")
                for name in SEVERITIES
            ],
            F.bit_or(F.coalesce(*bits)).alias("_languages"),
        ).withColumn("languages_detected", F.array_compact(F.array(*[F.when(has(at), name) for at, name in enumerate(languages)]))).drop("_languages")
        derived = [name for name in facts.columns if name != "scan_id"]
        complete = (
            scans.drop(*derived).join(facts, "scan_id", "left")
            .na.fill(0, [name for name in derived if name != "languages_detected"])
            .withColumn(
                "languages_detected",
                F.coalesce("languages_detected", F.array().cast("array<string>")),
            )
        )
        if "id" not in complete.columns:
            complete = complete.withColumn("id", F.sha2("scan_id", 256))
        if "target_type" not in complete.columns:
            complete = complete.withColumn("target_type", F.lit("directory"))
        whole = self._staged(complete, "scan_records")
        staged.append(whole)

        def both(content, folder):
            if persist_vulnerabilities:
                self._replaced(content, "vulnerability_records", scans.select("scan_id"), staged[0], folder)
            self._replaced(content, "scan_records", whole.rows.select("scan_id"), whole, folder)

        return self._added(staged, both)

    def update_status(self, updates: DataFrame) -> int:
        """Apply status updates (``id, status, updated_at, seq, fixed_in_commit``), see
        :func:`history.update_status`; only periods with such findings are rewritten."""
        ids = updates.select(F.col("id").cast("string").alias("id"))

        def apply(content, folder):
            name = "vulnerability_records"
            touched = self._periods(_matching(self._read(content, name), ids, "left_semi"))
            if touched:
                written = self._write(his.update_status(self._read(content, name, touched), updates, "id"), name, folder)
                content["tables"][name].update({period: folder for period in written})

        return self.change(apply)

    def expire(self, as_of, days: int = 90, archive: "HistoryStore | None" = None) -> int:
        """Remove scans older than ``days`` before ``as_of`` with all rows that name them, in one version.

        With ``archive`` the rows are put there first, in one version of that store; a run that broke off can be
        repeated.
        """
        children = [name for name in TABLES if TABLES[name].scans and name != "scan_records"]
        steps = [(name, column) for name in (*children, "scan_records") for column in TABLES[name].scans]
        base = self.at()
        known = self.manifests.read(base.version())["tables"]
        old = his.expired_scans(base.scans(), as_of, days).select("scan_id")
        if archive is not None:
            # What is archived and what is removed come from the same version, so nothing slips between.
            moved = [
                archive._staged(_matching(base.table(name), old.select(F.col("scan_id").alias(column)), "left_semi"), name)
                for name, column in steps if known.get(name)
            ]

            def add(content, folder):
                for nth, fresh in enumerate(moved):
                    archive._replaced(content, fresh.name, fresh.rows.select(*TABLES[fresh.name].identity), fresh, f"{folder}/{nth}")

            archive._added(moved, add)

        def remove(content, folder):
            for nth, (name, column) in enumerate(steps):
                self._replaced(content, name, old.select(F.col("scan_id").alias(column)), None, f"{folder}/{nth}")

        return self.change(remove)

    def pattern_usage(self) -> DataFrame:
        """Rule counters over all stored periods, one row per rule."""
        return his.sum_pattern_usage(self.table("pattern_usage"))
