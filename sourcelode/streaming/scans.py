"""Detection on arriving files."""

from collections.abc import Iterator

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sourcelode.functions import text as txt
from sourcelode.functions.rules import BUILTIN_FAMILIES
from sourcelode.operators.detect import detect, with_language
from sourcelode.options import ScanOptions


def stream_scan(
    files: DataFrame, options: ScanOptions = ScanOptions(), families: tuple = BUILTIN_FAMILIES,
    keys=("file_path",),
) -> DataFrame:
    """Findings of a stream of (path, content) rows: no state, so append them as they come."""
    return detect(with_language(files, options), options, families, keys)


def stream_dedupe(files: DataFrame, time: str, delay: str, code: str = "content") -> DataFrame:
    """First occurrence of each code within ``delay``; state older than that is dropped.

    The code itself is replaced by its hash first: copies of one code meet in one task, as small
    rows, and the state holds hashes only.
    """
    hashed = files.withColumn("code_hash", txt.code_hash(code)).drop(code)
    return hashed.withWatermark(time, delay).dropDuplicatesWithinWatermark(["code_hash"])


class FirstSeen(StatefulProcessor):
    """Emits a code hash when it comes for the first time, and forgets it ``keep_ms`` of event time after it came last.

    Unlike a watermark's delay, which forgets a code that long after its first copy, a timer that every copy sets anew
    keeps codes that go on arriving; so the state holds the hashes of the last stretch of time, and a code that is
    always there is emitted once.
    """

    def __init__(self, keep_ms: int):
        self.keep_ms = keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.until = handle.getValueState("until", "until long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator:
        import pandas as pd

        last = first = None
        for frame in rows:
            times = frame["at_ms"].astype("int64")
            first = int(times.min()) if first is None else min(first, int(times.min()))
            last = int(times.max()) if last is None else max(last, int(times.max()))
        known = self.until.get()[0] if self.until.exists() else None
        until = max(known or 0, last + self.keep_ms)
        if known != until:
            if known is not None:
                self.handle.deleteTimer(known)
            self.handle.registerTimer(until)
            self.until.update((until,))
        shown = [] if known is not None else [(key[0], pd.Timestamp(first, unit="ms", tz="UTC"))]
        yield pd.DataFrame(shown, columns=["code_hash", "first_seen"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator:
        import pandas as pd

        self.until.clear()
        yield pd.DataFrame([], columns=["code_hash", "first_seen"])

    def close(self) -> None:
        pass


def stream_first_seen(files: DataFrame, time: str, keep_seconds: int, late: str = "0 seconds", code: str = "content") -> DataFrame:
    """(code_hash, first_seen) of codes that have not been seen for ``keep_seconds``, see :class:`FirstSeen`.

    ``late`` is how far rows may lag behind. The session needs the RocksDB state store. Rows are
    replaced by hash and time before they meet.
    """
    hashed = files.select(txt.code_hash(code).alias("code_hash"), F.col(time).alias("at"), F.unix_millis(F.col(time).cast("timestamp")).alias("at_ms"))
    return hashed.withWatermark("at", late).groupBy("code_hash").transformWithStateInPandas(
        FirstSeen(1000 * keep_seconds), "code_hash string, first_seen timestamp", "Append", "EventTime"
    )
