"""Target-distribution importance resampling: hashed feature gains, Gumbel noise, an exact cutoff by counting."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sourcelode.llm.storage import written
from sourcelode.llm.words import byte_words, slices

#: A-Z become a-z; every ASCII character that is neither letter nor digit ends a word.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
#: Halvings of the interval per count job: a job counts at all the places where they can cut.
HALVINGS = 4


def feature_buckets(text: bytes, shortest: int, longest: int, buckets: int) -> Iterator[tuple[np.ndarray, int]]:
    """Buckets of the features of a text, in bounded parts, each with the number of words it adds.

    A feature is a run of ``shortest`` to ``longest`` words joined by one space; its bucket is the
    unsigned crc32 of its bytes modulo ``buckets``.
    """
    before: list[bytes] = []
    for words in byte_words(text, _TABLE):
        found = []
        for n in range(shortest, longest + 1):
            if n == 1:
                found += map(zlib.crc32, words)
            else:
                run = before[len(before) - min(n - 1, len(before)) :] + words
                found += [zlib.crc32(b" ".join(run[at : at + n])) for at in range(len(run) - n + 1)]
        if longest > 1:
            before = (before + words)[-(longest - 1) :]
        yield np.array(found, np.int64) % buckets, len(words)


def _texts(column: pa.Array) -> Iterator[list[bytes]]:
    for start, stop in slices(column):
        yield [t or b"" for t in column.slice(start, stop - start).cast(pa.binary()).to_pylist()]


def bucket_counts(texts: DataFrame, shortest: int, longest: int, buckets: int) -> np.ndarray:
    """Features of all texts per bucket. Tasks count their own, Spark adds them; the driver gets at most
    ``buckets`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in _texts(batch.column(0)):
                for text in part:
                    for found, _ in feature_buckets(text, shortest, longest, buckets):
                        total += np.bincount(found, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], ["bucket", "n"])

    counts = np.zeros(buckets, np.int64)
    found = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for row in found.collect():
        counts[row["bucket"]] = row["n"]
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of how much likelier each bucket is in the target, both smoothed by one per bucket."""
    buckets, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array(
        [math.floor(1000 * math.log((t + 1) * (s_all + buckets) / ((s + 1) * (t_all + buckets)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)],
        np.int64,
    )


def weights(docs: DataFrame, gain: np.ndarray, shortest: int, longest: int) -> DataFrame:
    """doc_id, n_words, n_features and weight: the floored mean gain of a document's features, or 0."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            words, features, total = [], [], []
            for part in _texts(batch.column(1)):
                for text in part:
                    n = m = gained = 0
                    for found, more in feature_buckets(text, shortest, longest, len(known)):
                        n, m, gained = n + more, m + len(found), gained + int(known[found].sum())
                    words.append(n)
                    features.append(m)
                    total.append(gained // m if m else 0)
            columns = [batch.column(0), *(pa.array(c, pa.int64()) for c in (words, features, total))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _noise(seed: int):
    """floor(1000 * Gumbel noise) of a document, from the first 32 bits of a hash of seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def _last_reaching(rows: DataFrame, value, low: int, high: int, need: int, descending: bool) -> int:
    """The bound nearest to the good end (``high`` if ``descending``) at which at least ``need`` rows are
    on the good side of it, itself included.

    Bisection over whole numbers; each job counts at the 15 places where the next four halvings can
    cut, so the interval shrinks sixteenfold per pass over the stored column.
    """
    parts = 2**HALVINGS
    while low < high:
        cuts = sorted({low + (high - low) * at // parts for at in range(0 if not descending else 1, parts + (1 if descending else 0))})
        cuts = [c for c in cuts if (c > low if descending else c < high)]
        good = (lambda c: value >= F.lit(c)) if descending else (lambda c: value <= F.lit(c))
        counted = rows.agg(*(F.count(F.when(good(c), 1)).alias(f"c{at}") for at, c in enumerate(cuts))).first()
        enough = [c for at, c in enumerate(cuts) if counted[at] >= need]
        lacking = [c for at, c in enumerate(cuts) if counted[at] < need]
        if descending:
            low, high = max(enough, default=low), min(lacking, default=high + 1) - 1
        else:
            low, high = max(lacking, default=low - 1) + 1, min(enough, default=high)
    return low


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, buckets: int = 10_000,
    shortest: int = 1, longest: int = 1, seed: int = 2024,
) -> DataFrame:
    """Draw ``percent`` of the documents with at least ``least_words`` words, without replacement, so that
    their features resemble those of ``target``.

    ``docs`` needs doc_id and text, ``target`` text; other columns are not read. Returns doc_id,
    n_features, weight, score and rank of every row; a row that is not drawn has a NULL rank. A NULL text
    has no words and weight 0. A NULL doc_id is hashed as ``null`` and comes last among equal
    scores. Repeated rows are rows of their own with equal scores; where the cutoff parts rows that are
    equal in every returned column, any of them are drawn. An empty table gives no rows, an empty
    target gains that depend on ``docs`` alone.

    Scores are stored once. The cutoff among them is found by counting (:func:`_last_reaching`), first
    over scores, then over the ids that tie at that score. Only drawn rows are sorted: range
    partitions, the place in each, and the sizes of those before.
    """
    spark = docs.sparkSession
    gain = gains(bucket_counts(docs, shortest, longest, buckets), bucket_counts(target, shortest, longest, buckets))
    scored = weights(docs, gain, shortest, longest).withColumn("score", F.col("weight") + _noise(seed))
    scored = written(scored, "scores")
    pool = scored.where(F.col("n_words") >= least_words).select("doc_id", "score")
    seen = pool.agg(F.count("*").alias("n"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    need = seen["n"] * percent // 100
    drawn = F.lit(False)
    if need:
        cut = _last_reaching(pool, F.col("score"), seen["low"], seen["high"], need, descending=True)
        above = pool.where(F.col("score") > cut).count()
        tied = pool.where(F.col("score") == cut)
        ids = tied.agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).first()
        among = F.lit(True)  # with rows of NULL id, if the others do not suffice
        if ids["n"] >= need - above:
            among = F.col("doc_id") <= _last_reaching(tied, F.col("doc_id"), ids["low"], ids["high"], need - above, descending=False)
        drawn = (F.col("n_words") >= least_words) & ((F.col("score") > cut) | ((F.col("score") == cut) & F.coalesce(among, F.lit(False))))
    # The row's place in its task parts rows that are equal in all columns, however many.
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last(), F.asc("n_features"), F.asc("weight"), F.asc("at_")]
    chosen = scored.withColumn("at_", F.monotonically_increasing_id()).where(drawn)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # The id holds the number of the partition above 33 bits, below them the row's place in it.
    chosen = chosen.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place_", F.monotonically_increasing_id())
    chosen = written(chosen.withColumn("part_", F.shiftright("place_", 33)), "drawn")
    sizes = chosen.groupBy("part_").agg(F.count("*").alias("rows_"))  # a row per partition
    before = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part_", F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("before_"))
    place = F.col("before_") + F.col("place_").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    columns = ["doc_id", "n_features", "weight", "score"]
    ranked = chosen.join(F.broadcast(sizes), "part_").select(*columns, F.when(place <= need, place).cast("long").alias("rank"))
    return ranked.unionByName(scored.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))
