"""Quality scores: logistic regression on hashed word n-grams, trained by follow the regularised leader."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelode.llm.words import SLICE_BYTES, U64, emptied, mix, ngram_hashes, slices, utf8, word_hashes

#: Weights are kept in 2**BITS buckets.
BITS = 18
#: Kinds of characters in a word's shape; runs of one kind count once.
_KIND = np.full(256, 7, np.uint8)
_KIND[128:] = 1
for _first, _last, _kind in (("a", "z", 1), ("A", "Z", 2), ("0", "9", 3)):
    _KIND[ord(_first) : ord(_last) + 1] = _kind
for _kind, _char in enumerate(".,;:!?'\"()-|#$%&*@=+_/\\<>{}[]~^", start=8):
    _KIND[ord(_char)] = _kind
_KIND[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0


def _shapes(column: pa.Array) -> pa.Array:
    """Every text with each character replaced by its kind and runs of a kind cut to one."""
    data, offsets = utf8(column)
    kinds = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    keep = np.ones(len(data), bool)
    keep[1:] = (kinds[1:] != kinds[:-1]) | edge[1:-1]
    upto = np.concatenate(([0], np.cumsum(keep)))
    letters = (kinds[keep] + 64).astype(np.uint8)
    letters[kinds[keep] == 0] = 0x20
    buffers = [None, pa.py_buffer(upto[offsets].astype(np.int64).tobytes()), pa.py_buffer(letters.tobytes())]
    return pa.Array.from_buffers(pa.large_string(), len(column), buffers)


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of the texts of a column as sorted buckets, values and row bounds.

    Features are single words, pairs of neighbours and that both words of a pair are equal, each
    as written (lower-cased) and as its shape. A row's values are square roots of counts, scaled to length 1; a row without words has
    none.
    """
    buckets, rows = [], []
    for kind, texts in enumerate((column, _shapes(column))):
        words, of = word_hashes(texts)
        for n in (1, 2):
            hashes, at = (words, of) if n == 1 else ngram_hashes(words, of, 2)
            buckets.append(mix(hashes + U64(8 * kind + n)) >> U64(64 - BITS))
            rows.append(at)
        # A pair of equal words is also a feature of its own, whatever the word.
        twice = np.flatnonzero((words[1:] == words[:-1]) & (of[1:] == of[:-1]))
        buckets.append(np.full(len(twice), 77 + kind, U64))
        rows.append(of[twice])
    keys = (np.concatenate(rows).astype(np.int64) << BITS) | np.concatenate(buckets).astype(np.int64)
    keys, counts = np.unique(keys, return_counts=True)
    bounds = np.searchsorted(keys, np.arange(len(column) + 1, dtype=np.int64) << BITS)
    values = np.sqrt(counts.astype(np.float64))
    squares = np.concatenate(([0.0], np.cumsum(values * values)))
    lengths = np.sqrt(np.maximum(squares[bounds[1:]] - squares[bounds[:-1]], 1e-12))
    return keys & ((1 << BITS) - 1), values / np.repeat(lengths, np.diff(bounds)), bounds


class Leader:
    """Per-coordinate follow-the-proximally-regularised-leader state of a logistic regression."""

    def __init__(self, alpha: float = 8.0, beta: float = 1.0, l1: float = 0.01, l2: float = 0.0):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        # The last coordinate is the intercept.
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        at, values = np.append(at, 1 << BITS), np.append(values, 1.0)
        weights = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(weights @ values, -35, 35))) - label) * values
        grown = self.n[at] + gradient * gradient
        self.z[at] += gradient - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.alpha * weights
        self.n[at] = grown


def _train_shard(epochs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        rows = rows.take(pa.array(np.lexsort((rows.column("label").to_numpy(), rows.column("key").to_numpy(zero_copy_only=False)))))
        leader, labels = Leader(), rows.column("label").to_numpy()
        texts = rows.column("text").combine_chunks()
        texts = texts if isinstance(texts, pa.Array) else texts.chunk(0)
        examples = []
        for start, stop in slices(texts):
            at, values, bounds = features(texts.slice(start, stop - start))
            for row in range(stop - start):
                own = slice(bounds[row], bounds[row + 1])
                examples.append((at[own].astype(np.int32), values[own].astype(np.float32), int(labels[start + row])))
        for _ in range(epochs):
            for example in examples:
                leader.learn(*example)
        weights = leader.weights()
        used = np.flatnonzero(weights)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(weights[used])], ["bucket", "weight"])

    return run


def train(labelled: DataFrame, docs: DataFrame, rows: int = 16384, shards: int = 4, epochs: int = 8) -> np.ndarray:
    """Weights from at most ``rows`` labelled documents: those with the smallest hashes of their id.

    ``labelled`` needs doc_id and label (0 or 1, others are not used; of several labels of one
    document the largest counts), ``docs`` doc_id and text; of several texts of one doc_id the first by
    order is learned from. The bound is the documented size of the training sample, whatever the table holds. It is
    dealt into ``shards`` groups that are trained on their own and averaged, so a task holds about ``rows / shards``
    texts.
    """
    known = labelled.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    known = known.withColumn("key", F.xxhash64("doc_id")).orderBy("key", "doc_id").limit(rows)
    # At most ``rows`` ids and labels are broadcast; tasks drop further texts of an id before the shuffle.
    texts = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(known), "doc_id")
    texts = texts.groupBy("doc_id", "key", "label").agg(F.min("text").alias("text")).withColumn("shard", F.pmod("key", F.lit(shards)))
    found = texts.select("key", "label", "text", "shard").groupBy("shard").applyInArrow(
        lambda table: pa.Table.from_batches(_train_shard(epochs)(iter(table.to_batches()))), "bucket long, weight double"
    )
    weights = np.zeros((1 << BITS) + 1)
    for row in found.groupBy("bucket").agg((F.sum("weight") / shards).alias("weight")).toLocalIterator():
        weights[row["bucket"]] = row["weight"]
    return weights


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id as text is a multiple of 5; a NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """``docs`` with ``quality_score`` (0 to 1): a sparse dot product of each whole text.

    A NULL text or one without words gets the intercept's score. Columns of this name in ``docs``
    are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    @F.arrow_udf("double")
    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value.astype(np.float64)
        with emptied():
            for texts in columns:
                sums = []
                for start, stop in slices(texts, SLICE_BYTES):
                    at, values, bounds = features(texts.slice(start, stop - start))
                    upto = np.concatenate(([0.0], np.cumsum(known[at] * values)))
                    sums.append(upto[bounds[1:]] - upto[bounds[:-1]])
                yield pa.array(1 / (1 + np.exp(-(np.concatenate([*sums, np.zeros(0)]) + known[-1]))))

    # Only texts go to Python, and only scores come back; not moved below a filter, which would score twice.
    return docs.withColumn("quality_score", scored.asNondeterministic()(F.col("text")))
