"""Exact top-k inner products by sorted lists read without random access."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Components whose code lies beyond this have no place in a long; their rows take no part.
LARGEST = 1 << 62
#: Depths to which the sorted lists are read, as shares of their length.
DEPTHS = (0.1, 0.25, 0.5, 0.75, 1.0)


def integer_codes(embedding, scale: float = 256.0):
    """floor(scale * x) of each component, x as double."""
    return F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def _usable(embedding, scale: float):
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < F.lit(float(LARGEST)))
    return embedding.isNotNull() & F.forall(embedding, good)


def _pack(rows_per_block: int):
    """Vectors of a task as blocks: ids and a matrix, padded with zeros to the longest vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, len(batch), rows_per_block):
                part = batch.slice(start, rows_per_block)
                vectors = part.column("codes").to_pylist()
                width = max(map(len, vectors))
                matrix = np.zeros((len(vectors), width), np.int64)
                for at, vector in enumerate(vectors):
                    matrix[at, : len(vector)] = vector
                ids = np.asarray(part.column("vec_id"), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ids.tobytes()], pa.binary()), pa.array([matrix.tobytes()], pa.binary()), pa.array([width], pa.int32())],
                    ["ids", "codes", "width"],
                )

    return run


class Block:
    """Candidates of one block with two sorted lists per component: by falling value, for positive
    weights, and by rising value, for negative ones."""

    def __init__(self, ids: bytes, codes: bytes, width: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.codes = np.frombuffer(codes, np.int64).reshape(len(self.ids), width)

    def lists(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of ``2 * width`` lists: every row's value, its place in the list, and the values in list order."""
        rows = np.pad(self.codes, ((0, 0), (0, width - self.codes.shape[1])))
        order = np.argsort(rows, axis=0, kind="stable")
        rising = np.take_along_axis(rows, order, axis=0)
        place = np.empty(rows.shape, np.int32)
        np.put_along_axis(place, order, np.arange(len(rows), dtype=np.int32)[:, None], axis=0)
        places = np.concatenate([len(rows) - 1 - place, place], axis=1)
        return np.concatenate([rows, rows], axis=1), places, np.concatenate([rising[::-1], rising], axis=1)


def _highest(queries: np.ndarray, rows: np.ndarray) -> int:
    """A bound of all sums of products."""
    largest = lambda x: max(int(x.max(initial=0)), -int(x.min(initial=0)))
    return largest(queries) * largest(rows) * max(1, queries.shape[1])


def _products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact integer products; floating matrix products while every sum stays below 2**53, Python
    integers where one may pass a long."""
    high = _highest(queries, rows)
    if high < 1 << 24:
        return (queries.astype(np.float32) @ rows.T.astype(np.float32)).astype(np.int64)
    if high < 1 << 53:
        return (queries.astype(np.float64) @ rows.T.astype(np.float64)).astype(np.int64)
    if high < 1 << 63:
        return queries @ rows.T
    return queries.astype(object) @ rows.T.astype(object)


class Search:
    """Running k best of one block of queries over candidate blocks that come one after another."""

    def __init__(self, ids: bytes, codes: bytes, width: int, k: int):
        self.ids = np.frombuffer(ids, np.int64)
        self.codes = np.frombuffer(codes, np.int64).reshape(len(self.ids), width)
        self.k = k
        #: The best (score, vec_id) of each query so far, scores as Python integers.
        self.best: list[list[tuple[int, int]]] = [[] for _ in self.ids]
        #: List entries read, and how many there were.
        self.read = self.entries = 0

    def floor(self) -> np.ndarray:
        """Score that an outsider has to reach, per query: its k-th best so far."""
        low = np.iinfo(np.int64).min
        return np.array([b[self.k - 1][0] if len(b) >= self.k else low for b in self.best], object)

    def add(self, block: Block) -> None:
        """No-random-access rounds over the block.

        The sorted lists are read from their tops, a stretch of all of them per round. A row's lower bound
        takes each list at its far end until the row is met in it; then the difference is added. Its upper
        bound takes lists in which it was not met at the value last read. The k-th largest
        lower bound, or the k-th best score of earlier blocks, is the floor; rows whose upper bounds are
        below those of all queries are no longer read. Reading stops as soon as few enough pairs are left, and
        these resolve their scores.
        """
        width = max(self.codes.shape[1], block.codes.shape[1])
        queries = np.pad(self.codes, ((0, 0), (0, width - self.codes.shape[1])))
        values, places, lists = block.lists(width)
        signed = np.concatenate([np.maximum(queries, 0), np.minimum(queries, 0)], axis=1)
        size, rows = len(block.ids), np.arange(len(block.ids))
        open_pairs = self.ids[:, None] != block.ids[None, :]
        self.entries += values.size
        if 4 * _highest(signed, values) < LARGEST:  # bounds fit a long; beyond that all pairs resolve
            far = lists[-1]
            floor = np.maximum(self.floor(), -(1 << 62)).astype(np.int64)
            lower = np.repeat(_products(signed, far[None, :]), size, axis=1)
            done = 0
            for share in DEPTHS:
                depth = max(1, int(np.ceil(share * size)))
                met = places[rows] < depth
                fresh = met & (places[rows] >= done)
                self.read += int(fresh.sum())
                lower += _products(signed, np.where(fresh, values[rows] - far, 0))
                if len(rows) > self.k:
                    own = np.where(open_pairs, lower, -(1 << 62))
                    floor = np.maximum(floor, np.partition(own, len(rows) - self.k, axis=1)[:, len(rows) - self.k])
                upper = lower + _products(signed, np.where(met, 0, lists[depth - 1] - far))
                open_pairs &= upper >= floor[:, None]
                keep = open_pairs.any(axis=0)
                rows, lower, open_pairs, done = rows[keep], lower[:, keep], open_pairs[:, keep], depth
                if open_pairs.sum() <= 0.02 * size * len(self.ids) + self.k * len(self.ids):
                    break
        for at in np.flatnonzero(open_pairs.any(axis=1)):
            left = rows[open_pairs[at]]
            scores = _products(queries[at : at + 1], values[left, :width])[0].tolist()
            found = sorted(zip((-s for s in scores), block.ids[left].tolist(), strict=True))[: self.k]
            self.best[at] = sorted([*self.best[at], *((-s, i) for s, i in found)], key=lambda x: (-x[0], x[1]))[: self.k]

    def rows(self) -> pa.RecordBatch:
        """The best of all queries; a score is ``high * 2**62 + low``."""
        found = [(query, vec, score >> 62, score & (LARGEST - 1)) for query, best in zip(self.ids.tolist(), self.best, strict=True) for score, vec in best]
        columns = zip(*found, strict=True) if found else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["query_id", "vec_id", "high", "low"])


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, search = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["q_ids"] != key:
                    if search is not None:
                        yield search.rows()
                    key, search = row["q_ids"], Search(row["q_ids"], row["q_codes"], row["q_width"], k)
                search.add(Block(row["ids"], row["codes"], row["width"]))
        if search is not None:
            yield search.rows()

    return run


def top_k(
    vectors: DataFrame, is_query, k: int = 5, scale: float = 256.0, query_rows: int = 256, candidate_rows: int = 512
) -> DataFrame:
    """The ``k`` highest integer inner products of every query row against all other rows.

    ``vectors`` needs ``vec_id`` and ``embedding``; other columns are not read. ``is_query`` is a
    condition on ``vec_id``. Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id, and a query with fewer than ``k`` candidates gets all of them.

    Rows with a NULL id, a NULL vector or a NULL or non-finite component take no part, nor do rows with a
    component whose code is no long. Sums are exact however large; a score that is no long is ranked by
    its value and returned as the nearest long. Rows of one
    vec_id count once, with the smallest vector. Shorter vectors are padded with zeros; an empty
    vector scores 0 with all. Without queries or candidates the result is empty.

    Queries and candidates are packed into blocks of bounded size; a grid of as many cells as the
    session has shuffle partitions meets every block of queries with every block of candidates
    once. Each cell reads the sorted component lists of a block (:meth:`Search.add`) and keeps k
    rows per query, so only k rows per query and cell are merged.
    """
    spark = vectors.sparkSession
    cells = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    across = max(1, int(cells**0.5 / 2))
    down = -(-cells // across)
    clean = (
        vectors.select("vec_id", "embedding").where(F.col("vec_id").isNotNull() & _usable(F.col("embedding"), scale))
        .groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        .select("vec_id", integer_codes(F.col("embedding"), scale).alias("codes"))
    )
    schema = "ids binary, codes binary, width int"
    # A block's place in the grid follows from its ids alone, so a repeated task repeats it.
    candidates = clean.mapInArrow(_pack(candidate_rows), schema)
    candidates = candidates.withColumn("down", F.pmod(F.xxhash64("ids"), F.lit(down))).withColumn(
        "across", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))
    )
    queries = clean.where(is_query).mapInArrow(_pack(query_rows), schema)
    queries = queries.withColumn("across", F.pmod(F.xxhash64("ids"), F.lit(across)).cast("int")).withColumn(
        "down", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(down - 1).cast("bigint")))
    )
    queries = queries.select("across", "down", *(F.col(c).alias(f"q_{c}") for c in ("ids", "codes", "width")))
    found = queries.join(candidates, ["across", "down"]).drop("across", "down").mapInArrow(
        _search(k), "query_id long, vec_id long, high long, low long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("high"), F.desc("low"), "vec_id")
    score = F.when(F.col("high") > 1, 2**63 - 1).when(F.col("high") < -2, -(2**63)).otherwise(F.shiftleft("high", 62) + F.col("low"))
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", score.cast("long").alias("score"))
    )
