"""Cells of vectors around pivots: which of them can hold similar vectors, by angles."""

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, types as T

from sourcelode.session import kept

# Vectors that pivots are chosen from, and pivots at most: what the driver and each task hold.
SAMPLE_ROWS = 4096
MOST_PIVOTS = 1024
# Angles are off by rounding, most where vectors are nearly equal.
SLACK = 1e-6


def unit_rows(values) -> np.ndarray:
    """Vectors of equal length as rows of length 1; a zero vector stays zero."""
    matrix = np.stack(list(values)).astype("float64")
    lengths = np.sqrt((matrix * matrix).sum(axis=1))
    return np.divide(matrix, lengths[:, None], out=np.zeros_like(matrix), where=lengths[:, None] > 0)


def angles(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(rows @ others.T, -1.0, 1.0))


def spread_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """``count`` rows of a sample, each as far from those before it as any row is."""
    chosen = [0]
    near = angles(sample, sample[:1])[:, 0]
    while len(chosen) < min(count, len(sample)):
        at = int(near.argmax())
        if near[at] <= SLACK:
            break
        chosen.append(at)
        near = np.minimum(near, angles(sample, sample[at : at + 1])[:, 0])
    return sample[chosen]


@dataclass(frozen=True)
class Cells:
    """Vectors with the number of their nearest pivot's cell, and the size and radius of every cell.

    ``rows`` holds (row id, ``vector`` as given, ``cell``); ``pivots``, ``radii`` and ``counts`` have a row per cell. Vectors of
    a length that no pivot has are in a cell of their own, numbered -1 - length, without a pivot.
    """

    rows: DataFrame
    row_id: str
    pivots: tuple
    radii: np.ndarray
    counts: np.ndarray
    others: dict

    def meet(self, theta: float) -> np.ndarray:
        """Which pairs of cells can hold two vectors within an angle: by the triangle inequality only
        those whose pivots are no further apart than both radii and the angle."""
        size = len(self.pivots)
        out = np.zeros((size, size), bool)
        lengths = np.array([len(p) for p in self.pivots])
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            pivots = np.stack([self.pivots[at] for at in own])
            most = self.radii[own][:, None] + self.radii[own][None, :] + theta + SLACK
            out[np.ix_(own, own)] = angles(pivots, pivots) <= most
        return out

    def compared(self, theta: float) -> tuple[int, int]:
        """Pairs of different rows that share a pair of cells that meet, and all pairs."""
        met = self.meet(theta).astype(object)
        counts = self.counts.astype(object)
        total = int(sum(self.counts)) + sum(self.others.values())
        within = int((counts @ met @ counts)) if len(counts) else 0
        within += sum(n * n for n in self.others.values())
        return (within - total) // 2, total * (total - 1) // 2


def make_cells(vectors: DataFrame, row_id: str, vec: str, cells: int | None = None, sample_rows: int = SAMPLE_ROWS) -> Cells:
    """Deal vectors into cells around pivots.

    The vectors are written once to the shared folder. Pivots are chosen on the driver from the ``sample_rows`` rows with
    the smallest hashes, about two per square root of the rows and at most ``MOST_PIVOTS`` (or ``cells``). Every row finds
    the nearest one in its task. Zero vectors, NULL and vectors with NULL or non-finite entries are left out: nothing is
    similar to them.
    """
    plain = vectors.select(F.col(row_id), F.col(vec).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = kept(plain.where(finite & F.exists("vector", lambda x: x != 0)), "vectors")
    sample = plain.select("vector", F.xxhash64(row_id).alias("h")).orderBy("h", "vector").limit(sample_rows).collect()
    rows = plain.count()  # of the written table, from its file footers
    wanted = min(MOST_PIVOTS, cells or max(8, int(2 * rows**0.5)))
    by_length: dict[int, list] = {}
    for row in sample:
        by_length.setdefault(len(row["vector"]), []).append(row["vector"])
    pivots: list = []
    for length in sorted(by_length):
        own = by_length[length]
        pivots += list(spread_pivots(unit_rows(own), max(1, wanted * len(own) // len(sample))))
    shared = plain.sparkSession.sparkContext.broadcast(tuple(pivots))  # at most MOST_PIVOTS vectors, and one per length
    shape = T.StructType([*plain.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def assign(batches):
        known = shared.value
        lengths = np.array([len(p) for p in known])
        groups = {n: (np.flatnonzero(lengths == n), np.stack([p for p in known if len(p) == n])) for n in set(lengths.tolist())}
        for batch in batches:
            size = batch["vector"].map(len).to_numpy()
            cell, away = -1 - size, np.zeros(len(batch))
            for n, (numbers, own) in groups.items():
                at = np.flatnonzero(size == n)
                if len(at):
                    apart = angles(unit_rows(batch["vector"].iloc[at]), own)
                    nearest = apart.argmin(axis=1)
                    cell[at], away[at] = numbers[nearest], apart[np.arange(len(at)), nearest]
            yield pd.DataFrame({row_id: batch[row_id], "vector": batch["vector"], "cell": cell, "angle": away}, columns=shape.names)

    # Finding the cell again costs less than storing it: one product with the pivots per batch.
    dealt = plain.mapInPandas(assign, shape)
    facts = dealt.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()
    radii, counts = np.zeros(len(pivots)), np.zeros(len(pivots), np.int64)
    for row in facts:
        if row["cell"] >= 0:
            radii[row["cell"]], counts[row["cell"]] = row["radius"], row["n"]
    others = {row["cell"]: row["n"] for row in facts if row["cell"] < 0}
    return Cells(dealt.drop("angle"), row_id, tuple(pivots), radii, counts, others)
