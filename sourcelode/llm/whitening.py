"""Whitening by Golub-Kahan-Lanczos bidiagonalisation of the centred rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelode.llm.storage import written

#: Bytes of entries per block of rows.
BLOCK_BYTES = 1 << 20
#: Entries whose x lies beyond this have no place in a long; their rows take no part.
LARGEST = float(1 << 62)
#: Lengths below this share of the largest one met are rounding.
NOTHING = 1e-13
LONG = np.iinfo(np.int64).max


def codes(embedding, scale: float, offset: int):
    """floor(scale * c) + offset of every entry, as long."""
    return F.transform(embedding, lambda c: F.floor(F.lit(scale) * c.cast("double")) + F.lit(offset).cast("long"))


def _usable(embedding, scale: float):
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double") * scale) < F.lit(LARGEST))
    return embedding.isNotNull() & F.forall(embedding, good)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task as blocks: ids, which of them are known, and a matrix of entries as wide as the longest row
    (``mask`` says which entries a row has)."""
    for batch in batches:
        lists = batch.column(1)
        widths = np.asarray(lists.value_lengths(), np.int64)
        flat, ends = np.asarray(lists.flatten(), np.int64), np.cumsum(widths)
        step = max(1, BLOCK_BYTES // (8 * max(1, int(widths.max(initial=1)))))
        for start in range(0, len(batch), step):
            own = widths[start : start + step]
            width = int(own.max())
            matrix, has = np.zeros((len(own), width), np.int64), np.arange(width) < own[:, None]
            matrix[has] = flat[ends[start] - own[0] : ends[start + len(own) - 1]]
            ids = batch.column(0).slice(start, len(own))
            values = [np.asarray(ids.fill_null(0), "<i8"), np.asarray(ids.is_valid()), matrix, own]
            yield pa.RecordBatch.from_arrays(
                [pa.array([v.tobytes()], pa.binary()) for v in values] + [pa.array([x], pa.int64()) for x in (len(own), width)],
                ["ids", "known", "x", "widths", "n", "width"],
            )


BLOCKS = "ids binary, known binary, x binary, widths binary, n long, width long"


def _matrix(row: dict, width: int, fill: int) -> np.ndarray:
    """Entries of a block, ``width`` wide; what a shorter row lacks is ``fill``, the code of 0."""
    x = np.frombuffer(row["x"], np.int64).reshape(row["n"], row["width"])
    out = np.full((row["n"], width), fill, np.int64)
    has = np.arange(row["width"]) < np.frombuffer(row["widths"], np.int64)[:, None]
    out[:, : row["width"]][has] = x[has]
    return out


class Centre:
    """Count and sums of the fit list; gives rows minus the mean, from exact differences."""

    def __init__(self, n: int, sums: list[int], fill: int):
        self.n, self.sums, self.fill = n, sums, fill

    def scaled(self, row: dict) -> np.ndarray:
        """n * x - S of every entry, exact: longs, or Python integers where these could overflow."""
        x = _matrix(row, len(self.sums), self.fill)
        largest = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * self.n + max(map(abs, self.sums), default=0)
        if largest > LONG:
            return x.astype(object) * self.n - np.array(self.sums, object)
        return x * self.n - np.array(self.sums, np.int64)

    def rows(self, row: dict) -> np.ndarray:
        return self.scaled(row).astype(np.float64) / self.n

    def deviations(self, row: dict) -> list[int]:
        """Sum over the entries of (n * x - S) ** 2, exact."""
        scaled = self.scaled(row)
        largest = int(np.abs(scaled).max(initial=0))
        if largest * largest * max(1, scaled.shape[1]) > LONG:
            scaled = scaled.astype(object)
        return [int(v) for v in (scaled * scaled).sum(axis=1)]


def _summed(blocks: DataFrame, make: Callable[[], Callable[[dict], np.ndarray]]) -> np.ndarray:
    """Sum over all blocks of what a function gives for each: tasks add their own, Spark the tasks'; the
    driver gets one number per slot, as many as the vectors are wide or pairs of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, total = make(), None
        for batch in batches:
            for row in batch.to_pylist():
                part = of(row)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total, pa.float64())], ["slot", "value"])

    rows = blocks.mapInArrow(run, "slot long, value double").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    return np.array([r["value"] for r in sorted(rows, key=lambda r: r["slot"])])


class Bidiagonal:
    """Lanczos bidiagonalisation A V = U B of the centred rows A.

    The long vectors u are never stored: each is A q for a short vector q, so a task has its part
    of every earlier u at hand as its rows times Q.
    """

    def __init__(self, blocks: DataFrame, centre: Centre, seed: int = 7):
        self.blocks, self.centre, self.width = blocks, centre, len(centre.sums)
        self.random = np.random.default_rng(seed)
        self.v, self.q, self.back = (np.zeros((self.width, 0)) for _ in range(3))
        self.alphas: list[float] = []
        self.betas: list[float] = []
        self.scale = 0.0

    def _products(self, q: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """|y|, Uᵀy and Aᵀy of y = A q, in one pass."""
        shared = self.blocks.sparkSession.sparkContext.broadcast((self.centre, self.q, q))  # width * steps numbers
        try:
            def make():
                centre, known, aim = shared.value

                def of(row: dict) -> np.ndarray:
                    rows = centre.rows(row)
                    y = rows @ aim
                    back = rows.T @ y
                    # Uᵀy = Qᵀ(Aᵀy), summed by block from the rows themselves.
                    return np.concatenate([[y @ y], (rows @ known).T @ y, back])

                return of

            sums = _summed(self.blocks, make)
        finally:
            shared.unpersist()
        return float(np.sqrt(sums[0])), sums[1 : 1 + self.q.shape[1]], sums[1 + self.q.shape[1] :]

    def _orthogonal(self, vector: np.ndarray) -> np.ndarray:
        for _ in range(2):
            vector = vector - self.v @ (self.v.T @ vector)
        return vector

    def _fresh(self) -> np.ndarray:
        vector = self._orthogonal(self.random.standard_normal(self.width))
        return vector / np.linalg.norm(vector)

    def run(self, steps: int) -> None:
        """Up to ``steps`` steps; fewer if the rest of the space holds nothing."""
        v, beta, fresh = self._fresh(), 0.0, True
        for step in range(steps):
            q = v - (beta * self.q[:, -1] if beta else 0.0)
            length, along, back = self._products(q)
            while np.linalg.norm(along) > 1e-9 * length > 0 and length > NOTHING * self.scale:
                # Too much of earlier u in it for one correction to be exact: take it out and go over the rows again.
                q = q - self.q @ along
                length, along, back = self._products(q)
            q, back = q - self.q @ along, back - self.back @ along
            alpha = float(np.sqrt(max(0.0, length * length - along @ along)))
            self.scale = max(self.scale, alpha)
            if alpha <= NOTHING * self.scale * np.sqrt(self.width):
                if fresh:  # a random direction of what is left has no length: neither has any other
                    break
                # This v adds no u; its column of B has only beta.
                alpha, q, back = 0.0, np.zeros(self.width), np.zeros(self.width)
            else:
                q, back = q / alpha, back / alpha
            self.v, self.q = np.column_stack([self.v, v]), np.column_stack([self.q, q])
            self.back = np.column_stack([self.back, back])
            self.alphas.append(alpha)
            if step + 1 == steps:
                break
            rest = self._orthogonal(back)
            beta, fresh = float(np.linalg.norm(rest)), False
            if beta <= NOTHING * self.scale * np.sqrt(self.width):
                beta, fresh, v = 0.0, True, self._fresh()
            else:
                v = rest / beta
            self.betas.append(beta)

    def components(self, most: int) -> tuple[np.ndarray, np.ndarray]:
        """Right singular vectors of A by falling singular value, and the values, as far as they are not nothing."""
        size = len(self.alphas)
        small = np.diag(self.alphas) + np.diag(self.betas[: max(0, size - 1)], 1) if size else np.zeros((0, 0))
        _, values, right = np.linalg.svd(small)
        keep = np.flatnonzero(values > 1e-10 * values.max(initial=0.0))[:most]
        if not len(keep):
            return np.zeros((self.width, 0)), np.zeros(0)
        vectors = self.v @ right[keep].T
        vectors /= np.linalg.norm(vectors, axis=0)
        largest = np.abs(vectors).argmax(axis=0)
        return vectors * np.sign(vectors[largest, np.arange(len(keep))]), values[keep]


RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(vectors: DataFrame, components: int = 32, scale: float = 64.0, offset: int = 1_000_000, steps: int | None = None) -> DataFrame:
    """Every vector on the first ``components`` principal components, each scaled to variance 1.

    ``vectors`` needs vec_id and embedding; other columns are not read. Entries c become the long
    x = floor(scale * c) + offset. All vectors without NULL or non-finite entries are the fit list
    (n rows, sums S); rows with an entry whose x is no long take no part either. Returns per row and component: vec_id,
    component (from 1, by falling eigenvalue), n, deviation (sum of (n * x - S) ** 2; NULL where it is no long),
    whitened, explained (share of the trace) and identity_error (largest entry of the whitened rows'
    covariance minus the identity, measured over all rows).

    Shorter vectors are filled up with zeros (c = 0). Repeated rows and rows of NULL id count as often as
    they are there. Components without variance are left out: equal rows, or a single one, give no
    result, as does an empty table.

    Rows are packed into blocks once. Each step of :class:`Bidiagonal` is one pass over the blocks, which
    multiplies them by v and the product by their transpose. ``steps`` is the number of passes; by
    default as many as the vectors are wide, which finds equal eigenvalues as often as they occur. For very wide
    vectors some multiple of ``components`` is enough when eigenvalues fall quickly.
    """
    clean = vectors.select(F.col("vec_id").cast("long"), "embedding").where(_usable(F.col("embedding"), scale))
    blocks = written(clean.select("vec_id", codes(F.col("embedding"), scale, offset).alias("x")).mapInArrow(_pack, BLOCKS), "blocks")
    size = blocks.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.max("width"), F.lit(0)).alias("width")).first()
    n, width = size["n"], size["width"]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                x = _matrix(row, width, offset)
                # Halves of 31 bits, so that no sum of a block passes a long.
                high, low = (x >> 31).sum(axis=0), (x & (2**31 - 1)).sum(axis=0)
                exact = [Decimal((int(h) << 31) + int(l)) for h, l in zip(high, low, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(exact, pa.decimal128(38, 0))], ["slot", "value"])

    found = blocks.mapInArrow(sums, "slot long, value decimal(38,0)").groupBy("slot").agg(F.sum("value").alias("value")).collect()
    centre = Centre(n, [int(r["value"]) for r in sorted(found, key=lambda r: r["slot"])], offset)
    lanczos = Bidiagonal(blocks, centre)
    if width:
        lanczos.run(min(width, steps or width))
    axes, values = lanczos.components(components)
    spread = blocks.sparkSession.sparkContext.broadcast((centre, axes * (np.sqrt(n) / values) if len(values) else axes))

    def measure():
        own, turned = spread.value

        def of(row: dict) -> np.ndarray:
            rows = own.rows(row)
            white = rows @ turned
            return np.concatenate([[(rows * rows).sum()], white.sum(axis=0), (white.T @ white).ravel()])

        return of

    count = len(values)
    totals = _summed(blocks, measure) if count else np.zeros(1)
    means = totals[1 : 1 + count] / max(1, n)
    covariance = totals[1 + count :].reshape(count, count) / max(1, n) - np.outer(means, means)
    error = float(np.abs(covariance - np.eye(count)).max(initial=0.0))
    explained = values**2 / totals[0] if count else values

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, turned = spread.value
        for batch in batches:
            for row in batch.to_pylist():
                white = own.rows(row) @ turned
                ids = pa.array(np.frombuffer(row["ids"], "<i8"), mask=~np.frombuffer(row["known"], bool))
                deviations = pa.array([d if d <= LONG else None for d in own.deviations(row)], pa.int64())
                for start in range(0, row["n"], step := 8192 // max(1, count) + 1):
                    part = white[start : start + step]
                    of = pa.array(np.repeat(np.arange(start, start + len(part)), count))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(of), pa.array(np.tile(np.arange(1, count + 1), len(part)), pa.int32()), pa.array(np.full(len(of), n), pa.int64()),
                         deviations.take(of), pa.array(part.ravel()), pa.array(np.tile(explained, len(part))), pa.array(np.full(len(of), error))],
                        [c.split(" ")[0] for c in RESULT.split(", ")],
                    )

    rows = blocks.mapInArrow(project, RESULT)
    return rows if count else rows.where(F.lit(False))
