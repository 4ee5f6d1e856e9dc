"""A stored index over embeddings: inverted lists around centroids, probed or searched exactly."""

import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from sourcelode.functions.vectors import cosine
from sourcelode.operators.cells import SLACK, Cells, angles, spread_pivots, unit_rows
from sourcelode.operators.similar import BLOCK_ROWS, LEAST_BLOCK_ROWS, MOST_TASKS, SCORED, THRESHOLD, TOP, _blocks_of
from sourcelode.schemas import CODE_EMBEDDINGS
from sourcelode.session import kept, scratch_path

# Vectors that centroids are fitted on, centroids at most, and rounds of the fit.
SAMPLE_ROWS, MOST_LISTS, FIT_ROUNDS = 16_384, 1024, 8


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = FIT_ROUNDS) -> np.ndarray:
    """Unit centroids of a sample: spread pivots, moved to the mean direction of their rows a few times."""
    centres = spread_pivots(sample, lists)
    for _ in range(rounds):
        nearest = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        lengths = np.sqrt((sums * sums).sum(axis=1))
        centres = np.where(lengths[:, None] > 0, sums / np.maximum(lengths, 1e-300)[:, None], centres)
    return centres


# What a product of unit vectors is off by at most, and lengths whose products neither overflow nor vanish.
OFF, SHORTEST, LONGEST = 1e-9, 1e-140, 1e140


def lengths_of(rows: np.ndarray) -> np.ndarray:
    """Lengths of the rows, added up entry by entry as :func:`~sourcelode.functions.vectors.norm` does."""
    total = np.zeros(len(rows))
    for column in rows.T:
        total = total + column * column
    return np.sqrt(total)


def best_pairs(aims: np.ndarray, aimed: np.ndarray, rows: np.ndarray, lists: np.ndarray, threshold: float, top: int):
    """(query, row, cosine) of the ``top`` rows of every query that reach ``threshold``, ties to earlier rows, chunk by chunk.

    Query q meets the rows of list n if ``aimed[q, n]``. A product of unit vectors finds the pairs that may count; their cosine is
    then added up as :func:`~sourcelode.functions.vectors.cosine` does, to the last bit, NaN above all numbers.
    """
    # Of equal vectors only the first ``top`` can be in a result.
    own = [row.tobytes() for row in rows]
    first = np.flatnonzero(pd.Series(own).groupby(own).cumcount().to_numpy() < top)
    rows, lists = rows[first], lists[first]
    aim_lengths, row_lengths = lengths_of(aims), lengths_of(rows)
    odd_aims, odd_rows = (~((n >= SHORTEST) & (n <= LONGEST)) for n in (aim_lengths, row_lengths))
    units = [np.where(odd[:, None], 0.0, m / np.where(odd, 1.0, n)[:, None]) for m, n, odd in ((aims, aim_lengths, odd_aims), (rows, row_lengths, odd_rows))]
    aim_columns, row_columns = np.ascontiguousarray(aims.T), np.ascontiguousarray(rows.T)
    step = max(1, SCORED // len(rows))
    for start in range(0, len(aims), step):
        part = slice(start, start + step)
        met = aimed[part][:, lists]
        scores = units[0][part] @ units[1].T
        scores[~met] = -2.0
        near = scores >= threshold - OFF
        many = np.flatnonzero(near.sum(axis=1) > 4 * top)
        if len(many):
            least = -np.partition(-scores[many], top - 1, axis=1)[:, top - 1]
            near[many] &= scores[many] >= least[:, None] - 2 * OFF
        near[:, odd_rows] = met[:, odd_rows]
        near[odd_aims[part]] = met[odd_aims[part]]
        query, row = np.nonzero(near)
        query += start
        dot = np.zeros(len(query))
        for left, right in zip(aim_columns, row_columns):
            dot = dot + left[query] * right[row]
        both = aim_lengths[query] * row_lengths[row]
        value = np.where((both > 0) | np.isnan(both), dot / both, 0.0)
        kept = (value >= threshold) | np.isnan(value)
        query, row, value = query[kept], row[kept], value[kept]
        order = np.lexsort((row, -np.nan_to_num(value, nan=0.0), ~np.isnan(value), query))
        query, row, value = query[order], row[order], value[order]
        kept = np.arange(len(query)) - np.searchsorted(query, query) < top
        yield query[kept], first[row[kept]], value[kept]


class VectorIndex:
    """Embeddings (``CODE_EMBEDDINGS``) below one folder, one Parquet partition per list.

    Every row is in the list of its nearest centroid; ``lists.json`` has the centroids with the number of rows and the
    largest angle (radius) of each list, a bounded table. A search reads the partitions of the lists it probes and no
    others. With ``exact`` it goes on to every list that may hold a better row by the triangle inequality, so the result
    equals a scan of all rows.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    # --- building ----------------------------------------------------------------------------

    def build(self, embeddings: DataFrame, lists: int | None = None, sample_rows: int = SAMPLE_ROWS, rounds: int = FIT_ROUNDS) -> "VectorIndex":
        """Fit centroids on the ``sample_rows`` rows with the smallest hashes and store every row.

        ``embeddings`` needs code_hash and embedding. Vectors that are NULL, zero, have NULL or non-finite entries or
        another length than most of the sample are in list -1, which every search reads. About one list per
        square root of the rows, ``MOST_LISTS`` at most.
        """
        columns = [
            (F.col(f.name) if f.name in embeddings.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CODE_EMBEDDINGS
        ]
        rows = kept(embeddings.select(*columns), "embeddings")
        good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
        sample = rows.where(good).select("embedding", F.xxhash64("code_hash").alias("h")).orderBy("h", "embedding").limit(sample_rows).collect()
        widths = [len(r["embedding"]) for r in sample]
        width = max(set(widths), key=lambda n: (widths.count(n), n)) if widths else 0
        units = unit_rows(r["embedding"] for r in sample if len(r["embedding"]) == width) if sample else np.zeros((0, 0))
        wanted = min(MOST_LISTS, lists or max(1, round(rows.count() ** 0.5)))
        centres = fit_centroids(units, wanted, rounds) if len(units) else units
        shared = self.spark.sparkContext.broadcast(centres)  # at most MOST_LISTS vectors
        shape = T.StructType([*rows.schema.fields, T.StructField("angle", T.DoubleType()), T.StructField("list", T.IntegerType())])

        def place(batches):
            known = shared.value
            for batch in batches:
                batch = batch.assign(angle=0.0, list=-1)
                fits = [v is not None and len(v) == width and bool(np.isfinite(np.asarray(v, float)).all()) and bool(np.any(np.asarray(v, float))) for v in batch["embedding"]]
                at = np.flatnonzero(fits) if len(known) else []
                if len(at):
                    apart = angles(unit_rows(batch["embedding"].iloc[at]), known)
                    nearest = apart.argmin(axis=1)
                    batch.iloc[at, batch.columns.get_loc("list")] = nearest
                    batch.iloc[at, batch.columns.get_loc("angle")] = apart[np.arange(len(at)), nearest]
                yield batch[shape.names]

        placed = rows.mapInPandas(place, shape).hint("rebalance", "list")
        placed.write.mode("overwrite").partitionBy("list").parquet(f"{self.path}/vectors")
        stored = self._vectors(shape)
        facts = {r["list"]: r for r in stored.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()}
        lines = [
            json.dumps({"list": at, "rows": facts[at]["n"] if at in facts else 0, "radius": facts[at]["radius"] if at in facts else 0.0, "centre": c})
            for at, c in enumerate(centres.tolist())
        ]
        lines.append(json.dumps({"list": -1, "rows": facts[-1]["n"] if -1 in facts else 0, "radius": 4.0, "centre": []}))
        self.spark.createDataFrame([(line,) for line in lines], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/lists")
        return self

    def _vectors(self, shape: T.StructType | None = None) -> DataFrame:
        if shape is None:
            shape = T.StructType([*CODE_EMBEDDINGS.fields, T.StructField("angle", T.DoubleType()), T.StructField("list", T.IntegerType())])
        return self.spark.read.schema(shape).parquet(f"{self.path}/vectors")

    def lists(self) -> list[dict]:
        """Number, rows, radius and centroid of every list, by number."""
        found = [json.loads(r["value"]) for r in self.spark.read.text(f"{self.path}/lists").collect()]
        return sorted(found, key=lambda x: x["list"])

    # --- searching ---------------------------------------------------------------------------

    def _rows(self, numbers) -> DataFrame:
        """Rows of some lists; only their partitions are read."""
        return self._vectors().where(F.col("list").isin(*numbers))

    def _best(self, numbers, target, threshold: float, top: int, exclude=None) -> DataFrame:
        rows = self._rows(numbers).select("code_hash", "embedding")
        if exclude is not None:
            rows = rows.where(F.col("code_hash") != exclude)
        aim = F.lit([float(x) for x in target]).cast("array<double>")
        scored = rows.select("code_hash", cosine("embedding", aim).alias("similarity"))
        return scored.orderBy(F.desc("similarity"), "code_hash").limit(top).where(F.col("similarity") >= threshold)

    def probes(self, target, count: int) -> list[int]:
        """The ``count`` lists whose centroids are nearest to a vector, and list -1 if it has rows."""
        facts = [f for f in self.lists() if f["rows"]]
        near = [f for f in facts if f["list"] >= 0 and len(f["centre"]) == len(target)]
        unit = unit_rows([target])
        near.sort(key=lambda f: (float(angles(unit, np.array([f["centre"]]))[0, 0]), f["list"]))
        return [f["list"] for f in near[:count]] + [f["list"] for f in facts if f["list"] < 0]

    def find(self, target, threshold: float = THRESHOLD, top: int = TOP, probe: int = 8, exact: bool = False, exclude=None) -> DataFrame:
        """(code_hash, similarity) of the ``top`` rows most similar to one vector, by cosine, then hash.

        Reads ``probe`` lists. With ``exact`` these give a bound, the ``top``-th similarity or the threshold; all lists
        whose centroid is no further away than their radius and the bound's angle are read then.
        """
        first = self.probes(target, probe)
        if not exact:
            return self._best(first, target, threshold, top, exclude)
        found = self._best(first, target, threshold, top, exclude).collect()
        bound = found[-1]["similarity"] if len(found) == top else threshold
        theta = math.acos(max(-1.0, min(1.0, bound))) + SLACK
        unit = unit_rows([target])
        wanted = [
            f["list"] for f in self.lists()
            if f["rows"] and (f["list"] < 0 or bound <= 0 or len(f["centre"]) == len(target) and float(angles(unit, np.array([f["centre"]]))[0, 0]) <= f["radius"] + theta + SLACK)
        ]
        return self._best(wanted, target, threshold, top, exclude)

    def search(self, queries: DataFrame, threshold: float = THRESHOLD, top: int = TOP, probe: int = 8, exact: bool = False) -> DataFrame:
        """The ``top`` most similar rows of every query (query_id, embedding): query_id, rank, code_hash, similarity.

        Every query meets the rows of its ``probe`` nearest lists. With ``exact`` a second round reads the further lists
        that may hold better rows than its ``top``-th so far. Lists fill blocks of at most ``BLOCK_ROWS`` rows, larger ones are split, and
        so are the queries; a block of queries and one of rows is one group, which multiplies them as matrices. A query goes only to
        blocks with a list it aims at. Queries that are NULL, zero or not finite have no result; ``threshold`` has to be positive.
        """
        if threshold <= 0:
            raise ValueError("searching lists needs a positive threshold")
        facts = self.lists()
        known = [f for f in facts if f["list"] >= 0]
        rest = {f["list"]: f["rows"] for f in facts if f["list"] < 0 and f["rows"]}
        centres = np.array([f["centre"] for f in known]) if known else np.zeros((0, 0))
        radii, counts = np.array([f["radius"] for f in known]), np.array([f["rows"] for f in known], np.int64)
        rows, cores = sum(f["rows"] for f in facts), self.spark.sparkContext.defaultParallelism
        block_rows = min(BLOCK_ROWS, max(LEAST_BLOCK_ROWS, math.ceil(rows / (2 * cores))))
        first, splits, blocks = _blocks_of(Cells(queries, "query_id", tuple(centres), radii, counts, rest), block_rows)
        shared = self.spark.sparkContext.broadcast((centres, radii, counts, list(rest), first, splits))  # at most MOST_LISTS + 1 lists
        asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("embedding"))
        query_blocks = max(1, math.ceil(asked.count() / BLOCK_ROWS))
        tasks = max(1, min(2 * blocks * query_blocks, MOST_TASKS))
        vector, numbers = T.ArrayType(T.DoubleType()), T.ArrayType(T.IntegerType())
        id_field = T.StructField("query_id", queries.schema["query_id"].dataType)
        shape = T.StructType([id_field, T.StructField("aim", vector), T.StructField("blocks", numbers), T.StructField("lists", T.ArrayType(numbers))])

        def aimed(batches):
            centres, radii, counts, rest, first, splits = shared.value
            filled = np.flatnonzero(counts)
            for batch in batches:
                at, aims, to, lists = [], [], [], []
                for nth, (vector, bound) in enumerate(zip(batch.column("embedding").to_pylist(), batch.column("bound").to_pylist())):
                    value = np.asarray(vector if vector is not None else (), float)
                    if not len(value) or not np.isfinite(value).all() or not value.any():
                        continue
                    chosen = list(rest) if bound is None else []
                    if len(filled) and centres.shape[1] == len(value):
                        apart = angles(unit_rows([value]), centres[filled])[0]
                        order = np.lexsort((filled, apart))
                        if bound is None:
                            taken = order[:probe]
                        else:
                            reach = radii[filled] + math.acos(max(-1.0, min(1.0, bound))) + 2 * SLACK
                            taken = [at for at in order[probe:] if apart[at] <= reach[at]]
                        chosen += filled[taken].tolist()
                    own: dict[int, list] = {}
                    for number in chosen:
                        for block in range(first[number], first[number] + splits[number]):
                            own.setdefault(block, []).append(number)
                    if own:
                        at.append(nth)
                        aims.append(value)
                        to.append(list(own))
                        lists.append(list(own.values()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("query_id").take(pa.array(at, pa.int64())), pa.array(aims, pa.list_(pa.float64())),
                     pa.array(to, pa.list_(pa.int32())), pa.array(lists, pa.list_(pa.list_(pa.int32())))],
                    names=shape.names,
                )

        result = T.StructType([id_field, T.StructField("code_hash", T.StringType()), T.StructField("similarity", T.DoubleType())])
        least, most = threshold, top

        def meet(asking: pa.Table, stored: pa.Table) -> pa.Table:
            stored = stored.take(pc.sort_indices(stored["code_hash"], null_placement="at_start"))
            ids, hashes, values = [], [], []

            def matrix(table, column, width):
                return table[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)

            for width in pc.unique(pc.list_value_length(asking["aim"])).to_pylist():
                own, others = (t.filter(pc.equal(pc.list_value_length(t[c]), width)) for t, c in ((asking, "aim"), (stored, "embedding")))
                if not others.num_rows:
                    continue
                held, at = np.unique(others["list"].to_numpy(), return_inverse=True)
                place = {number: nth for nth, number in enumerate(held.tolist())}
                wanted = np.zeros((own.num_rows, len(held)), bool)
                for nth, lists in enumerate(own["lists"].to_pylist()):
                    wanted[nth, [place[number] for number in lists if number in place]] = True
                with np.errstate(all="ignore"):
                    for query, row, value in best_pairs(matrix(own, "aim", width), wanted, matrix(others, "embedding", width), at, least, most):
                        ids.append(own["query_id"].take(pa.array(query)))
                        hashes.append(others["code_hash"].take(pa.array(row)))
                        values.append(pa.array(value))
            columns = (("query_id", ids, asking), ("code_hash", hashes, stored))
            done = [pa.chunked_array([c for part in parts for c in part.chunks], table.schema.field(name).type) for name, parts, table in columns]
            return pa.table([*done, pa.chunked_array(values, pa.float64())], names=result.names)

        def placed(numbers: dict):
            """A number of each list, from a literal array; list -1 comes last."""
            return F.get(F.lit([numbers.get(n, 0) for n in range(len(known))] + [numbers.get(-1, 0)]), F.when(F.col("list") < 0, len(known)).otherwise(F.col("list")))

        # NULL and vectors with NULL entries are similar to nothing.
        usable = self._vectors().where(F.forall("embedding", lambda x: x.isNotNull()))
        block = placed(first) + F.pmod(F.monotonically_increasing_id(), placed(splits))
        dealt = usable.where(F.size("embedding") > 0).select("code_hash", "embedding", "list", block.cast("int").alias("j"))
        dealt = dealt.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))).repartition(tasks, "i", "j")

        def met(asked: DataFrame) -> DataFrame:
            nth = F.pmod(F.monotonically_increasing_id(), F.lit(query_blocks)).cast("int")
            sent = asked.mapInArrow(aimed, shape).withColumn("i", nth).withColumn("to", F.explode(F.arrays_zip("blocks", "lists")))
            sent = sent.select("query_id", "aim", F.col("to.lists").alias("lists"), "i", F.col("to.blocks").alias("j"))
            return sent.repartition(tasks, "i", "j").groupBy("i", "j").cogroup(dealt.groupBy("i", "j")).applyInArrow(meet, result)

        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "code_hash")
        best = lambda rows: rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        found = best(met(asked.withColumn("bound", F.lit(None).cast("double"))))
        if exact:
            found = kept(found, "probed")
            bounds = found.where(F.col("rank") == top).select("query_id", F.col("similarity").alias("bound"))
            more = asked.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float(threshold))))
            found = best(found.drop("rank").unionByName(met(more)))
        return found.select("query_id", F.col("rank").cast("long").alias("rank"), "code_hash", "similarity")
