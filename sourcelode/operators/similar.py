"""Similar code: embeddings, one target against all, all against all."""

import math
from typing import Any, Iterator, Tuple

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer
from pyspark.ml.functions import predict_batch_udf, vector_to_array
from pyspark.sql import DataFrame, Window, functions as F, types as T

from sourcelode.functions import text as txt
from sourcelode.functions.vectors import cosine
from sourcelode.operators.cells import SLACK, Cells, angles, make_cells, unit_rows

# Default similarity threshold and length of a result list.
THRESHOLD = 0.8
TOP = 20
# Vectors per block of the all-pairs job at most; a task holds two blocks.
BLOCK_ROWS = 20_000
# Blocks smaller than this cost more in copies than further tasks gain.
LEAST_BLOCK_ROWS = 128
# Pairs that are scored, and pairs that are handed on, at once: what a task holds besides its blocks.
SCORED, HANDED = 2_000_000, 200_000
# Tasks of the all-pairs job at most.
MOST_TASKS = 10_000


def find_similar(
    vectors: DataFrame, target: DataFrame, threshold: float = THRESHOLD, top: int = TOP,
    vec: str = "embedding", row_id: str = "vec_id",
) -> DataFrame:
    """The ``top`` rows most similar to one target vector.

    ``target`` is a one-row, one-column frame; it enters the plan as a scalar subquery, so the
    scan of ``vectors`` needs neither join nor shuffle, and the limit keeps ``top`` rows per task.
    """
    aimed = vectors.select(row_id, vec, target.scalar().alias("_target"))
    scored = aimed.select(row_id, cosine(vec, "_target").alias("similarity"))
    # Limit first: a filter below it would make Spark compute every similarity twice.
    best = scored.orderBy(F.desc("similarity"), row_id).limit(top)
    return best.where(F.col("similarity") >= threshold)


def similar_findings(
    findings: DataFrame, target_id, threshold: float = THRESHOLD, top: int = TOP,
    vec: str = "embedding", row_id: str = "id",
) -> DataFrame:
    """Findings whose code resembles the target finding's, each with its ``similarity_score``.

    Results are matched by finding id, so findings with equal code all keep their own row.
    """
    target = findings.where(F.col(row_id) == target_id).select(vec)
    others = findings.where(F.col(row_id) != target_id)
    near = find_similar(others, target, threshold, top, vec, row_id)
    return near.withColumnRenamed("similarity", "similarity_score")


def _blocks_of(cells: Cells, block_rows: int) -> tuple[dict, dict, int]:
    """Of each cell its first block and the number of blocks it is dealt over, and the number of blocks.

    Neighbouring cells share a block, a cell of more than ``block_rows`` rows is split.
    """
    sizes = {at: int(n) for at, n in enumerate(cells.counts) if n} | dict(cells.others)
    near: dict = {}
    if len(cells.pivots):
        # Cells around the same of a few pivots lie side by side; the first pivots are the furthest apart.
        coarse = max(1, sum(sizes.values()) // block_rows)
        for at, pivot in enumerate(cells.pivots):
            own = [c for c in range(min(coarse, len(cells.pivots))) if len(cells.pivots[c]) == len(pivot)]
            near[at] = max(own, key=lambda c: float(cells.pivots[c] @ pivot)) if own else -1
    first, splits, block, held = {}, {}, 0, 0
    for at in sorted(sizes, key=lambda c: (c < 0, near.get(c, 0), c)):
        if held and held + sizes[at] > block_rows:
            block, held = block + 1, 0
        first[at], splits[at] = block, -(-sizes[at] // block_rows)
        if splits[at] > 1:
            block, held = block + splits[at], 0
        else:
            held += sizes[at]
    return first, splits, block + (1 if held else 0)


def similar_all(
    vectors: DataFrame, threshold: float = THRESHOLD, top: int | None = None,
    vec: str = "embedding", row_id: str = "vec_id", block_rows: int = BLOCK_ROWS, cells: int | None = None,
) -> DataFrame:
    """For every vector all others that are similar, or its ``top`` most similar ones with their ``rank``; exact, whatever the data looks like.

    ``threshold`` has to be positive. Vectors are dealt into cells around pivots (:func:`make_cells`). Two cells are
    compared only if the angles between pivots and the radii allow a pair within the threshold. Cells
    fill blocks of ``block_rows`` at most, large ones are split; a pair of blocks is one group, to which a row
    goes only if some cell on the other side can hold a similar one. So a row is copied at most once per block, and
    on clustered data to few; data without clusters costs what all blocks against all blocks do, in ever more tasks of the same size.
    A group multiplies only pairs of cells that meet, and hands on its pairs as it finds them. Pass one row per distinct code (see ``dedupe_code``).
    """
    if threshold <= 0:
        raise ValueError("cells need a positive threshold")
    dealt = make_cells(vectors, row_id, vec, cells)
    spark, cores = vectors.sparkSession, vectors.sparkSession.sparkContext.defaultParallelism
    rows = int(dealt.counts.sum()) + sum(dealt.others.values())
    # Smaller blocks where there are few rows, so that each core has a pair of blocks.
    wanted = min(math.ceil(math.sqrt(2 * cores)), max(1, rows // LEAST_BLOCK_ROWS))
    first, splits, blocks = _blocks_of(dealt, min(block_rows, max(LEAST_BLOCK_ROWS, math.ceil(rows / wanted))))
    theta = math.acos(min(1.0, threshold)) + SLACK
    met = dealt.meet(theta)
    shared = spark.sparkContext.broadcast((dealt.pivots, dealt.radii, met, first, splits))  # a row per pivot, a bit per pair of pivots
    vector = T.ArrayType(T.DoubleType())
    id_field = T.StructField(row_id, vectors.schema[row_id].dataType)
    sent = T.StructType([
        id_field, T.StructField("vector", vector), T.StructField("cell", T.IntegerType()), T.StructField("block", T.IntegerType()),
        T.StructField("i", T.IntegerType()), T.StructField("j", T.IntegerType()),
    ])

    def send(batches):
        import numpy as np
        import pandas as pd

        pivots, radii, _, first, splits = shared.value
        lengths = np.array([len(p) for p in pivots])
        reach = {}
        for n in set(lengths.tolist()):
            own = [at for at in np.flatnonzero(lengths == n) if at in first]
            # Which blocks a cell fills.
            fills = np.zeros((len(own), blocks), bool)
            for row, at in enumerate(own):
                fills[row, first[at] : first[at] + splits[at]] = True
            reach[n] = (np.stack([pivots[at] for at in own]) if own else None, radii[own], fills)
        for batch in batches:
            number = batch["number"].to_numpy()
            cell = batch["cell"].to_numpy()
            home = np.array([first[c] + h % splits[c] for c, h in zip(cell, number)], np.int32)
            parts = []
            for c in np.unique(np.where(cell < 0, cell, 0)):
                at = np.flatnonzero(cell == c) if c < 0 else np.flatnonzero(cell >= 0)
                if c < 0:
                    to = np.zeros((len(at), blocks), bool)
                    to[:, first[c] : first[c] + splits[c]] = True
                    parts.append((at, to))
                    continue
                size = batch["vector"].iloc[at].map(len).to_numpy()
                for n, (own, radius, fills) in reach.items():
                    here = at[size == n]
                    if len(here) and own is not None:
                        near = angles(unit_rows(batch["vector"].iloc[here]), own) <= radius + theta + SLACK
                        parts.append((here, near.astype(np.float32) @ fills.astype(np.float32) > 0))
            for at, to in parts:
                to[np.arange(len(at)), home[at]] = True
                row, other = np.nonzero(to)
                own = home[at][row]
                for start in range(0, len(row), 20_000):
                    part = slice(start, start + 20_000)
                    source = batch.iloc[at[row[part]]]
                    yield pd.DataFrame({
                        row_id: source[row_id].to_numpy(), "vector": source["vector"].to_numpy(), "cell": source["cell"].to_numpy(),
                        "block": own[part], "i": np.minimum(own[part], other[part]), "j": np.maximum(own[part], other[part]),
                    }, columns=sent.names)

    shape = T.StructType([
        T.StructField("target_id", id_field.dataType), T.StructField("similar_id", id_field.dataType), T.StructField("similarity", T.DoubleType()),
    ])
    limit, least = top, threshold

    def best(key: Tuple[Any, ...], frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        i, j = key
        met = shared.value[2]
        # Lists of numbers become arrays batch by batch; only those are held.
        ids, cells, homes, units = [], [], [], []
        for frame in frames:
            size = frame["vector"].map(len).to_numpy()
            for n in np.unique(size):
                at = np.flatnonzero(size == n)
                ids.append(frame[row_id].iloc[at])
                cells.append(frame["cell"].to_numpy()[at])
                homes.append(frame["block"].to_numpy()[at])
                units += np.split(unit_rows(frame["vector"].iloc[at]), len(at))
        ids, cells, homes = pd.concat(ids).reset_index(drop=True), np.concatenate(cells), np.concatenate(homes)

        def side(number):
            parts = {}
            for cell in np.unique(cells[homes == number]):
                own = ids[(homes == number) & (cells == cell)].sort_values(kind="stable")
                parts[cell] = (own.to_numpy(), np.concatenate([units[at] for at in own.index]))
            return parts

        def top_of(own_ids, unit, other_ids, other_unit):
            step = max(1, SCORED // len(other_ids))
            for start in range(0, len(own_ids), step):
                mine = own_ids[start : start + step]
                scores = unit[start : start + step] @ other_unit.T
                # Few pairs are similar as a rule; only those are looked at further.
                near = scores >= least - 1e-9
                if limit is not None and limit < len(other_ids) and np.count_nonzero(near) > 0.1 * near.size:
                    scores[mine[:, None] == other_ids[None, :]] = -2.0
                    near &= scores >= -np.partition(-scores, limit - 1, axis=1)[:, limit - 1 : limit] - 1e-9
                row, column = np.nonzero(near)
                # Rounded, so that equal vectors tie wherever they sit in a block.
                score = np.round(scores[row, column], 12)
                kept = (score >= least) & (mine[row] != other_ids[column])
                row, column, score = row[kept], column[kept], score[kept]
                if limit is not None:
                    # The best of each row, ties in id order.
                    order = np.lexsort((column, -score, row))
                    row, column, score = row[order], column[order], score[order]
                    first = np.arange(len(row)) - np.searchsorted(row, row) < limit
                    row, column, score = row[first], column[first], score[first]
                for at in range(0, len(row), HANDED):
                    part = slice(at, at + HANDED)
                    yield pd.DataFrame({"target_id": mine[row[part]], "similar_id": other_ids[column[part]], "similarity": score[part]})

        def meet(left, right):
            for cell, (own_ids, unit) in left.items():
                others = [c for c in right if c == cell or (c >= 0 and cell >= 0 and met[cell, c])]
                if others:
                    other_ids = np.concatenate([right[c][0] for c in others])
                    order = np.argsort(other_ids, kind="stable")
                    yield from top_of(own_ids, unit, other_ids[order], np.concatenate([right[c][1] for c in others])[order])

        left = side(i)
        right = left if i == j else side(j)
        yield from meet(left, right)
        if i != j:
            yield from meet(right, left)

    numbered = dealt.rows.withColumn("number", F.pmod(F.xxhash64(row_id), F.lit(1 << 30)).cast("int"))
    # Groups are heavy, far from what their bytes suggest: so many tasks that few get several, however many blocks there are.
    tasks = max(1, min(2 * blocks * (blocks + 1), MOST_TASKS))
    found = numbered.mapInPandas(send, sent).repartition(tasks, "i", "j").groupBy("i", "j").applyInPandas(best, shape)
    if top is None:
        # A rank would bring all neighbours of a hot row into one task.
        return found
    ranked = Window.partitionBy("target_id").orderBy(F.desc("similarity"), "similar_id")
    return (
        found.withColumn("rank", F.row_number().over(ranked).cast("long"))
        .where(F.col("rank") <= top)
    )


HASHED_DIMENSIONS = 64


def hashed_embedding(
    texts: DataFrame, code: str = "code", dimensions: int = HASHED_DIMENSIONS
) -> DataFrame:
    """Add ``embedding``: word counts hashed into ``dimensions`` buckets, scaled to length 1."""
    words = F.filter(F.split(F.lower(code), r"[^\p{L}\p{N}_]+"), lambda word: word != "")
    counted = HashingTF(numFeatures=dimensions, inputCol="_words", outputCol="_counts").transform(
        texts.withColumn("_words", words)
    )
    scaled = Normalizer(p=2.0, inputCol="_counts", outputCol="_unit").transform(counted)
    return scaled.withColumn("embedding", vector_to_array("_unit")).drop("_words", "_counts", "_unit")


def embed_corpus(
    files: DataFrame, row_id: str, model=None, dimensions: int | None = None, batch_rows: int = 50,
    model_name: str = "hashed-words", model_version: str = "1.0.0", load=None,
) -> DataFrame:
    """One embedding per distinct code: code_hash, embedding, error, model_name, model_version.

    ``load()`` makes a model, ``model(list of texts) -> list of vectors``, once per Python worker; ``model`` is one
    that is at hand. It is called with up to ``batch_rows`` texts. A batch that fails is halved until the failing text is found, which
    gets a zero vector of ``dimensions`` (which a model has to come with) and the ``error``. Without a model the built-in hashed
    word vector is used, 64 long unless ``dimensions`` says otherwise.
    """
    if (model is not None or load is not None) and dimensions is None:
        raise ValueError("name the length of the model's vectors in dimensions")
    dimensions = dimensions or HASHED_DIMENSIONS
    cleaned = files.select(
        row_id, txt.code_hash("content").alias("code_hash"),
        txt.preprocess_code("content", "language").alias("code"),
    )
    # One shuffle; copies are dropped in each task before it. The row with the smallest id stays,
    # as the same text can be cleaned differently in two languages.
    only = cleaned.groupBy("code_hash").agg(F.min_by("code", row_id).alias("code"))
    facts = [F.lit(model_name).alias("model_name"), F.lit(model_version).alias("model_version")]
    if model is None and load is None:
        hashed = hashed_embedding(only, "code", dimensions)
        return hashed.select("code_hash", "embedding", F.lit(None).cast("string").alias("error"), *facts)

    def predictor():
        import numpy as np

        embed = load() if load is not None else model

        def vectors(texts: list) -> tuple:
            try:
                found = np.array([list(map(float, v)) for v in embed(texts)], float).reshape(len(texts), dimensions)
                return found, [""] * len(texts)
            except Exception as error:
                if len(texts) == 1:
                    return np.zeros((1, dimensions)), [f"{type(error).__name__}: {error}"]
            half = len(texts) // 2
            left, right = vectors(texts[:half]), vectors(texts[half:])
            return np.concatenate([left[0], right[0]]), left[1] + right[1]

        def predict(texts):
            found, errors = vectors([str(t) for t in np.atleast_1d(texts)])
            return {"embedding": found, "error": np.array(errors, object)}

        return predict

    embed = predict_batch_udf(
        predictor, return_type=T.StructType([T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())]),
        batch_size=batch_rows,
    )
    embedded = only.withColumn("_e", embed("code"))
    return embedded.select("code_hash", "_e.embedding", F.nullif("_e.error", F.lit("")).alias("error"), *facts)
