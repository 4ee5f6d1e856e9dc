"""Language identification by rank-order profiles of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sourcelode.llm.words import emptied

#: Lengths of the n-grams. Three code points of 21 bits fit one integer, so grams are exact.
LENGTHS = (1, 2, 3)
BITS = 21
EDGE = 32
#: Code points worked on at once.
CHUNK = 1 << 19
#: Distinct grams a task holds before it hands them on.
HELD = 1 << 20
UNKNOWN = "und"
#: Share of a language's median score below which a text is taken to be in no learned language.
LEAST_SHARE = 0.55


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of a text's words and their counts, by gram.

    A word is a run of letters, lower-cased; one space stands before and after it. Grams of spaces
    alone are left out.
    """
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    letter = _letters()[points]
    edge = np.int64(EDGE)
    codes = np.where(letter, points, EDGE).astype(np.int64)
    keep = letter | np.concatenate(([False], letter[:-1]))  # one space after each word
    codes = np.concatenate(([edge], codes[keep], [edge]))
    for start in range(0, len(codes), CHUNK):
        part = codes[start : start + CHUNK + max(LENGTHS) - 1]
        packed, all_grams = part, []
        for n in LENGTHS:
            if n > 1:
                packed = (packed[:-1] << BITS) | part[n - 1 :]
            own = packed[: min(len(packed), CHUNK)]
            # A space inside a gram would join two words; only the first or last may be one.
            inside = part[1 : 1 + len(own)] != edge if n == 3 else (own != edge if n == 1 else own != ((edge << BITS) | edge))
            all_grams.append(own[inside[: len(own)]])
        found.append(np.unique(np.concatenate(all_grams), return_counts=True))
    if len(found) == 1:
        return found[0]
    return merged(found)


def merged(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, back = np.unique(np.concatenate([k for k, _ in found]), return_inverse=True)
    return keys, np.bincount(back, np.concatenate([c for _, c in found]), len(keys)).astype(np.int64)


def top(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent grams, ties by gram."""
    if len(keys) > 4 * size:  # sort only what can be among them
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keep = counts >= least
        keys, counts = keys[keep], counts[keep]
    return keys[np.lexsort((keys, -counts))[:size]]


class Profiles:
    """Ranked n-grams of every language, kept as one sorted list of grams with a row of ranks."""

    def __init__(self, ranked: dict[str, list[int]], size: int):
        self.size = size
        self.languages = sorted(ranked)
        self.keys = np.unique(np.concatenate([np.asarray(v, np.int64) for v in ranked.values()])) if ranked else np.zeros(0, np.int64)
        # One row more, for grams that no profile has.
        self.ranks = np.full((len(self.keys) + 1, len(self.languages)), -1, np.int32)
        for column, language in enumerate(self.languages):
            own = np.asarray(ranked[language], np.int64)
            self.ranks[np.searchsorted(self.keys, own), column] = np.arange(len(own))

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language of least out-of-place distance and its score."""
        keys, counts = grams(text or "")
        if not len(keys) or not self.languages:
            return UNKNOWN, 0.0
        ranked = top(keys, counts, self.size)
        at = np.searchsorted(self.keys, ranked)
        at[at == len(self.keys)] = 0
        at = np.where(self.keys[at] == ranked, at, len(self.keys))
        ranks = self.ranks[at]
        away = np.abs(ranks - np.arange(len(ranked), dtype=np.int32)[:, None])
        distance = np.where(ranks >= 0, np.minimum(away, self.size), self.size).sum(axis=0)
        best = int(distance.argmin())
        return self.languages[best], float(1 - distance[best] / (self.size * len(ranked)))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}

    def flush():
        for language, found in held.items():
            keys, counts = merged(found)
            yield pa.RecordBatch.from_arrays([pa.array([language] * len(keys)).cast(pa.string()), pa.array(keys), pa.array(counts)], ["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        waiting: dict[str, list[str]] = {}
        sizes: dict[str, int] = {}

        def take(language, waiting=waiting, sizes=sizes):
            # A blank keeps the words of different texts apart.
            held.setdefault(language, []).append(grams(" ".join(waiting.pop(language))))
            sizes.pop(language)
            if len(held[language]) > 8:
                held[language] = [merged(held[language])]

        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            waiting.setdefault(language, []).append(text)
            sizes[language] = sizes.get(language, 0) + len(text)
            if sizes[language] >= CHUNK:
                take(language)
        for language in list(waiting):
            take(language)
        if sum(len(k) for found in held.values() for k, _ in found) > HELD:
            yield from flush()
    yield from flush()


def train(docs: DataFrame, size: int = 400) -> Profiles:
    """Profiles of ``size`` grams per language from all rows with a text and a language.

    Tasks count grams of their texts, Spark sums them per language and gram and keeps the best
    ``size`` of each language; only these reach the driver (languages times ``size``).
    """
    texts = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = texts.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)
    ranked: dict[str, list] = {}
    for row in sorted(best.collect(), key=lambda r: (r["lang"], r["rank"])):
        ranked.setdefault(row["lang"], []).append(row["gram"])
    return Profiles(ranked, size)


def held_out(doc_id: Column, parts: int = 4, part: int = 2) -> Column:
    """Whether crc32 of the id as text leaves ``part``; a NULL id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts == part, F.lit(False))


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score``, from whole texts alone.

    ``lang_pred`` is a learned language, or ``und`` (score 0) for a NULL text, a text without
    letters, or if nothing was learned. The score is 1 less the share of the largest possible
    distance; equal distances go to the language first by name. Columns of these names in
    ``docs`` are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(profiles)

    @F.arrow_udf("lang_pred string, lang_score double")
    def predicted(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        with emptied():
            for texts in columns:
                found = [known.predict(text.as_py()) for text in texts]
                values = [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]
                yield pa.StructArray.from_arrays(values, ["lang_pred", "lang_score"])

    # Only texts go to Python, and only predictions come back; not moved below a filter, which would predict twice.
    rest = [c for c in docs.columns if c not in ("lang_pred", "lang_score")]
    found = docs.withColumn("found_", predicted.asNondeterministic()(F.col("text")))
    return found.select(*rest, F.col("found_.lang_pred").alias("lang_pred"), F.col("found_.lang_score").alias("lang_score"))


def least_scores(learnable: DataFrame, profiles: Profiles, share: float = LEAST_SHARE) -> dict[str, float]:
    """Least score per language: ``share`` of the median of the ``learnable`` rows (text, lang) that
    are predicted as they are labelled. A few wrongly labelled rows do not move a median, and scripts
    with many letters, whose scores are low throughout, have a bound of their own."""
    found = predict(learnable.where(F.col("text").isNotNull()).select("lang", "text"), profiles)
    medians = found.where("lang_pred = lang").groupBy("lang").agg(F.percentile_approx("lang_score", 0.5, 10000).alias("median"))
    return {row["lang"]: share * row["median"] for row in medians.collect()}  # a row per language


def known(least: dict[str, float]) -> Column:
    """Whether a prediction reaches its language's least score; languages that none of their own
    rows were predicted as take the highest. Score 0 (not one known gram) never does."""
    bound = F.lit(max(least.values(), default=0.0))
    for language, value in least.items():
        bound = F.when(F.col("lang_pred") == language, F.lit(value)).otherwise(bound)
    return (F.col("lang_pred") != UNKNOWN) & (F.col("lang_score") > 0) & (F.col("lang_score") >= bound)
