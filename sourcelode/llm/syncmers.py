"""Document fingerprints of closed syncmers, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Units of a text: runs without white space; a Han, kana or Thai character is a unit of its own.
UNIT = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]|[^\s\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}]+"
#: A k-mer is five units, its inner substrings two.
K, S = 5, 2


def unit_hashes(text: Column) -> Column:
    """64-bit hashes of the lower-cased units of a text, in order."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(f"({UNIT})"), F.lit(1)), lambda unit: F.xxhash64(unit))


def with_anchors(docs: DataFrame, text: str, name: str, k: int = K, s: int = S) -> DataFrame:
    """``docs`` with ``name``: the closed syncmers of a text column as 32-bit integers, in order; and
    ``{name}_links``, the same anchors as their places tell them apart (see :func:`likeness`).

    A k-mer is chosen if the least hash of its ``k - s + 1`` inner substrings is that of the first or
    the last one. That depends on its own units alone, so a passage gives the same anchors wherever
    it stands, and of any ``k - s + 1`` k-mers in a row at least one is chosen. A text of 1 to ``k - 1`` units
    has one anchor, for all of them; without units it has none.
    """
    inner = k - s + 1
    # Three steps, each an array that the next one reads.
    docs = docs.withColumn("u_", unit_hashes(F.coalesce(F.col(text), F.lit(""))))
    mer = ", ".join(f"u_[i + {at}]" for at in range(s))
    docs = docs.withColumn("m_", F.expr(f"CASE WHEN size(u_) >= {k} THEN transform(sequence(0, size(u_) - {s}), i -> xxhash64({mer})) END"))
    middle = ", ".join(f"m_[i + {at}]" for at in range(1, inner - 1))
    middle = f"least({middle})" if inner > 3 else middle
    least = f"least(m_[i], m_[i + {inner - 1}])" + (f" <= {middle}" if inner > 2 else " IS NOT NULL")
    # A k-mer is known by its substrings that do not overlap, and by the last one.
    parts = [*range(0, k - s + 1, s), k - s]
    kmer = ", ".join(f"m_[i + {at}]" for at in dict.fromkeys(parts))
    places = F.expr(
        f"CASE WHEN size(u_) >= {k} THEN filter(sequence(0, size(u_) - {k}), i -> {least})"
        " WHEN size(u_) > 0 THEN array(0) ELSE CAST(array() AS ARRAY<INT>) END"
    )
    chosen = F.expr(f"CASE WHEN size(u_) >= {k} THEN transform(p_, i -> hash({kmer})) WHEN size(u_) > 0 THEN array(hash(u_)) ELSE CAST(array() AS ARRAY<INT>) END")
    docs = docs.withColumn("p_", places).withColumn(name, chosen)
    links = F.expr(f"transform({name}, (a_, i_) -> CASE WHEN i_ = 0 THEN hash(a_) ELSE hash(a_, {name}[i_ - 1], p_[i_] - p_[i_ - 1]) END)")
    return docs.withColumn(f"{name}_links", links).drop("u_", "m_", "p_")


def fingerprint(anchors: Column) -> Column:
    """Anchors in order as text, eight hex digits each."""
    digits = lambda a: F.lpad(F.hex(a.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0")
    return F.array_join(F.transform(anchors, digits), "")


def likeness(left: Column, right: Column) -> Column:
    """Share of the anchors of two documents that match by position; 1 if both have none.

    Takes the links of both: an anchor matches if it follows the same anchor at the same distance (in
    units) in both documents, or is the first in both. So a passage that is moved as a whole loses
    one match, while the same anchors in another order have none. Repeated links count once.
    """
    common, either = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return F.when(either == 0, F.lit(1.0)).otherwise(common / either)


def _bucket(docs: DataFrame) -> Column:
    """Number of the range of rows that a row is in, by (known_, id_, hash_, at_).

    Bounds are those of Spark's range partitions over the keys alone, one per shuffle partition; so
    ranges follow rows, whatever the ids are. A row finds its range among about the square root of
    the bounds, then among those between two of these.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["known_", "id_", "hash_", "at_"]
    keys = docs.select(F.struct(*names).alias("key")).repartitionByRange(parts, *(F.col(f"key.{c}") for c in names))
    tops = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.max("key").alias("top")).select("top.*").collect()
    bounds = sorted(tuple(row) for row in tops)[:-1]
    if not bounds:
        return F.lit(0)
    literal = lambda rows: F.array(*(F.struct(*(F.lit(v).cast(t).alias(c) for c, v, t in zip(names, row, ("int", "long", "long", "long"), strict=True))) for row in rows))
    below = lambda among: F.size(F.filter(among, lambda bound: bound < F.struct(*names)))
    step = math.isqrt(len(bounds)) + 1
    coarse = bounds[step - 1 :: step]
    first = below(literal(coarse)) * step if coarse else F.lit(0)
    return first + below(F.slice(literal(bounds), first + 1, F.lit(step)))


def _tops(docs: DataFrame) -> DataFrame:
    """The greatest row of every bucket (``b_``), in the next bucket that has rows; the last one's in the
    first. Only a key per bucket is ranked as a whole and sent to the tasks that look up its text."""
    everything = Window.partitionBy(F.lit(0))
    light = docs.groupBy("b_").agg(F.max(F.struct("known_", "id_", "hash_")).alias("m"))
    to = F.coalesce(F.lead("b_").over(everything.orderBy("b_")), F.min("b_").over(everything))
    keys = light.select("m.*", to.alias("to_"))
    return docs.drop("b_").join(F.broadcast(keys), ["known_", "id_", "hash_"]).groupBy(F.col("to_").alias("b_")).agg(F.min("text").alias("text"))


def with_next(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """``docs`` (doc_id, text) with ``anchors`` and ``anchors_links``, and ``next_text`` and ``next_links`` of the next
    document by descending doc_id; the last one's next is the first. Rows of NULL id come last,
    rows of one id are in the order of a hash of their texts.

    Rows are sorted inside ranges of about equal numbers of rows (:func:`_bucket`). The greatest row of every
    range is also sent to the next one, in front of its least row, so no step orders all documents, and
    many rows of one id, or of none, are dealt over ranges like any others.
    """
    docs = docs.select(
        "doc_id", "text", F.col("doc_id").isNotNull().cast("int").alias("known_"), F.coalesce("doc_id", F.lit(0).cast("bigint")).alias("id_"),
        F.xxhash64("text").alias("hash_"), F.monotonically_increasing_id().alias("at_"),
    )
    docs = docs.withColumn("b_", _bucket(docs))
    rows = docs.withColumn("sent_", F.lit(False)).unionByName(_tops(docs).withColumn("sent_", F.lit(True)), allowMissingColumns=True)
    rows = with_anchors(rows, "text", "anchors", k, s)
    order = Window.partitionBy("b_").orderBy(F.desc("sent_"), "known_", "id_", "hash_", "at_")
    rows = rows.withColumn("next_text", F.lag("text").over(order)).withColumn("next_links", F.lag("anchors_links").over(order))
    return rows.where(~F.col("sent_")).drop("b_", "sent_", "known_", "id_", "hash_", "at_")


def fingerprints(docs: DataFrame, k: int = K, s: int = S) -> DataFrame:
    """Fingerprint every whole text and an edited copy of it, and compare.

    ``docs`` needs doc_id and text; other columns are not read. The edited copy has the last
    floor(n_chars / 3) code points replaced by as many, or all, of the first code points of the
    next document by descending doc_id. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited and near_next (0 to 1). Equal texts have equal fingerprints. A NULL
    text is empty and has an empty fingerprint; a single document is its own next. Repeated rows are
    rows of their own.
    """
    docs = docs.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = with_next(docs, k, s)
    rows = rows.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("cut", F.expr("CAST(n_chars div 3 AS INT)"))
    rows = rows.withColumn("edited", F.expr("concat(substring(text, 1, CAST(n_chars AS INT) - cut), substring(next_text, 1, cut))"))
    rows = with_anchors(rows, "edited", "edited_anchors", k, s)
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("anchors")).alias("fingerprint"), fingerprint(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("anchors_links"), F.col("edited_anchors_links")).alias("near_edited"),
        likeness(F.col("anchors_links"), F.col("next_links")).alias("near_next"),
    )

