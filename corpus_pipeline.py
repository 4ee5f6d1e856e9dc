"""A corpus from raw documents to token ids, in stages that are tables of their own.

Every stage takes NULL in any column, repeated rows and further columns, which it carries along whatever their
names; an empty table gives an empty one.

Quality and language decide about single documents, then one document of each near-duplicate group
stays, sources are mixed to their target weights and the texts are encoded. Every stage
reads what its predecessor wrote; a lost executor costs tasks of one stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelode.llm import bpe, jaccard, langid, mixing, quality
from sourcelode.llm.queries import QUALITY_LEAST, mix_documents, quality_weights, table
from sourcelode.llm.storage import written


#: Columns that stages read; a stage carries all others along as one struct, so their names cannot clash with its own.
BASE = ("doc_id", "text", "lang", "source", "n_chars")


def packed(docs: DataFrame) -> DataFrame:
    """``docs`` with all columns beyond ``BASE`` in one, ``others_``."""
    others = [docs[c] for c in docs.columns if c not in BASE]
    return docs.select(*BASE, (F.struct(*others) if others else F.lit(None).cast("struct<none:int>")).alias("others_"))


def unpacked(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` from a frame that :func:`packed` made."""
    return found.select(*(F.col(c) if c in BASE else F.col(f"others_.`{c}`").alias(c) for c in docs.columns))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least ``QUALITY_LEAST``; learned from labelled documents
    of the input that are not held out. NULL texts have the score of an empty text; without labels every score
    is 0.5 and all stay."""
    weights = quality_weights(docs, table(spark, sf_dir, "labels"))
    return unpacked(quality.score(packed(docs), weights).where(F.col("quality_score") >= QUALITY_LEAST), docs)


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language, by op 3's prediction and score: those without letters
    (``und``) and those below the least score of the predicted language go. ``lang`` becomes the predicted
    language, also where it said another one. Profiles and least scores come from rows that are not held out."""
    learnable = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    profiles = langid.train(learnable)
    found = langid.predict(packed(docs), profiles).where(langid.known(langid.least_scores(learnable, profiles)))
    return unpacked(found.withColumn("lang", F.col("lang_pred")), docs)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group that near-duplicate links join; of
    several rows of that doc_id the first by text. Rows of NULL doc_id stay, they are in no group."""
    groups = jaccard.near_duplicates(docs.select("doc_id", "text"))
    first = groups.where("component_id = doc_id").select("doc_id").distinct()
    rows, own = packed(docs), ["text", "lang", "source", "n_chars"]
    # One row of each id is left in every task before rows are shuffled.
    least = F.min(F.struct(*own, F.lit(None).cast("struct<none:int>").alias("others_")))
    if len(docs.columns) > len(BASE):
        least = F.min_by(F.struct(*own, "others_"), F.struct(*own, F.to_json("others_")))
    one = rows.where("doc_id IS NOT NULL").groupBy("doc_id").agg(least.alias("row_"))
    kept = one.join(first, "doc_id", "left_semi").select("doc_id", "row_.*")
    return unpacked(kept.unionByName(rows.where("doc_id IS NULL")), docs)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of the registered mix, once per epoch in which they are taken; the document that
    crosses a leaf's budget is cut after its last token inside it."""
    mixed = mix_documents(packed(docs))
    cut = F.col("mix_take") < F.col("mix_tokens")
    text = F.when(cut, mixing.first_tokens(F.col("text"), F.col("mix_take"))).otherwise(F.col("text"))
    mixed = mixed.withColumn("text", text).withColumn("n_chars", F.when(cut, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return unpacked(mixed, docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", keep_quality),
    ("language ID", keep_languages),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("mixing sources to target weights", mix_to_weights),
    ("BPE encoding and decoding", encode),
]

#: A trained classifier decides the first stage, so SQL can't give the rows; tests compare every
#: stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, f"stage-{at}")
    return docs
