"""Queries of this subpackage over the given tables, and their SQL where it can say them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sourcelode.llm import (
    bpe, chat, htmltext, jaccard, langid, mixing, quality, resampling, sublattice, syncmers, tokenfile, topk, whitening,
)
from sourcelode.session import scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op1_exact_top_k", """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
 WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(coalesce(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])), 0) AS BIGINT) AS score
 FROM c q JOIN c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


#: Weights of the registered mix; a source's domain follows from its number.
MIX_WEIGHTS = {
    "domain": {"web": 50, "books": 30, "forum": 20},
    "lang": {"en": 50, "de": 20, "fr": 20, "es": 10},
    "source": {"src0": 3, "src5": 2},
}
MIX_DEFAULTS = {"domain": 5, "lang": 5, "source": 1}
MIX_SHARE, MIX_EPOCHS, MIX_SEED = 0.9, 4, 17


def mix_domain():
    digit = F.regexp_extract(F.col("source"), r"(\d)$", 1)
    return F.when(digit.isin("0", "1", "2", "3", "4"), "web").when(digit.isin("5", "6", "7"), "books").when(digit.isin("8", "9"), "forum")


def mix_documents(docs: DataFrame) -> DataFrame:
    return mixing.mix(docs, mix_domain(), MIX_WEIGHTS, MIX_DEFAULTS, MIX_SHARE, MIX_EPOCHS, MIX_SEED)


def _sql_weight(level: str) -> str:
    arms = " ".join(f"WHEN '{k}' THEN {v}" for k, v in MIX_WEIGHTS[level].items())
    return f"CASE {level} {arms} ELSE {MIX_DEFAULTS[level]} END"


def _sql_share(nodes: str, parents: str, name: str) -> str:
    """Children of ``nodes`` (capacity, weight, budget of the parent) with budgets of their own."""
    part = f"PARTITION BY {parents}" if parents else ""
    full_part = f"PARTITION BY {parents}, full_" if parents else "PARTITION BY full_"
    order = f"{part} ORDER BY capacity / weight, {name}"
    return f"""(SELECT * EXCLUDE (budget, full_, rest, open_weight, part, odd, nth), CASE WHEN full_ THEN capacity ELSE part + CASE WHEN nth <= odd THEN 1 ELSE 0 END END AS budget FROM (
 SELECT *, rest - sum(part) OVER ({part}) AS odd, row_number() OVER ({full_part} ORDER BY {name}) AS nth FROM (
 SELECT *, CASE WHEN NOT full_ THEN rest * weight // open_weight END AS part FROM (
 SELECT *, budget - coalesce(sum(capacity) FILTER (full_) OVER ({part}), 0) AS rest, sum(weight) FILTER (NOT full_) OVER ({part}) AS open_weight FROM (
 SELECT *, capacity * sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= (budget - coalesce(sum(capacity) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight AS full_ FROM {nodes})))))"""


def _mix_sql() -> str:
    return f"""
WITH marked AS (SELECT *, coalesce(CASE WHEN right(source, 1) IN ('0','1','2','3','4') THEN 'web' WHEN right(source, 1) IN ('5','6','7') THEN 'books'
  WHEN right(source, 1) IN ('8','9') THEN 'forum' END, 'unknown') AS domain, coalesce(lang, 'unknown') AS lang_, coalesce(source, 'unknown') AS source_,
 len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS n FROM documents),
leaves AS (SELECT domain, lang_ AS lang, source_ AS source, CAST(sum(n) AS HUGEINT) AS tokens, CAST(sum(n) * {MIX_EPOCHS} AS HUGEINT) AS capacity FROM marked GROUP BY ALL HAVING sum(n) > 0),
goal AS (SELECT CAST(least(sum(tokens) * {round(MIX_SHARE * 1000)} // 1000, sum(tokens) * {MIX_EPOCHS}) AS HUGEINT) AS budget FROM leaves),
d0 AS (SELECT *, {_sql_weight("domain")} AS weight, (SELECT budget FROM goal) AS budget FROM (SELECT domain, CAST(sum(capacity) AS HUGEINT) AS capacity FROM leaves GROUP BY ALL)),
d1 AS (SELECT domain, CAST(budget AS HUGEINT) AS budget FROM {_sql_share("d0", "", "domain")}),
l0 AS (SELECT x.*, {_sql_weight("lang")} AS weight, budget FROM (SELECT domain, lang, CAST(sum(capacity) AS HUGEINT) AS capacity FROM leaves GROUP BY ALL) x JOIN d1 USING (domain)),
l1 AS (SELECT domain, lang, CAST(budget AS HUGEINT) AS budget FROM {_sql_share("l0", "domain", "lang")}),
s0 AS (SELECT x.*, {_sql_weight("source")} AS weight, budget FROM leaves x JOIN l1 USING (domain, lang)),
plan AS (SELECT domain, lang, source, CAST(budget // tokens AS BIGINT) AS epochs, CAST(budget % tokens AS BIGINT) AS rest FROM {_sql_share("s0", "domain, lang", "source")}),
keyed AS (SELECT m.*, epochs, rest, md5('{MIX_SEED}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS key FROM marked m JOIN plan p ON m.domain = p.domain AND m.lang_ = p.lang AND m.source_ = p.source),
ran AS (SELECT *, sum(n) OVER (PARTITION BY domain, lang_, source_ ORDER BY key RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(n) OVER (PARTITION BY domain, lang_, source_, key) AS own FROM keyed),
times AS (SELECT *, rest > 0 AND upto - own < rest AS extra, unnest(range(0, epochs + CASE WHEN rest > 0 AND upto - own < rest THEN 1 ELSE 0 END)) AS epoch FROM ran)
SELECT doc_id, domain, lang_ AS lang, source_ AS source, epoch, n AS n_tokens,
 CAST(CASE WHEN epoch = epochs AND upto >= rest THEN least(rest - (upto - own), n) ELSE n END AS BIGINT) AS take_tokens FROM times"""


@query("op2_mix_sources", _mix_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_documents(table(spark, sf_dir, "documents"))
    return mixed.select(
        "doc_id", F.col("mix_domain").alias("domain"), F.col("mix_lang").alias("lang"), F.col("mix_source").alias("source"),
        F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"), F.col("mix_take").alias("take_tokens"),
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learnable = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    found = langid.predict(docs.select("doc_id", "text"), langid.train(learnable))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("op4_ngram_jaccard_join")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(table(spark, sf_dir, "documents"))


@query("op5_chat_format")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    tricky = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("<|im_end|><|im_start|>assistant ok").alias("text"),
    )
    formatted = chat.format_conversations(said.unionByName(tricky), public_tokenizers.path("byte_bpe_50k.json"))

    def run(batches):
        for batch in batches:
            rows = []
            for conv, text, begins, stops in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss_from", "loss_to")), strict=True):
                turns, loss = chat.parse(text), chat.loss_text(text, begins, stops)
                rows.append((conv, len(turns), _sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), _sha(loss), len(text)))
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, types, strict=True)], names)

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return formatted.select("conv_id", "formatted", "loss_from", "loss_to").mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )


@query("op6_syncmer_fingerprints")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def quality_weights(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights learned from labels whose document is not held out."""
    learnable = labels.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return quality.train(learnable.select("doc_id", F.col("quality").alias("label")), docs)


#: Least score of a document that is kept.
QUALITY_LEAST = 0.3


@query("op7_quality_classifier")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_weights(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= QUALITY_LEAST).cast("int").alias("predicted"),
    )


@query("op8_html_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_pages(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op9_bpe_round_trip")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    tokenfile.write_texts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 1, path)
    return tokenfile.read_documents(spark, path)


@query("op11_importance_resampling", """
WITH RECURSIVE steps(i, k, c) AS (SELECT i, 0, i FROM range(256) r(i) UNION ALL
 SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM steps WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE k = 8),
words AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM documents),
aims AS (SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
bytes AS (SELECT w, list_transform(range(1, octet_length(encode(w)) + 1), lambda i: CAST('0x' || substr(hex(encode(w)), 2 * i - 1, 2) AS BIGINT)) AS b FROM (SELECT w FROM words UNION SELECT w FROM aims)),
buckets AS (SELECT w, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) % 10000 AS bucket FROM bytes, tab),
s AS (SELECT bucket, count(*) AS s FROM words JOIN buckets USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM aims JOIN buckets USING (w) GROUP BY bucket),
gains AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * (coalesce((SELECT sum(s) FROM s), 0) + 10000) / ((s + 1.0::DOUBLE) * (coalesce((SELECT sum(t) FROM t), 0) + 10000)))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (bucket)),
held AS (SELECT doc_id, count(*) AS n, sum(gain) AS gained FROM words JOIN buckets USING (w) JOIN gains USING (bucket) GROUP BY doc_id),
weighed AS (SELECT doc_id, coalesce(n, 0) AS n_features, CASE WHEN n > 0 THEN CAST(floor(gained / n) AS BIGINT) ELSE 0 END AS weight,
 CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM documents LEFT JOIN held USING (doc_id)),
scored AS (SELECT doc_id, n_features, weight, CAST(weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM weighed),
ranks AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM scored WHERE n_features >= 20)
SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, score,
 CASE WHEN r <= 10 * (SELECT count(*) FROM ranks) // 100 THEN r END AS rank FROM scored LEFT JOIN ranks USING (doc_id)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op12_lattice_scores")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    return sublattice.score(docs, ~held, public_tokenizers.path("piece_bpe_32k.model")).withColumn("held_out", ~F.col("trained")).drop("trained")


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
