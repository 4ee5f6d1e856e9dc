"""Stages of the pipeline on planted documents."""

import hashlib
import math
import random
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from sourcelode.llm import quality, queries
from sourcelode.llm.storage import written
from tests.llm.conftest import ODD_TEXTS
from tests.llm.test_models import plain_features
from tests.llm.test_texts import brute_components, edited, prose

COMMON = {
    "en": "the of and to in that is was he for it with as his on be at by had not are but from or have an they which one you were all her she there would their we him been has when who will no more if out so".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum haben nur oder".split(),
}
RUSSIAN = "съешь же ещё этих мягких французских булок да выпей чаю и ещё раз на дворе трава на траве дрова".split()
FINNISH = "kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan heille on annettu järki omatunto".split()


def text(rng, words, n=60):
    return " ".join(rng.choice(words) for _ in range(n))


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_language_stage_rejects_unlearned_languages(spark, documents):
    rng = random.Random(5)
    clean = [(i, text(rng, COMMON[lang]), lang, "s") for i, lang in enumerate(["en", "de"] * 60)]
    ids = iter(range(1000, 2000))
    foreign = [(next(ids), text(rng, words), None, "s") for words in (RUSSIAN, FINNISH) for _ in range(5)]
    tested = [i for i in ids if held_out(i)][:12]
    # Held-out rows: a wrong label on texts of unlearned and of learned languages.
    foreign += [(i, text(rng, RUSSIAN), "de", "s") for i in tested[:3]] + [(i, text(rng, FINNISH), "en", "s") for i in tested[3:6]]
    wrong = [(i, text(rng, COMMON["en"]), "de", "s") for i in tested[6:9]] + [(i, text(rng, COMMON["de"]), None, "s") for i in tested[9:]]
    empty = [(3000, None, "en", "s"), (3001, "12 %%", "de", "s")]
    got = corpus_pipeline.keep_languages(spark, documents(clean + foreign + wrong + empty), "").collect()
    want = {i: lang for i, _, lang, _ in clean} | dict.fromkeys(tested[6:9], "en") | dict.fromkeys(tested[9:], "de")
    assert {r["doc_id"]: r["lang"] for r in got} == want and len(got) == len(want)
    assert any(held_out(i) for i, *_ in clean)


def test_language_stage_without_labels(spark, documents):
    assert corpus_pipeline.keep_languages(spark, documents([(1, "the cat", None, "s")]), "").count() == 0


def odd(first=5000):
    """Rows that every stage has to take: odd texts, NULL in any column, repeated rows."""
    rows = [(first + i, t, "en", "src0") for i, t in enumerate(ODD_TEXTS)]
    return rows + [(None, "the cat sat on the mat", None, None), (None, None, None, None), (first, "the of and to in that", "en", None)] * 2


@pytest.fixture
def folder(spark, tmp_path):
    """A data folder with labels (doc_id, quality)."""

    def make(labels):
        path = tmp_path / f"data{len(labels)}"
        spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(path / "labels.parquet"))
        return str(path)

    return make


def with_clashes(docs):
    names = ["quality_score", "lang_pred", "lang_score", "mix_epoch", "component_id", "others_", "row_", "ids"]
    return docs.select("*", *(F.lit(f"own {n}").alias(n) for n in names))


def values(df):
    return sorted(map(repr, (tuple(r) for r in df.collect())))


def test_quality_stage_equals_plain_scores(spark, documents, folder):
    rng = random.Random(1)
    good = [(i, text(rng, COMMON["en"]), "en", "s") for i in range(120)]
    bad = [(1000 + i, " ### ".join(text(rng, COMMON["en"], 9).split()) + " !! $$", "en", "s") for i in range(120)]
    data = folder([(i, 1) for i, *_ in good[:90]] + [(i, 0) for i, *_ in bad[:90]])
    docs = with_clashes(documents(good + bad + odd()))
    got = corpus_pipeline.keep_quality(spark, docs, data)
    weights = queries.quality_weights(docs, queries.table(spark, data, "labels"))
    kept = [r for r in docs.collect() if 1 / (1 + math.exp(-sum(weights[i] * v for i, v in plain_features(r["text"]).items()))) >= 0.3]
    assert got.columns == docs.columns and values(got) == sorted(repr(tuple(r)) for r in kept)
    ids = {r["doc_id"] for r in kept}
    assert {i for i, *_ in good} <= ids and not ids & {i for i, *_ in bad}
    everything = corpus_pipeline.keep_quality(spark, docs, folder([]))
    assert values(everything) == values(docs)
    assert quality.score(docs, weights).count() == docs.count()


def test_language_stage_carries_columns(spark, documents):
    rng = random.Random(3)
    docs = with_clashes(documents([(i, text(rng, COMMON[lang]), lang, "s") for i, lang in enumerate(["en", "de"] * 30)] + odd()))
    got = corpus_pipeline.keep_languages(spark, docs, "")
    assert got.columns == docs.columns
    rows = {repr(r["doc_id"]): r for r in got.collect()}
    assert all(rows[str(i)]["lang"] == ["en", "de"][i % 2] and rows[str(i)]["lang_pred"] == "own lang_pred" for i in range(60))


def test_join_stage_keeps_the_first_of_each_group(spark, documents):
    rng = random.Random(7)
    rows = [(i, prose(rng, "xx", 120)) for i in range(20)]
    rows += [(100 + 10 * i + k, edited(rng, rows[i][1], 2)) for i in range(8) for k in range(3)] + [(3, prose(rng, "yy", 30))]
    rows = [(doc, t, "en", "s") for doc, t in rows] + odd()
    docs = with_clashes(documents(rows))
    got = corpus_pipeline.keep_one_of_each_group(spark, docs, "")
    group = {doc: c for doc, _, c in brute_components([(d, t) for d, t, *_ in rows if d is not None])}
    first = {}
    for row in docs.collect():
        doc = row["doc_id"]
        if doc is not None and group[doc] == doc:
            key = (row["text"] is not None, row["text"] or "", row["lang"] or "", row["source"] or "")
            first[doc] = min(first.get(doc, (key, row)), (key, row), key=lambda x: x[0])
    want = [r for _, r in first.values()] + [r for r in docs.collect() if r["doc_id"] is None]
    assert got.columns == docs.columns and values(got) == sorted(repr(tuple(r)) for r in want)


def test_mixing_stage_cuts_at_budgets(spark, documents):
    rng = random.Random(9)
    rows = [(i, text(rng, COMMON["en"], rng.randint(1, 40)), rng.choice(["en", "de", None]), rng.choice(["src0", "src5", "src8", "odd", None])) for i in range(200)]
    docs = with_clashes(documents(rows + odd()))
    got = corpus_pipeline.mix_to_weights(spark, docs, "")
    assert got.columns == docs.columns
    want = []
    for row in queries.mix_documents(corpus_pipeline.packed(docs)).collect():
        whole = row["text"]
        cut = whole
        if row["mix_take"] < row["mix_tokens"]:
            cut = whole[: [m.end() for m in re.finditer(r"\S+", whole)][row["mix_take"] - 1]]
        want.append((row["doc_id"], cut, row["lang"], row["source"], len(cut) if cut != whole else row["n_chars"], *row["others_"]))
    assert values(got) == sorted(map(repr, want)) and len(want) > 100


def test_encoding_stage_equals_the_library(spark, documents):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = with_clashes(documents(odd()))
    want = []
    for row in docs.collect():
        ids = library.encode(row["text"] or "", add_special_tokens=False).ids
        back = library.decode(ids, skip_special_tokens=False)
        want.append((row["doc_id"], len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), back))))
    assert values(corpus_pipeline.encode(spark, docs, "")) == sorted(map(repr, want))


def test_stages_of_an_empty_table(spark, documents, folder):
    data = folder([])
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents([]), data).collect() == []


def test_run_takes_all_stages(spark, documents, folder):
    rng = random.Random(4)
    rows = [(i, text(rng, COMMON[lang], 80), lang, "src0") for i, lang in enumerate(["en", "de"] * 40)]
    rows += [(900 + i, rows[i][1] + " x", "en", "src0") for i in range(10)] + [(950, text(rng, RUSSIAN), "en", "src0")]
    data = folder([(i, 1) for i in range(80)])
    documents(rows).write.parquet(f"{data}/documents.parquet")
    docs = documents(rows)
    for _, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, data), "stage")
    got = corpus_pipeline.run(spark, data).collect()
    assert sorted(map(repr, map(tuple, got))) == values(docs) and {r["doc_id"] for r in got} <= set(range(80)) and len(got) > 60
