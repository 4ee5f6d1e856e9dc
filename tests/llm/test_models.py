"""Language profiles, quality training and their features against plain Python."""

import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sourcelode.llm import langid, quality
from tests.llm.conftest import ODD_TEXTS

WORDS = {
    "aa": "the of and to in that is was he for it with as his on be at by had not are but from".split(),
    "bb": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch".split(),
    "cc": "что это как его она они мне все было так уже для вот от меня ещё нет из ему".split(),
}


def prose(rng, lang, n=50):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def plain_grams(text):
    words, word = [], ""
    for letter in (text or "").lower() + " ":
        if letter.isalpha():
            word += letter
        elif word:
            words.append(word)
            word = ""
    padded = " " + " ".join(words) + " "
    found = Counter(c for c in padded if c != " ")
    found.update(padded[i : i + 2] for i in range(len(padded) - 1) if words)
    found.update(padded[i : i + 3] for i in range(len(padded) - 2) if padded[i + 1] != " ")
    return Counter({tuple(map(ord, g)): n for g, n in found.items()}) if words else Counter()


def number(gram):
    value = 0
    for point in gram:
        value = (value << 21) | point
    return value


def ranked(counts, size):
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], number(x[0])))[:size]]


def plain_language(text, profiles, size):
    own = ranked(plain_grams(text), size)
    if not own or not profiles:
        return "und", 0.0
    away = {}
    for language, profile in sorted(profiles.items()):
        places = {g: at for at, g in enumerate(profile)}
        away[language] = sum(min(size, abs(places[g] - at)) if g in places else size for at, g in enumerate(own))
    best = min(sorted(away), key=lambda x: away[x])
    return best, 1 - away[best] / (size * len(own))


@pytest.mark.parametrize("size", [400, 25])
def test_out_of_place_distances_equal_plain_python(documents, size):
    rng = random.Random(size)
    rows = [(i, prose(rng, lang) + rng.choice(["", ".", " 12!", "\n"]), lang, "s") for i, lang in enumerate(["aa", "bb", "cc"] * 12)]
    rows += [(90, None, "aa", "s"), (91, "no label", None, "s"), (92, "", "bb", "s")]
    counts = {}
    for _, text, lang, _ in rows:
        if text is not None and lang is not None:
            counts.setdefault(lang, Counter()).update(plain_grams(text))
    profiles = {lang: ranked(c, size) for lang, c in counts.items()}
    trained = langid.train(documents(rows), size)
    asked = [(200 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(300 + i, prose(rng, lang, n)) for i, (lang, n) in enumerate((x, n) for x in WORDS for n in (1, 2, 9, 200))]
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.predict(documents(asked), trained).collect()}
    for doc, text in asked:
        language, score = plain_language(text, profiles, size)
        assert got[doc][0] == language and got[doc][1] == pytest.approx(score, abs=1e-12)


def test_features_count_words_pairs_and_shapes():
    texts = ["The the cat  sat, the cat!", "", "one", "A1 a1 B2 ... !!!"]
    buckets, values, bounds = quality.features(pa.array(texts))
    for at, text in enumerate(texts):
        want = Counter()
        for kind, words in enumerate((text.lower().split(), [shape(w) for w in text.split()])):
            want.update((kind, w) for w in words)
            want.update((kind, pair) for pair in zip(words, words[1:]))
            want.update((kind, "twice") for a, b in zip(words, words[1:]) if a == b)
        own = values[bounds[at] : bounds[at + 1]]
        length = math.sqrt(sum(want.values())) or 1
        assert sorted(own) == pytest.approx(sorted(math.sqrt(n) / length for n in want.values()))
        assert len(set(buckets[bounds[at] : bounds[at + 1]])) == len(want)


def shape(word):
    kinds = ["l" if c.islower() or ord(c) > 127 else "u" if c.isupper() else "d" if c.isdigit() else c for c in word]
    return "".join(k for i, k in enumerate(kinds) if i == 0 or kinds[i - 1] != k)


def plain_leader(examples, epochs, alpha=8.0, beta=1.0, l1=0.01):
    """Per-coordinate follow the regularised leader, one number at a time."""
    z, n = Counter(), Counter()

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha)

    for _ in range(epochs):
        for features, label in examples:
            own = {i: weight(i) for i in features}
            p = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(own[i] * v for i, v in features.items())))))
            for i, v in features.items():
                g = (p - label) * v
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
                z[i] += g - sigma * own[i]
                n[i] += g * g
    return {i: weight(i) for i in z}


def plain_features(text):
    buckets, values, _ = quality.features(pa.array([text or ""]))
    return {**{int(b): float(np.float32(v)) for b, v in zip(buckets, values)}, 1 << quality.BITS: 1.0}


def test_training_and_scores_equal_plain_python(documents, spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, "aa", 12) if i % 3 else " | ".join(prose(rng, "bb", 6).split())) for i in range(60)]
    rows += [(7, "zzz the repeated id"), (8, None), (None, "no id")]
    labels = [(i, int(i % 3 > 0)) for i in range(50)] + [(7, 0), (8, 1), (55, None), (None, 1), (56, 5)]
    frame = spark.createDataFrame(labels, "doc_id long, label int")
    weights = quality.train(frame, documents(rows), rows=40, shards=3, epochs=4)
    keys = {r["doc_id"]: r["k"] for r in spark.range(60).select(F.col("id").alias("doc_id"), F.xxhash64("id").alias("k")).collect()}
    known = {}
    for doc, label in labels:
        if doc is not None and label in (0, 1):
            known[doc] = max(known.get(doc, 0), label)
    chosen = sorted(known, key=lambda d: (keys[d], d))[:40]
    text_of = {}
    for doc, text in rows:
        if doc in chosen and text is not None:
            text_of[doc] = min(text_of.get(doc, text), text)
    want = Counter()
    for shard in range(3):
        own = [d for d in chosen if d in text_of and keys[d] % 3 == shard]
        for i, w in plain_leader([(plain_features(text_of[d]), known[d]) for d in own], 4).items():
            want[i] += w / 3
    assert max(abs(weights[i] - want[i]) for i in range(len(weights)) if weights[i] or want[i]) < 1e-4
    asked = rows + [(500 + i, t) for i, t in enumerate(ODD_TEXTS)]
    got = sorted((repr(r["doc_id"]), r["quality_score"]) for r in quality.score(documents(asked), weights).collect())
    brute = sorted((repr(d), 1 / (1 + math.exp(-sum(weights[i] * v for i, v in plain_features(t).items())))) for d, t in asked)
    assert [g[0] for g in got] == [b[0] for b in brute]
    assert [g[1] for g in got] == pytest.approx([b[1] for b in brute], abs=1e-4)


def test_a_repeated_id_is_one_example(documents, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, label int")
    once = quality.train(labels, documents([(1, "a b"), (2, "c d")]))
    many = quality.train(labels, documents([(1, "a b")] + [(2, f"c d{' x' * (i > 0)}") for i in range(400)]))
    assert (once == many).all()
