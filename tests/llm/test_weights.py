"""Importance resampling, lattice likelihoods and whitening against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sourcelode.llm import queries, resampling, sublattice, whitening
from tests.llm.conftest import ODD_TEXTS

PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def lowered(text):
    return (text or "").translate(LOWER)


def plain_draw(rows, target, percent, least, buckets, n_max, seed=2024):
    def features(text):
        words = WORD.findall(lowered(text))
        grams = [" ".join(words[i : i + n]) for n in range(1, n_max + 1) for i in range(len(words) - n + 1)]
        return len(words), [zlib.crc32(g.encode()) % buckets for g in grams]

    source, aim = Counter(), Counter()
    for _, text in rows:
        source.update(features(text)[1])
    for text in target:
        aim.update(features(text)[1])
    s_all, t_all = sum(source.values()), sum(aim.values())
    gain = {b: math.floor(1000 * math.log((aim[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets)))) for b in source}
    out = []
    for doc, text in rows:
        n, own = features(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc, len(own), weight, score, n])
    pool = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    need = len(pool) * percent // 100
    drawn = sorted(((*r[:4], at) for at, r in enumerate(pool[:need], 1)), key=repr)
    return drawn, sorted((tuple(r[:4]) for r in pool[need:] + [r for r in out if r[4] < least]), key=repr)


def split_drawn(df):
    rows = [tuple(r) for r in df.collect()]
    return sorted((r for r in rows if r[4] is not None), key=repr), sorted((r[:4] for r in rows if r[4] is None), key=repr)


@pytest.mark.parametrize(("n_max", "percent"), [(1, 10), (2, 37), (3, 100)])
def test_resampling_equals_plain_python(spark, documents, n_max, percent):
    rng = random.Random(4)
    vocabulary = ["The", "cat", "ÄB", "x9", "naïve", "中文", "of", "z"]
    rows = [(i, "-".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 60)))) for i in range(400)]
    rows += [(1000 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "the cat " * 20)] * 3
    rows += [(7, "same text again " * 9)] * 150  # one id, one text
    target = ["the cat", None, "x9 x9 of", ""]
    aims = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    docs = documents(rows).withColumn("score", F.lit("clash")).withColumn("rank", F.lit(1))
    got = split_drawn(resampling.resample(docs, aims, percent=percent, buckets=300, longest=n_max))
    assert got == plain_draw(rows, target, percent, 20, 300, n_max)


def test_resampling_small_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resample(documents([]), none).collect() == []
    rows = resampling.resample(documents([(1, "a b"), (2, None), (None, None)]), none).collect()
    assert len(rows) == 3 and all(r["rank"] is None for r in rows)
    assert split_drawn(resampling.resample(documents([(None, "a " * 30)] * 4), none, percent=50)) == plain_draw([(None, "a " * 30)] * 4, [], 50, 20, 10000, 1)


def test_words_of_long_texts_come_in_parts():
    text = "ab Cd9 " * 5000 + "x" * 3000 + " é"
    found = [list(f) for f, _ in resampling.feature_buckets(text.encode(), 1, 3, 977)]
    words = WORD.findall(lowered(text))
    want = Counter(zlib.crc32(" ".join(words[i : i + n]).encode()) % 977 for n in (1, 2, 3) for i in range(len(words) - n + 1))
    assert Counter(x for part in found for x in part) == want
    from sourcelode.llm.words import byte_words

    parts = list(byte_words(text.encode(), resampling._TABLE, 100))
    assert len(parts) > 100 and [w for p in parts for w in p] == [w.encode() for w in words]


def brute_word(vocabulary, word):
    """Probability and expected pieces by listing every segmentation."""
    word, at = sublattice.MARK + word, {p: i for i, p in enumerate(vocabulary.pieces)}
    ways = []

    def walk(start, log, used):
        if start == len(word):
            ways.append((log, used))
        for stop in range(start + 1, len(word) + 1):
            piece = at.get(word[start:stop])
            if piece is not None:
                walk(stop, log + vocabulary.logs[piece], [*used, piece])

    walk(0, 0.0, [])
    total = math.fsum(math.exp(log) for log, _ in ways)
    expected = Counter()
    for log, used in ways:
        for piece in used:
            expected[piece] += math.exp(log) / total
    return math.log(total), expected


@pytest.fixture(scope="module")
def small_vocabulary():
    pieces = [b" a", b"ab", b"aba", b"b", b"a", b"c", b" ", b" ab", b"bc", "é".encode(), b"cc"] + [bytes([x]) for x in range(256) if bytes([x]) not in (b"a", b"b", b"c", b" ")]
    weights = np.random.default_rng(3).random(len(pieces)) + 0.05
    return sublattice.Vocabulary(pieces, np.log(weights / weights.sum()))


def test_forward_sums_all_segmentations(small_vocabulary, monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 9))).encode() for _ in range(60)] + ["éa".encode(), b"\xff", b"zz"]
    weights = [rng.randint(1, 9) for _ in words]
    want_logs, want = [], np.zeros(len(small_vocabulary.pieces))
    for word, n in zip(words, weights):
        log, expected = brute_word(small_vocabulary, word)
        want_logs.append(log)
        for piece, share in expected.items():
            want[piece] += n * share
    for long_word, group in ((256, 1 << 17), (256, 10), (2, 1 << 17)):  # together, in small groups, one by one
        monkeypatch.setattr(sublattice, "LONG_WORD", long_word)
        monkeypatch.setattr(sublattice, "GROUP_BYTES", group)
        counts = np.zeros(len(want))
        assert np.allclose(small_vocabulary.likelihoods(words, counts, weights), want_logs, rtol=1e-12)
        assert np.allclose(counts, want, rtol=1e-9)


def test_long_words_do_not_underflow(small_vocabulary):
    word = b"abcab" * 20000
    counts = np.zeros(len(small_vocabulary.pieces))
    log = small_vocabulary.likelihoods([word], counts, [1])[0]
    short = small_vocabulary.likelihoods([b"abcab" * 50])[0]
    assert math.isfinite(log) and 300 < log / short < 500
    assert sum(n * len(small_vocabulary.pieces[p]) for p, n in enumerate(counts)) == pytest.approx(len(word) + 1, rel=1e-6)


def test_probabilities_of_pieces_add_up(spark, documents):
    docs = documents([(1, "The cat sat"), (2, "the dog"), (3, None)]).withColumn("trained", F.lit(True))
    known, end = sublattice.fit(sublattice.word_counts(docs), sublattice.Vocabulary.read(PIECES))
    assert math.fsum(np.exp(known.logs)) + math.exp(end) == pytest.approx(1.0, rel=1e-12)


def held(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 1 if doc is not None else False


def plain_scores(rows):
    words = {i: [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", lowered(t))] for i, (_, t) in enumerate(rows)}
    counts = Counter(w for i, (doc, _) in enumerate(rows) if not held(doc) for w in [*words[i], b""])
    n, v = sum(counts.values()), len(counts)
    known = sublattice.Vocabulary.read(PIECES)
    prior = np.exp(known.logs) * sublattice.PRIOR * len(known.pieces)
    ends = counts[b""]
    for _ in range(2):
        expected = np.zeros(len(known.pieces))
        for word, c in counts.items():
            if word:
                known.likelihoods([word], expected, [c])
        rest = expected.sum() + prior.sum() + ends + 0.5
        known = sublattice.Vocabulary(known.pieces, np.log((expected + prior) / rest))
    out = []
    for i, (doc, _) in enumerate(rows):
        tokens = [*words[i], b""]
        base = math.fsum(math.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens)
        log = math.fsum(known.likelihoods([t])[0] if t else math.log((ends + 0.5) / rest) for t in tokens) / math.log(10)
        out.append((doc, held(doc), len(tokens), sum(counts[t] > 0 for t in tokens), n, base, log))
    return out


@pytest.mark.parametrize("frequent", [0, 3, 1 << 16])
def test_scores_equal_plain_python(documents, monkeypatch, frequent):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(["the", "cat", "Tiger", "über", "x" + str(i % 7)]) for _ in range(rng.randint(0, 30)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD_TEXTS)] + [(None, "the cat"), (None, "the cat"), (5, "the cat"), (6, "y" * 70 + " " + "y" * 70)]
    monkeypatch.setattr(sublattice, "HELD", 3 if frequent == 3 else 100_000)
    docs = documents(rows).withColumn("score", F.lit("clash")).withColumn("n_tokens", F.lit("clash"))
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))
    got = sublattice.score(docs, ~held_out, PIECES, frequent=frequent).collect()
    got = sorted(((r["doc_id"], not r["trained"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in got), key=repr)
    for have, want in zip(got, sorted(plain_scores(rows), key=repr), strict=True):
        assert have[:5] == want[:5] and have[5:] == pytest.approx(want[5:], rel=1e-9)


def test_scores_of_small_tables(documents):
    assert sublattice.score(documents([]), F.lit(True), PIECES).collect() == []
    row = sublattice.score(documents([(1, "cat")]), F.lit(None).cast("boolean"), PIECES).first()
    assert (row["train_tokens"], row["n_known"], row["n_tokens"], row["trained"]) == (0, 0, 2, False)
    assert row["base_score"] == 0.0 and math.isfinite(row["score"]) and row["score"] < 0


def test_model_prefers_seen_text(documents):
    rows = [(i, "the quick brown fox jumps over the lazy dog") for i in range(40)]
    rows += [(1001, "the lazy fox jumps"), (1002, "qzx vvk jjq wpxz")]
    got = {r["doc_id"]: r["score"] for r in sublattice.score(documents(rows), F.col("doc_id") < 1000, PIECES).collect()}
    assert got[1001] > got[1002] + 5


def plain_whitening(rows, most=32):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    width = max((len(v) for _, v in good), default=0)
    x = [[math.floor(64.0 * c) + 1_000_000 for c in v] + [1_000_000] * (width - len(v)) for _, v in good]
    n, sums = len(x), [sum(column) for column in zip(*x)]
    exact = [[n * c - s for c, s in zip(row, sums)] for row in x]
    centred = np.array(exact, float) / max(n, 1)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    rank = int((values > 1e-12 * values[0]).sum())
    return [i for i, _ in good], [sum(c * c for c in row) for row in exact], centred, values, vectors[:, : min(most, rank)]


def check_whitening(spark, rows, schema="vec_id long, embedding array<double>, n string, component string", **options):
    df = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], schema).repartition(5)
    got = whitening.whiten(df, **options).collect()
    ids, deviations, centred, values, vectors = plain_whitening(rows)
    count = vectors.shape[1]
    assert len(got) == len(ids) * count
    assert {r["n"] for r in got} <= {len(ids)}
    assert sorted((repr(r["vec_id"]), r["deviation"]) for r in got if r["component"] == 1) == sorted((repr(i), d if d < 2**63 else None) for i, d in zip(ids, deviations))
    assert all(r["identity_error"] < 1e-8 for r in got)
    explained = {r["component"]: r["explained"] for r in got}
    assert np.allclose([explained[c] for c in range(1, count + 1)], values[:count] / values.sum(), rtol=1e-9)
    return got, ids, centred, values, vectors


def test_whitening_equals_eigenvectors(spark, monkeypatch):
    rng = np.random.default_rng(1)
    vectors = rng.standard_normal((700, 40)) * np.linspace(3, 0.2, 40)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(None, [0.5] * 40), (8003, [0.25] * 40), (8003, [0.25] * 40), (9001, None), (9002, [None] * 40), (9003, [float("nan")] * 40), (9004, [float("-inf")] * 40)]
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * 40 * 50)
    got, ids, centred, values, axes = check_whitening(spark, rows)
    want = centred @ axes / np.sqrt(values[: axes.shape[1]])
    for component in range(1, 33):
        own = {r["vec_id"]: r["whitened"] for r in got if r["component"] == component}
        mine = np.array([own[i] for i in ids])
        other = dict(zip(ids, want[:, component - 1]))
        other = np.array([other[i] for i in ids])
        sign = 1 if mine @ other > 0 else -1
        assert np.abs(mine - sign * other).max() < 1e-8


@pytest.mark.parametrize("case", ["equal", "rank", "lengths", "large", "wide", "few"])
def test_whitening_of_odd_vectors(spark, case):
    rng = np.random.default_rng(2)
    rows = {
        # Eigenvalues that occur several times.
        "equal": [(2 * i + s, [float((1 - 2 * s) * (j == i)) for j in range(6)]) for i in range(6) for s in (0, 1)],
        "rank": [(i, (rng.integers(-5, 5, 3) @ rng.integers(-2, 3, (3, 3)) @ np.eye(3, 9)).tolist()) for i in range(50)],
        "lengths": [(i, rng.standard_normal(i % 4).tolist()) for i in range(60)],
        "large": [(i, (rng.standard_normal(4) * 1e12).tolist()) for i in range(40)],
        "wide": [(i, rng.standard_normal(70).tolist()) for i in range(200)],
        "few": [(i, rng.standard_normal(12).tolist()) for i in range(5)],
    }[case]
    check_whitening(spark, rows)


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    for rows in ([], [(1, [0.5, 1.0])], [(1, [0.5]), (2, [0.5])], [(1, []), (2, [])], [(1, None)]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []
    far = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.5]), (3, [1e30, 0.0]), (4, [0.5, 0.25])], schema)
    assert {r["vec_id"] for r in whitening.whiten(far).collect()} == {1, 2, 4}


def test_registered():
    assert {"op11_importance_resampling", "op12_lattice_scores", "op13_embedding_whitening"} <= set(queries.QUERIES)
