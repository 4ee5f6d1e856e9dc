"""Top-k search against brute force and mixing against its budgets."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sourcelode.llm import mixing
from sourcelode.llm.topk import Block, Search, top_k


def brute(rows, k, scale=256.0):
    vectors = {}
    for at, vector in rows:
        if at is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        vectors[at] = min(vectors.get(at, vector), vector)
    codes = {at: [math.floor(scale * x) for x in v] for at, v in vectors.items()}
    out = []
    for q in codes:
        if q % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(codes[q], v)), at) for at, v in codes.items() if at != q)
        out += [(q, n, at, -minus) for n, (minus, at) in enumerate(scored[:k], 1)]
    return sorted(out)


def found(df, k):
    return sorted(tuple(r) for r in top_k(df, F.col("vec_id") % 50 == 0, k).collect())


def test_top_k_equals_brute_force_with_ties_nulls_and_repeated_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(16)]) for i in range(900)]
    same = [0.25, -0.5] * 8
    rows += [(i, same) for i in range(1000, 1500)]
    rows += [(50, None), (100, [None] * 16), (None, same), (2000, [float("nan")] * 16), (2050, [float("inf")] * 16), (150, same), (150, same)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label string, score int")
    assert found(df, 5) == brute(rows, 5)


def test_top_k_small_tables_and_vectors_of_other_lengths(spark):
    schema = "vec_id long, embedding array<float>"
    assert found(spark.createDataFrame([], schema), 5) == []
    assert found(spark.createDataFrame([(0, [1.0])], schema), 5) == []
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, []), (3, [0.5, 0.5, 9.0])]
    assert found(spark.createDataFrame(rows, schema), 5) == [(0, 1, 3, 98304), (0, 2, 1, 65536), (0, 3, 2, 0)]
    far = spark.createDataFrame([(0, [1.0]), (1, [-1e30]), (2, [0.5])], schema)
    assert found(far, 1) == [(0, 1, 2, 32768)]


def test_top_k_of_large_and_long_vectors(spark):
    schema, rng = "vec_id long, embedding array<double>", random.Random(9)
    rows = [(0, [1.0]), (1, [6e5]), (2, [7e5]), (3, [5e5])]
    assert found(spark.createDataFrame(rows, schema), 3) == [(0, 1, 2, 45875200000), (0, 2, 1, 39321600000), (0, 3, 3, 32768000000)]
    for size, width in ((2.0**19, 16), (2.0**40, 4), (3.0, 700), (2.0**27, 512)):
        rows = [(i, [rng.gauss(0, size) for _ in range(width)]) for i in range(120)]
        want = [(q, n, i, max(-(2**63), min(2**63 - 1, s))) for q, n, i, s in brute(rows, 5)]
        assert found(spark.createDataFrame(rows, schema), 5) == want


def test_lists_are_read_as_far_as_needed():
    rng = np.random.default_rng(3)
    queries = np.abs(rng.normal(60, 10, (20, 16))).astype(np.int64)
    few = rng.integers(-30, 30, (512, 16))
    few[:12] += 400  # some rows stand out in all lists
    for rows, most in ((few, 0.3), (rng.integers(-200, 200, (512, 16)), 1.0)):
        ids = np.arange(512)
        search = Search((1000 + np.arange(20)).tobytes(), queries.tobytes(), 16, 5)
        search.add(Block(ids.tobytes(), rows.astype(np.int64).tobytes(), 16))
        assert 0 < search.read <= most * search.entries
        scores = queries @ rows.T
        for at, best in enumerate(search.best):
            assert best == sorted(((int(s), i) for i, s in enumerate(scores[at])), key=lambda x: (-x[0], x[1]))[:5]


WEIGHTS = {"domain": {"a": 3, "b": 1}, "lang": {}, "source": {}}
DEFAULTS = {"domain": 1, "lang": 1, "source": 1}


def mixed(docs, share=1.0, epochs=4):
    return mixing.mix(docs, F.substring("source", 1, 1), WEIGHTS, DEFAULTS, share, epochs)


def words(n):
    return " ".join(["w"] * n)


def taken(df):
    out = {}
    for row in df.groupBy("mix_domain", "mix_lang", "mix_source").agg(F.sum("mix_take").alias("n")).collect():
        out[tuple(row)[:3]] = row["n"]
    return out


def test_shortage_goes_to_siblings_before_ancestors(documents):
    docs = documents(
        [(i, words(10), "en", "a1") for i in range(2)] + [(10 + i, words(10), "en", "a2") for i in range(40)]
        + [(100 + i, words(10), "en", "b1") for i in range(40)]
    )
    # 820 tokens: a gets 615, b 205. Of a, a1 can give 4 * 20; what it lacks goes to a2, not to b.
    assert taken(mixed(docs)) == {("a", "en", "a1"): 80, ("a", "en", "a2"): 535, ("b", "en", "b1"): 205}
    # With one pass a can give 420 only; the rest reaches b.
    assert taken(mixed(docs, epochs=1)) == {("a", "en", "a1"): 20, ("a", "en", "a2"): 400, ("b", "en", "b1"): 400}


def test_prefix_is_exact_and_in_seeded_order(documents):
    docs = documents([(i, words(7), "en", "b1") for i in range(50)])
    rows = mixed(docs, share=0.5).collect()
    assert sum(r["mix_take"] for r in rows) == 175
    assert sum(r["mix_take"] < r["mix_tokens"] for r in rows) <= 1
    again = mixed(docs.repartition(7), share=0.5).collect()
    assert sorted((r["doc_id"], r["mix_take"]) for r in rows) == sorted((r["doc_id"], r["mix_take"]) for r in again)


def test_whole_epochs_repeat_every_document(documents):
    docs = documents([(1, words(3), "en", "a1"), (2, words(1), "en", "a1"), (3, words(1000), "en", "b1")])
    rows = mixed(docs).where("mix_domain = 'a'").collect()
    assert sorted((r["doc_id"], r["mix_epoch"]) for r in rows) == [(d, e) for d in (1, 2) for e in range(4)]


def test_mix_odd_rows(documents, spark):
    assert mixed(documents([])).collect() == []
    assert mixed(documents([(1, None), (2, " ")])).collect() == []
    docs = documents([(None, words(3), None, None), (None, words(3), None, None), (5, words(2), "en", "a1"), (5, words(2), "en", "a1"), (6, None, "en", "a1")])
    docs = docs.withColumn("mix_epoch", F.lit("clash"))
    rows = mixed(docs).collect()
    # 10 tokens, and 2 more: both rows of a doc_id share a place, so both are taken up to the end.
    assert sum(r["mix_take"] for r in rows) == 12
    assert {r["mix_lang"] for r in rows} == {"unknown", "en"}
    assert set(rows[0].asDict()) == {*documents([]).columns, *(f"mix_{x}" for x in ("domain", "lang", "source", "tokens", "epoch", "take"))}


@pytest.mark.parametrize("take", [1, 2, 3])
def test_first_tokens(spark, take):
    df = spark.createDataFrame([(" a  b\nc ",)], "t string")
    assert df.select(mixing.first_tokens(F.col("t"), F.lit(take))).first()[0] == [" a", " a  b", " a  b\nc"][take - 1]
