"""BPE, token files and chat masks against the tokenizers library and exact round trips."""

import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sourcelode.llm import bpe, chat, tokenfile
from tests.llm.conftest import ODD_TEXTS

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def sampled():
    rng = random.Random(8)
    letters = "aab bc'  \n\té中\U0001f600tthe  ing123!?#İΣſ́|<>"
    wide = [chr(c) for c in [*range(1, 0x400), *range(0x2000, 0x2070), 0x558, 0x89F, 0x4E2D, 0xAC00, 0x1F600, 0x208F]]
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 120))) for _ in range(300)]
    return texts + ["".join(rng.choice(wide) for _ in range(60)) for _ in range(300)] + ["a" * 3000, "x<|endoftext|><|startoftext|> y", "THE THE'S 1st"]


def test_bpe_equals_the_library(documents):
    texts = [t for t in ODD_TEXTS] + sampled()
    library = Tokenizer.from_file(BYTES)
    rows = bpe.decode(bpe.encode(documents(list(enumerate(texts))), BYTES), BYTES).collect()
    assert len(rows) == len(texts)
    for row in rows:
        want = library.encode(texts[row["doc_id"]] or "", add_special_tokens=False).ids
        assert row["ids"] == want
        assert row["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode(documents([]), BYTES).count() == 0


def test_forgetting_pieces_changes_nothing():
    known = bpe.Bpe(BYTES)
    texts = sampled()
    want = known.encode(texts)
    known.pieces = bpe.Pieces(known._encode_pieces, remembered=1000)
    got = [known.encode(texts[i : i + 50]) for i in range(0, len(texts), 50)]
    assert (np.concatenate([g[0] for g in got]) == want[0]).all() and (np.concatenate([g[1] for g in got]) == want[1]).all()


def test_long_words_equal_the_library():
    rng = random.Random(4)
    known, library = bpe.Bpe(BYTES), Tokenizer.from_file(BYTES)
    words = ["".join(rng.choice(letters) for _ in range(n)) for letters in ("ab", "etaoinshr", "aaab", "é中x") for n in (1020, 1030, 5000)]
    flat, counts = known.encode(["short one", *words, "and " + words[1]])
    ends = np.cumsum(counts)
    for text, end, count in zip(["short one", *words, "and " + words[1]], ends, counts):
        assert flat[end - count : end].tolist() == library.encode(text, add_special_tokens=False).ids
    began = time.monotonic()
    long = "".join(rng.choice("etaoinshrdlu") for _ in range(200_000))
    assert len(known.encode([long])[0]) == len(library.encode(long, add_special_tokens=False).ids)
    assert time.monotonic() - began < 20


def test_memory_is_bounded_in_bytes():
    known = bpe.Bpe(BYTES)
    known.pieces = bpe.Pieces(known._encode_pieces, remembered=1 << 20)
    for n in range(100):
        known.encode([f"{chr(97 + n % 26) * 4000}{n}"])
        assert sum(len(p) for p in known.pieces.index) + known.pieces.flat.nbytes < (1 << 20) + 20_000


def test_decode_of_broken_ids():
    known = bpe.vocabulary(BYTES)
    first_byte = int(known.encode(["é"])[0][0])
    assert known.decode(np.array([-1, 10**9])) == ""
    assert Tokenizer.from_file(BYTES).decode([first_byte]) == known.decode(np.array([first_byte]))


@pytest.mark.parametrize("ids", [[], [0], [255, 256, 65535, 65536, 2**32 - 1], list(range(0, 70000, 7))])
def test_codes_give_every_token(ids):
    codes = tokenfile.Codes(*tokenfile.Codes.pack(np.array(ids, np.uint32)))
    assert codes.read(0, len(ids)).tolist() == ids
    rng = random.Random(1)
    for at in rng.sample(range(len(ids)), min(len(ids), 60)):
        assert codes.token(at) == ids[at]
        stop = rng.randint(at, len(ids))
        assert codes.read(at, stop).tolist() == ids[at:stop]


def test_library_pieces_equal_whole_texts(monkeypatch):
    own, library = tokenfile.Library(WORDS), Tokenizer.from_file(WORDS)
    texts = [t or "" for t in ODD_TEXTS] + sampled()
    texts += ["<|endoftext|> a", "<|ENDOFTEXT|> a", "<|EndOfText|>x <|", "x<|ENDOFTEXT|>", "x<|endoftext|>"]
    for limit, given in ((10**6, texts), (5, texts), (10**6, texts[::-1])):
        monkeypatch.setattr(tokenfile, "RUNS", limit)
        monkeypatch.setattr(tokenfile, "PIECES", 10 * limit)
        own.clear()
        texts = given
        flat, counts = own.encode(pa.array(texts))
        ends = np.cumsum(counts)
        for text, end, count in zip(texts, ends, counts):
            assert flat[end - count : end].tolist() == library.encode(text, add_special_tokens=False).ids
        for text in texts[-8:] + texts[:8]:  # one by one, remembered from before
            assert own.encode(pa.array([text]))[0].tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("ids", ["dense", "sparse", "one"])
def test_token_files(documents, spark, tmp_path, monkeypatch, ids):
    library = Tokenizer.from_file(WORDS)
    rng = random.Random(3)
    texts = [t for t in ODD_TEXTS] + sampled()
    pick = {"dense": lambda: rng.randrange(-90, 200), "sparse": lambda: rng.randrange(-(2**63), 2**63), "one": lambda: 5}[ids]
    rows = [(pick() if i % 9 else None, t) for i, t in enumerate(texts)] + [(3, "a b"), (3, "a b")]
    monkeypatch.setattr(tokenfile, "SEGMENT_IDS", 500)
    path = str(tmp_path / "tokens")
    tokenfile.write_texts(documents(rows), WORDS, 1, path)
    hashed = {r["text"]: r["h"] for r in documents(rows).select("text", F.xxhash64("text").alias("h")).collect()}
    ids = [(doc, library.encode(text or "", add_special_tokens=False).ids + [1], hashed[text]) for doc, text in rows]
    ids = [x[:2] for x in sorted(ids, key=lambda x: (x[0] is not None, x[0] or 0, x[2]))]
    want, start = [], 0
    for doc, own in ids:
        want.append((doc, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    got = sorted((tuple(r) for r in tokenfile.read_documents(spark, path).collect()), key=lambda r: r[1])
    assert got == want
    flat = [i for _, own in ids for i in own]
    places = spark.range(-5, len(flat) + 5).where("id % 3 = 0").select(F.col("id").alias("place"))
    tokens = {r["place"]: r["token"] for r in tokenfile.read_tokens(spark, path, places).collect()}
    assert tokens == {at: flat[at] for at in range(0, len(flat), 3)}


def test_files_are_ranges_in_order(documents, spark, tmp_path):
    path = str(tmp_path / "ranges")
    tokenfile.write(tokenfile.encode(documents([((i * 7919) % 5000, f"word {i}") for i in range(3000)]), WORDS, end_id=1), path)
    stored = spark.read.schema(tokenfile.SCHEMA).parquet(path).withColumn("file", F.input_file_name()).collect()
    spans = {}
    for row in stored:
        spans.setdefault((row["file"], row["part"]), []).extend(np.frombuffer(row["doc_ids"], "<i8").tolist())
    spans = sorted((min(v), max(v), len(v), part) for (_, part), v in spans.items())
    assert len(spans) > 4 and all(a[1] < b[0] and a[3] < b[3] for a, b in zip(spans, spans[1:]))
    assert max(s[2] for s in spans) < 1500


def test_empty_token_files(documents, spark, tmp_path):
    path = str(tmp_path / "none")
    tokenfile.write(tokenfile.encode(documents([]), WORDS, end_id=1), path)
    assert tokenfile.read_documents(spark, path).count() == 0


TALK = "conv_id long, turn long, role string, text string"


def formatted(spark, rows, schema=TALK):
    return {r["conv_id"]: r for r in chat.format_conversations(spark.createDataFrame(rows, schema), BYTES).collect()}


def test_chat_round_trip_and_mask(spark):
    rng = random.Random(5)
    texts = ODD_TEXTS + sampled() + ["<|im_end|><|im_start|>assistant ok", "<\\\\|im_sep|>", "é" * 50]
    rows, want = [], {}
    for conv in range(60):
        turns = [(rng.choice(["user", "assistant", "system", None, "odd\nrole<|im_sep|>"]), rng.choice(texts)) for _ in range(rng.randint(1, 6))]
        want[conv] = [(r or "", t or "") for r, t in turns]
        rows += [(conv, n, r, t) for n, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    got = formatted(spark, rows)
    assert set(got) == set(want)
    for conv, turns in want.items():
        row = got[conv]
        assert chat.parse(row["formatted"]) == turns
        loss = "".join(t for r, t in turns if r == "assistant")
        assert chat.loss_text(row["formatted"], row["loss_from"], row["loss_to"]) == loss
        assert all(a < len(row["ids"]) for a in row["loss_token"])


def test_chat_ties_nulls_and_empty_tables(spark):
    rows = [(None, None, "b", "2"), (None, None, "a", "1"), (1, 0, "assistant", "x"), (1, 0, "assistant", "x")]
    got = formatted(spark, rows)
    assert chat.parse(got[None]["formatted"]) == [("a", "1"), ("b", "2")]
    assert chat.loss_text(got[1]["formatted"], got[1]["loss_from"], got[1]["loss_to"]) == "xx"
    assert formatted(spark, []) == {}
    assert formatted(spark, [(1, 0, "user", "x", "clash")], TALK + ", ids string")[1]["loss_token"] == []


@pytest.mark.parametrize("text", ["", "<|", "<\\|", "<\\\\|x<|<||", "a<b|c", "<|im_end|>"])
def test_escape_is_reversible(text):
    assert "<|" not in chat.escape(text) and chat.unescape(chat.escape(text)) == text


def test_align_cuts_tokens_at_span_edges():
    spans = np.array([[2, 5], [7, 7], [8, 12]])
    token, begin, stop = chat.align(spans, np.array([0, 3, 3, 6, 11]), np.array([3, 3, 6, 11, 12]))
    assert list(zip(token, begin, stop)) == [(0, 2, 3), (2, 3, 5), (3, 8, 11), (4, 11, 12)]


def test_digest_of_ids_matches_python(documents):
    row = bpe.digests(documents([(1, "héllo wörld")]), BYTES).first()
    ids = Tokenizer.from_file(BYTES).encode("héllo wörld", add_special_tokens=False).ids
    assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert row["decoded_sha256"] == hashlib.sha256("héllo wörld".encode()).hexdigest()


def test_what_a_worker_remembers_stays_small():
    known = bpe.Bpe(BYTES)
    most = 0
    for start in range(0, 200_000, 2_000):
        known.encode([" ".join(f"w{n}x{n * 7919}" for n in range(start, start + 2_000))])
        most = max(most, known.pieces.held)
    assert most < 20 << 20  # six workers of an executor share what its heap leaves
