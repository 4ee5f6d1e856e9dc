"""Probability of texts over all segmentations of their words into pieces of an existing vocabulary."""

from __future__ import annotations

import hashlib
import math
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sourcelode.llm.storage import written
from sourcelode.llm.words import byte_words, slices

#: A-Z become a-z, ASCII white space ends a word.
_TABLE = bytes(32 if c in (9, 10, 11, 12, 13) else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: The byte that stands before each word; none holds it.
MARK = b" "
#: Bytes of words whose lattices are built at once, and the length from which a word is walked alone.
GROUP_BYTES, LONG_WORD = 1 << 17, 256
#: Longer words are known by a digest when documents look for them.
KEY_BYTES = 64
#: Most frequent words that every task holds: at most this many keys of KEY_BYTES.
FREQUENT = 1 << 16
#: Entries and bytes of words that a task holds before it hands them on.
HELD, HELD_BYTES = 100_000, 8 << 20
#: Pseudo-counts per piece, dealt by the file's scores.
PRIOR = 0.1


class Vocabulary:
    """Pieces of a vocabulary as a table of byte transitions, with their log probabilities.

    A state is a prefix of a piece; the key of a transition is ``state * 256 + byte``.
    """

    def __init__(self, pieces: list[bytes], logs: np.ndarray):
        self.pieces, self.logs = pieces, logs
        steps: dict[int, int] = {}
        ends: dict[int, int] = {}
        for at, piece in enumerate(pieces):
            state = 0
            for byte in piece:
                state = steps.setdefault(state * 256 + byte, len(steps) + 1)
            ends[state] = at
        keys = np.fromiter(steps.keys(), np.int64, len(steps))
        order = np.argsort(keys)
        self.keys, self.states = keys[order], np.fromiter(steps.values(), np.int64, len(steps))[order]
        self.piece_of = np.full(len(steps) + 1, -1, np.int64)
        self.piece_of[list(ends)] = list(ends.values())

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """Pieces of a sentencepiece model that lower-cased words can hold, and every single byte.

        The scores of the file say how likely a piece is: a unigram model's are log probabilities, a
        merge vocabulary's are the ranks of its merges, of which the r-th counts as 1 / r.
        """
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        scores = {}
        for at in range(model.get_piece_size()):
            piece = MARK.join(part.encode() for part in model.id_to_piece(at).split("▁"))
            whole = not (model.is_byte(at) or model.is_control(at) or model.is_unknown(at) or model.is_unused(at))
            if whole and piece not in (b"", MARK) and MARK not in piece[1:] and piece == piece.translate(_TABLE):
                scores[piece] = model.get_score(at)
        by_score = sorted(scores, key=lambda p: (-scores[p], p))
        lone = [bytes([b]) for b in range(256) if bytes([b]) not in scores]
        ranked = all(float(s).is_integer() for s in scores.values())
        likely = [1 / rank for rank in range(1, len(by_score) + 1)] if ranked else [math.exp(scores[p]) for p in by_score]
        likely += [min(likely, default=1.0)] * len(lone)
        return cls(by_score + lone, np.log(np.array(likely) / math.fsum(likely)))

    def edges(self, flat: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All places where a piece stands: first byte, byte behind it, piece. ``ends`` has for each
        byte the end of its word."""
        begin = np.arange(len(flat))
        at, state, found = begin, np.zeros(len(flat), np.int64), []
        while len(at):
            inside = at < ends[begin]
            begin, at, state = begin[inside], at[inside], state[inside]
            key = state * 256 + flat[at]
            place = np.searchsorted(self.keys, key)
            place[place == len(self.keys)] = 0
            known = self.keys[place] == key
            begin, at, state = begin[known], at[known] + 1, self.states[place[known]]
            piece = self.piece_of[state]
            whole = piece >= 0
            found.append((begin[whole], at[whole], piece[whole]))
        return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in range(3))

    def _scalar_steps(self, word: bytes) -> Iterator[tuple[int, int, int]]:
        if not hasattr(self, "_steps"):
            self._steps = dict(zip(self.keys.tolist(), self.states.tolist(), strict=True))
            self._piece_list = self.piece_of.tolist()
        steps, piece_of = self._steps, self._piece_list
        for begin in range(len(word)):
            state = 0
            for at in range(begin, len(word)):
                state = steps.get(state * 256 + word[at])
                if state is None:
                    break
                if piece_of[state] >= 0:
                    yield begin, at + 1, piece_of[state]

    def _long(self, word: bytes, counts: np.ndarray | None, weight: int) -> float:
        """One long word by itself: forward, and backward if ``counts`` is to be added to."""
        logs, low = self.logs, -math.inf

        def add(values, at, more):
            old = values[at]
            values[at] = more if old == low else max(old, more) + math.log1p(math.exp(-abs(old - more)))

        ahead = array("d", [0.0]) + array("d", [low]) * len(word)
        for begin, stop, piece in self._scalar_steps(word):
            add(ahead, stop, ahead[begin] + logs[piece])
        if counts is not None:
            # Backward from the end: words are walked in pieces of their own, last ones first.
            behind = array("d", [low]) * len(word) + array("d", [0.0])
            span = 4096
            for start in range((len(word) - 1) // span * span, -1, -span):
                own = [(b, s, p) for b, s, p in self._from(word, start, min(len(word), start + span))]
                for begin, stop, piece in reversed(own):
                    add(behind, begin, behind[stop] + logs[piece])
                    counts[piece] += weight * math.exp(ahead[begin] + logs[piece] + behind[stop] - ahead[-1])
        return ahead[-1]

    def _from(self, word: bytes, start: int, stop: int) -> Iterator[tuple[int, int, int]]:
        longest = max(map(len, self.pieces))
        for begin, end, piece in self._scalar_steps(word[start : stop + longest]):
            if begin >= stop - start:
                break
            yield begin + start, end + start, piece

    def likelihoods(self, words: list[bytes], counts: np.ndarray | None = None, weights: list[int] | None = None) -> np.ndarray:
        """Natural log of each word's probability, summed over all segmentations of it.

        Forward recursion in log space, for all words of a group at once, place by place. If
        ``counts`` is given, the expected number of each piece, times the word's weight, is added to it: the
        backward recursion gives each edge the share of the probability that goes through it.
        """
        out = np.zeros(len(words))
        order = sorted(range(len(words)), key=lambda at: len(words[at]))
        group: list[int] = []
        held = 0
        for at in order:
            if len(words[at]) > LONG_WORD:
                out[at] = self._long(MARK + words[at], counts, weights[at] if weights else 1)
                continue
            if held and held + len(words[at]) > GROUP_BYTES:
                self._group(words, group, out, counts, weights)
                group, held = [], 0
            group.append(at)
            held += len(words[at]) + 1
        if group:
            self._group(words, group, out, counts, weights)
        return out

    def _group(self, words: list[bytes], group: list[int], out: np.ndarray, counts: np.ndarray | None, weights: list[int] | None) -> None:
        lengths = np.array([len(words[at]) + 1 for at in group], np.int64)
        flat = np.frombuffer(MARK + MARK.join(words[at] for at in group), np.uint8)
        stops = np.cumsum(lengths)
        begin, stop, piece = self.edges(flat, np.repeat(stops, lengths))
        of = np.searchsorted(stops, begin, "right")
        first = stops - lengths
        # Places: one more per word than it has bytes.
        source, aim, log = begin + of, stop + of, self.logs[piece]
        ahead = np.full(len(flat) + len(group), -np.inf)
        ahead[first + np.arange(len(group))] = 0.0
        last = stops + np.arange(len(group))
        self._sweep(ahead, source, aim, log, stop - first[of])
        out[group] = ahead[last]
        if counts is not None:
            behind = np.full(len(ahead), -np.inf)
            behind[last] = 0.0
            self._sweep(behind, aim, source, log, lengths[of] - (begin - first[of]))
            share = np.exp(ahead[source] + log + behind[aim] - ahead[last][of])
            counts += np.bincount(piece, share * np.array([weights[at] for at in group], np.float64)[of], len(counts))

    @staticmethod
    def _sweep(values: np.ndarray, source: np.ndarray, aim: np.ndarray, log: np.ndarray, turn: np.ndarray) -> None:
        """values[aim] becomes the log of the sum of exp(values[source] + log) over all edges to it,
        by rising ``turn`` (the distance of ``aim`` from where the sweep begins)."""
        order = np.lexsort((aim, turn))
        source, aim, log, turn = source[order], aim[order], log[order], turn[order]
        bounds = np.flatnonzero(np.concatenate(([True], turn[1:] != turn[:-1], [True]))) if len(turn) else []
        for start, stop in zip(bounds[:-1], bounds[1:], strict=True):
            to = aim[start:stop]
            firsts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            sums = values[source[start:stop]] + log[start:stop]
            top = np.maximum.reduceat(sums, firsts)
            sizes = np.diff(np.append(firsts, len(to)))
            values[to[firsts]] = top + np.log(np.add.reduceat(np.exp(sums - np.repeat(top, sizes)), firsts))


def word_counts(docs: DataFrame) -> DataFrame:
    """word (binary), c (times it occurs in rows whose ``trained`` is true) and seen (in all rows).

    Every text ends with an empty word, which stands for the end. Tasks add up their own words first, so that a
    word of a third of all places is one row per task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {True: Counter(), False: Counter()}
        size = 0

        def flush():
            learned, other = held[True], held[False]
            words = list(learned | other)
            columns = [pa.array(words, pa.binary()), pa.array([learned[w] for w in words], pa.int64()), pa.array([learned[w] + other[w] for w in words], pa.int64())]
            learned.clear()
            other.clear()
            yield pa.RecordBatch.from_arrays(columns, ["word", "c", "seen"])

        for batch in batches:
            for start, stop in slices(batch.column(0)):
                part = batch.slice(start, stop - start)
                for text, trained in zip(part.column(0).cast(pa.binary()).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = held[bool(trained)]
                    own[b""] += 1
                    for words in byte_words(text or b"", _TABLE):
                        before = len(own)
                        own.update(words)
                        if len(own) > before:
                            size += sum(map(len, words))
                        if size > HELD_BYTES or len(held[True]) + len(held[False]) > HELD:
                            yield from flush()
                            size = 0
        yield from flush()

    counted = docs.select("text", "trained").mapInArrow(run, "word binary, c long, seen long")
    return counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("seen").alias("seen"))


def _parts(batch: pa.RecordBatch, column: int = 0) -> Iterator[pa.RecordBatch]:
    for start, stop in slices(batch.column(column).cast(pa.large_binary()), 1 << 20):
        yield batch.slice(start, stop - start)


def fit(words: DataFrame, vocabulary: Vocabulary, rounds: int = 2) -> tuple[Vocabulary, float]:
    """Log probabilities of the pieces and of the end, from the counted words of the training texts.

    ``rounds`` times, all segmentations of every word give expected counts of the pieces, by the
    probabilities so far (first those of the file). Counts plus ``PRIOR`` per piece, dealt as the file's probabilities are, make
    the next ones; the driver sees one number per piece.
    """
    prior = np.exp(vocabulary.logs) * PRIOR * len(vocabulary.pieces)
    ends = words.where(F.length("word") == 0).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()["n"]
    total, known = 0.0, vocabulary
    for _ in range(rounds):
        shared = words.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            now = shared.value
            counts = np.zeros(len(now.pieces))
            for batch in batches:
                for part in _parts(batch):
                    now.likelihoods(part.column(0).to_pylist(), counts, part.column(1).to_pylist())
            used = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(counts[used])], ["piece", "n"])

        found = words.where((F.col("c") > 0) & (F.length("word") > 0)).select("word", "c").mapInArrow(run, "piece long, n double")
        counts = np.zeros(len(vocabulary.pieces))
        for row in found.groupBy("piece").agg(F.sum("n").alias("n")).collect():
            counts[row["piece"]] = row["n"]
        shared.unpersist()
        total = float(counts.sum())
        known = Vocabulary(vocabulary.pieces, np.log((counts + prior) / (total + prior.sum() + ends + 0.5)))
    return known, math.log((ends + 0.5) / (total + float(prior.sum()) + ends + 0.5))


def _key(word: bytes) -> bytes:
    return word if len(word) <= KEY_BYTES else MARK + hashlib.sha256(word).digest()


def word_scores(words: DataFrame, known: Vocabulary, end: float, all_tokens: int, distinct: int) -> DataFrame:
    """key, known (0 or 1), base and score (log10 by counts, and over the lattice) of every word."""
    shared = words.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = shared.value
        for batch in batches:
            for part in _parts(batch):
                own = part.column(0).to_pylist()
                logs = np.where([len(w) > 0 for w in own], now.likelihoods(own), end) / math.log(10)
                c = np.asarray(part.column(1), np.int64)
                base = np.log10((c + 0.5) / (all_tokens + 0.5 * (distinct + 1)))
                columns = [pa.array([_key(w) for w in own], pa.binary()), pa.array((c > 0).astype(np.int64)), pa.array(base), pa.array(logs), part.column(2)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "known", "base", "score", "seen"])

    return words.select("word", "c", "seen").mapInArrow(run, "key binary, known long, base double, score double, seen long")


def _documents(shared):
    """Sums over the frequent words of each text, and the other words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known, base, score = shared.value
        task, nth = TaskContext.get().partitionId(), 0
        names = ["row", "doc_id", "trained", "n_tokens", "n_known", "base_score", "score", "keys", "times"]
        types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.binary()), pa.list_(pa.int64())]

        def sums(counts: Counter) -> list:
            at, of, keys, times = [], [], [], []
            for word, n in counts.items():
                place = index.get(_key(word))
                if place is None:
                    keys.append(_key(word))
                    times.append(n)
                else:
                    at.append(place)
                    of.append(n)
            at, of = np.array(at, np.int64), np.array(of, np.int64)
            return [int(of.sum()) + sum(times), int((of * known[at]).sum()), float((of * base[at]).sum()), float((of * score[at]).sum()), keys, times]

        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part, rows = batch.slice(start, stop - start), []
                for doc, text, trained in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist(), part.column(2).to_pylist(), strict=True):
                    row = (task << 33) | nth
                    nth += 1
                    counts = Counter([b""])
                    for words in byte_words(text or b"", _TABLE):
                        if len(counts) > HELD:  # a long text is several rows of one number
                            rows.append([row, doc, trained, *sums(counts)])
                            counts.clear()
                        counts.update(words)
                    rows.append([row, doc, trained, *sums(counts)])
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def score(docs: DataFrame, trained: Column, path: str, rounds: int = 2, frequent: int = FREQUENT) -> DataFrame:
    """Log10 probability of every whole text under a unigram model of subword pieces.

    ``docs`` needs doc_id and text; other columns are not read, except by ``trained``, the condition of the rows to
    learn from. ``path`` is a sentencepiece vocabulary. A text is its lower-cased (A-Z) words and an end; a word is a
    mark and its bytes, and its probability is the sum over all ways to cut it into pieces of the product of
    their probabilities, which add up to 1 with that of the end. Any byte is a piece, so no word is impossible.

    Returns doc_id, trained, n_tokens (words and end), n_known (tokens of the training texts), train_tokens,
    base_score (by smoothed counts of whole tokens) and score. NULL and empty texts have the end alone.
    Repeated rows, and rows of NULL id, are rows of their own. Without training rows the file's scores decide.

    Words are counted and scored once each. A document adds up its ``frequent`` words at once (those most often
    seen, a bounded table in every task); its other words meet theirs in a shuffle on the word, to which the
    most common words, and so hot keys, do not belong.
    """
    docs = docs.withColumn("trained", F.coalesce(trained, F.lit(False))).select(F.col("doc_id").cast("long"), "text", "trained")
    words = written(word_counts(docs), "words")
    seen = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.when(F.col("c") > 0, 1)).alias("v")).first()
    known, end = fit(words, Vocabulary.read(path), rounds)
    scored = written(word_scores(words, known, end, seen["n"], seen["v"]), "word-scores")
    top = scored.orderBy(F.desc("seen"), "key").limit(frequent).toLocalIterator()
    index, columns = {}, ([], [], [])
    for at, row in enumerate(top):
        index[bytes(row["key"])] = at
        for column, name in zip(columns, ("known", "base", "score"), strict=True):
            column.append(row[name])
    arrays = [np.array(c, t) for c, t in zip(columns, (np.int64, np.float64, np.float64), strict=True)]
    shared = docs.sparkSession.sparkContext.broadcast((index, *arrays))
    sums = "row long, doc_id long, trained boolean, n_tokens long, n_known long, base_score double, score double"
    first = written(docs.select("doc_id", "text", "trained").mapInArrow(_documents(shared), f"{sums}, keys array<binary>, times array<long>"), "sums")
    rare = first.select("row", F.explode(F.arrays_zip("keys", "times")).alias("w")).select("row", F.col("w.keys").alias("key"), F.col("w.times").alias("n"))
    rare = rare.join(scored.drop("seen"), "key").select(
        "row", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("boolean").alias("trained"), F.lit(0).cast("long").alias("n_tokens"),
        (F.col("n") * F.col("known")).alias("n_known"), (F.col("n") * F.col("base")).alias("base_score"), (F.col("n") * F.col("score")).alias("score"),
    )
    added = first.drop("keys", "times").unionByName(rare).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("trained").alias("trained"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score"))
    )
    return added.drop("row").withColumn("train_tokens", F.lit(seen["n"]).cast("long"))
