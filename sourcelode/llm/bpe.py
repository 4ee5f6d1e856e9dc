"""Byte-level BPE in batched numpy merge rounds, and the reverse."""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from sourcelode.llm.words import emptied, slices

#: Split of a text before merging, as byte-level tokenizers define it (fixed value).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters beyond these ranges may be classed otherwise by another release of Unicode; the
#: tokenizers library splits texts that hold one.
RARE = re.compile("[^\\x00-\u0557\u2010-\u205e\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
#: Bytes of the pieces that a task remembers with their ids; a full memory is emptied.
REMEMBERED = 16 << 20
#: Bytes that a remembered piece takes besides its letters and ids, about.
ENTRY = 150
#: Words of more symbols are merged one by one.
LONG_WORD = 1 << 10
#: Bytes of text that are encoded together.
CHUNK = 1 << 19
NEVER = np.iinfo(np.int64).max


@cache
def byte_letters() -> list[str]:
    """The character by which a byte-level vocabulary writes each byte: printable ones stand for
    themselves, the others for 256, 257, and so on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    letters = {b: chr(b) for b in printable} | {b: chr(256 + at) for at, b in enumerate(rest)}
    return [letters[b] for b in range(256)]


class Pieces:
    """Ids of pieces of text, each encoded once while it is remembered."""

    def __init__(self, encode: Callable[[list], tuple[np.ndarray, np.ndarray]], remembered: int = REMEMBERED):
        self.encode, self.remembered = encode, remembered
        self._clear()

    def _clear(self):
        self.index: dict = {}
        self.held = 0
        self.flat, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ids(self, texts: Sequence[list]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, given as lists of pieces, one after another, and their number per text."""
        if self.held > self.remembered:
            self._clear()
        index = self.index
        fresh = list({p: None for pieces in texts for p in pieces if p not in index})
        if fresh:
            flat, lengths = self.encode(fresh)
            index.update(zip(fresh, range(len(index), len(index) + len(fresh)), strict=True))
            self.held += ENTRY * len(fresh) + 4 * len(flat) + sum(len(p) for p in fresh if isinstance(p, str))
            self.flat = np.concatenate([self.flat, flat.astype(np.int32)])
            self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
        sizes = [len(pieces) for pieces in texts]
        at = np.fromiter((index[p] for pieces in texts for p in pieces), np.int64, sum(sizes))
        starts, counts = self.ends[at], self.ends[at + 1] - self.ends[at]
        upto = np.concatenate(([0], np.cumsum(counts)))
        places = np.repeat(starts - upto[:-1], counts) + np.arange(upto[-1])
        bounds = upto[np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64)))).astype(np.int64)]
        return self.flat[places], np.diff(bounds)


class Bpe:
    """A byte-level vocabulary read from a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            stored = json.load(file)
        vocabulary = stored["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in stored["added_tokens"]}
        byte_of = {letter: b for b, letter in enumerate(byte_letters())}
        self.first = np.array([vocabulary[letter] for letter in byte_letters()], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in stored["model"]["merges"]]
        keys = np.array([(vocabulary[a] << 32) | vocabulary[b] for a, b in pairs], np.int64)
        made = np.array([vocabulary[a + b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made[order]
        del pairs, keys, made
        self.size = 1 + max([*vocabulary.values(), *self.special.values()])
        spelled = [b""] * self.size
        for token, at in vocabulary.items():
            spelled[at] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, at in self.special.items():
            spelled[at] = token.encode()
        self.spelled_ends = np.concatenate(([0], np.cumsum([len(s) for s in spelled])))
        self.spelled = np.frombuffer(b"".join(spelled), np.uint8)
        numbers = [b"%d," % at for at in range(self.size)]
        self.number_ends = np.concatenate(([0], np.cumsum([len(s) for s in numbers])))
        self.numbers = np.frombuffer(b"".join(numbers), np.uint8)
        self.pieces = Pieces(self._encode_pieces)

    @cached_property
    def _words(self):
        import regex

        return regex.compile(WORD_PATTERN)

    @cached_property
    def _library(self):
        from tokenizers.pre_tokenizers import ByteLevel

        return ByteLevel(add_prefix_space=False, use_regex=True)

    def _pieces_of(self, text: str) -> list[str]:
        if text.isascii() or not RARE.search(text):
            return self._words.findall(text)
        return [text[start:stop] for _, (start, stop) in self._library.pre_tokenize_str(text)]

    @cached_property
    def _specials(self):
        return re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def split(self, text: str) -> list:
        """Pieces of a text that are merged on their own; a special token is its id."""
        if self._specials is None or not any(s in text for s in self.special):
            return self._pieces_of(text)
        out: list = []
        for part in self._specials.split(text):
            out.extend([self.special[part]] if part in self.special else self._pieces_of(part))
        return out

    def _encode_pieces(self, pieces: list) -> tuple[np.ndarray, np.ndarray]:
        spelled = [p.encode("utf-8", "surrogatepass") if isinstance(p, str) else b"\0" for p in pieces]
        lengths = np.fromiter(map(len, spelled), np.int64, len(spelled))
        symbols = self.first[np.frombuffer(b"".join(spelled), np.uint8)]
        starts = np.cumsum(lengths) - lengths
        for at, piece in enumerate(pieces):
            if not isinstance(piece, str):
                symbols[starts[at]] = piece
        return self.merge(symbols, lengths)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merge the symbols of all words, one array behind another, until no pair is known.

        In each round every word merges all places of its lowest-ranked pair, from the left. The
        rank of a pair is found by binary search over the sorted pair keys. Words without a known
        pair leave the rounds.
        """
        words = np.arange(len(lengths))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if (long := lengths > LONG_WORD).any():
            stops = np.cumsum(lengths)
            for at in np.flatnonzero(long):
                own = self._merge_long(symbols[stops[at] - lengths[at] : stops[at]])
                done.append((words[at : at + 1], own, np.array([len(own)])))
            symbols = symbols[~np.repeat(long, lengths)]
            words, lengths = words[~long], lengths[~long]
        while len(words):
            ends = np.cumsum(lengths)
            starts = ends - lengths
            pair = np.append((symbols[:-1] << 32) | symbols[1:], -1)
            at = np.searchsorted(self.keys, pair)
            at[at == len(self.keys)] = 0
            known = self.keys[at] == pair if len(self.keys) else np.zeros(len(pair), bool)
            known[ends - 1] = False
            rank = np.where(known, self.ranks[at], NEVER)
            least = np.minimum.reduceat(rank, starts)
            more = least < NEVER
            if not more.all():
                of = np.repeat(more, lengths)
                done.append((words[~more], symbols[~of], lengths[~more]))
                words, symbols, rank, at = words[more], symbols[of], rank[of], at[of]
                least, lengths = least[more], lengths[more]
                if not len(words):
                    break
            chosen = rank == np.repeat(least, lengths)
            places = np.flatnonzero(chosen)
            # Of places in a row, which share symbols, every other one from the left.
            fresh = np.concatenate(([True], np.diff(places) > 1))
            run = np.maximum.accumulate(np.where(fresh, np.arange(len(places)), 0))
            places = places[(np.arange(len(places)) - run) % 2 == 0]
            symbols[places] = self.made[at[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            gone = np.bincount(np.searchsorted(np.cumsum(lengths), places, "right"), minlength=len(words))
            symbols, lengths = symbols[keep], lengths - gone
        if not done:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.argsort(np.concatenate([w for w, _, _ in done]), kind="stable")
        sizes = np.concatenate([n for _, _, n in done])
        flat = np.concatenate([s for _, s, _ in done])
        firsts = (np.cumsum(sizes) - sizes)[order]
        sizes = sizes[order]
        before = np.cumsum(sizes) - sizes
        return flat[np.repeat(firsts - before, sizes) + np.arange(int(sizes.sum()))], sizes

    @cached_property
    def _rank_and_made(self) -> dict[int, tuple[int, int]]:
        return dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))

    def _merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """Merge one long word: the ranks of its pairs stay in a heap by rank and place, and a merge
        looks up the two pairs that it makes."""
        known, count = self._rank_and_made, len(symbols)
        own = symbols.tolist()
        after, before = [*range(1, count), -1], list(range(-1, count - 1))
        heap = [(known[key][0], at) for at, key in enumerate(((symbols[:-1] << 32) | symbols[1:]).tolist()) if key in known]
        heapq.heapify(heap)
        while heap:
            rank, at = heapq.heappop(heap)
            right = after[at]
            found = known.get((own[at] << 32) | own[right]) if right >= 0 and own[at] >= 0 else None
            if found is None or found[0] != rank:
                continue  # one of the two has been merged since
            own[at], own[right] = found[1], -1
            after[at] = after[right]
            if after[at] >= 0:
                before[after[at]] = at
            for left, place in ((at, after[at]), (before[at], at)):
                if left >= 0 and place >= 0 and (found := known.get((own[left] << 32) | own[place])) is not None:
                    heapq.heappush(heap, (found[0], left))
        return np.array([s for s in own if s >= 0], np.int64)

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row and their number per text."""
        return self.pieces.ids([self.split(t or "") for t in texts])

    def _listed(self, ids: np.ndarray, data: np.ndarray, ends: np.ndarray) -> bytes:
        """The entries of a table of bytes at ``ids``, in a row."""
        ids = np.asarray(ids, np.int64)
        ids = ids[(ids >= 0) & (ids < self.size)]
        starts, lengths = ends[ids], ends[ids + 1] - ends[ids]
        before = np.cumsum(lengths) - lengths
        return data[np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids; bytes that are not UTF-8 become U+FFFD, ids outside the vocabulary nothing."""
        return self._listed(ids, self.spelled, self.spelled_ends).decode("utf-8", "replace")

    def written(self, ids: np.ndarray) -> bytes:
        """Ids as decimal numbers with commas between."""
        return self._listed(ids, self.numbers, self.number_ends)[:-1]


@cache
def vocabulary(path: str) -> Bpe:
    return Bpe(path)


def _encoded(batches: Iterator[pa.RecordBatch], path: str, at: int) -> Iterator[tuple[Bpe, pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of bounded size of a task's batches, with the ids of the texts in column ``at`` and where each
    text's ids end."""
    known = vocabulary(path)  # what it remembers is bounded and serves the next task too
    with emptied():
        for batch in batches:
            for start, stop in slices(batch.column(at), CHUNK):
                part = batch.slice(start, stop - start)
                flat, counts = known.encode(part.column(at).to_pylist())
                yield known, part, flat, np.concatenate(([0], np.cumsum(counts)))


def encode(docs: DataFrame, path: str, column: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the token ids of ``column`` as array<int>; NULL and empty texts have none.

    ``path`` is a byte-level tokenizer file that every machine has. Each row is a text of its own,
    so repeated rows give equal ids; a column named ``ids`` is replaced.
    """
    rest = [c for c in docs.columns if c != ids]
    sent = rest if column in rest else [*rest, column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part, flat, ends in _encoded(batches, path, sent.index(column)):
            tokens = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns[: len(rest)], tokens], [*rest, ids])

    return docs.select(*sent).mapInArrow(run, docs.select(*rest).schema.add(ids, ArrayType(IntegerType())))


def digests(docs: DataFrame, path: str, column: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids with commas between) and decoded_sha256 (of the text that the
    ids decode to, in UTF-8) of every row; :func:`encode` and :func:`decode` where the ids are, so that
    neither they nor the texts leave the task."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for known, part, flat, ends in _encoded(batches, path, 1):
            own = [flat[b:e] for b, e in zip(ends[:-1], ends[1:], strict=True)]
            listed = [hashlib.sha256(known.written(ids)).hexdigest() for ids in own]
            texts = [hashlib.sha256(known.decode(ids).encode()).hexdigest() for ids in own]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(ends)), pa.array(listed, pa.string()), pa.array(texts, pa.string())], names)

    schema = docs.select("doc_id").schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return docs.select("doc_id", column).mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str, ids: str = "ids", column: str = "decoded") -> DataFrame:
    """``tokens`` with the text of ``ids``; NULL is empty. A column named ``column`` is replaced."""
    rest = [c for c in tokens.columns if c != column]
    sent = rest if ids in rest else [*rest, ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary(path)
        for batch in batches:
            lists = batch.column(sent.index(ids))
            flat, ends = np.asarray(lists.flatten()), np.concatenate(([0], np.cumsum(np.asarray(lists.value_lengths().fill_null(0)))))
            texts = [known.decode(flat[ends[at] : ends[at + 1]]) for at in range(len(lists))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], pa.array(texts, pa.string())], [*rest, column])

    schema = tokens.select(*rest).schema.add(column, "string")
    return tokens.select(*sent).mapInArrow(run, schema)
