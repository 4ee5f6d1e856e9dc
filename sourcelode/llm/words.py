"""Vectorised words and word shingles over Arrow text columns; helpers that run inside tasks."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text worked on at once, so that the arrays of a slice stay small whatever the batch holds.
SLICE_BYTES = 1 << 19

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_random = np.random.default_rng(20240607)
_BYTE = _random.integers(0, 2**64, 256, dtype=U64)
_PLACE = _random.integers(0, 2**64, 1 << 20, dtype=U64) | U64(1)
_STEP = _random.integers(0, 2**64, 64, dtype=U64) | U64(1)


@contextmanager
def emptied(*clear: Callable[[], None]) -> Iterator[None]:
    """At the end of a task, call ``clear`` and give free memory back: workers outlive their tasks, and
    what they keep is missing in later stages."""
    try:
        yield
    finally:
        for function in clear:
            function()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that gives free memory back when its batches end."""

    def tidied(batches: Iterator) -> Iterator:
        with emptied():
            yield from run(batches)

    return tidied


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values."""
    values = (values ^ (values >> U64(31))) * U64(0x7FB5D329728EA185)
    values = (values ^ (values >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return values ^ (values >> U64(33))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; NULL is empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``limit`` bytes; a longer text is a range of its own."""
    if not len(column):
        return
    lengths = np.diff(utf8(column)[1])
    start, held = 0, 0
    for row, length in enumerate(lengths):
        if held and held + length > limit:
            yield start, row
            start, held = row, 0
        held += int(length)
    yield start, len(lengths)


def byte_words(text: bytes, table: bytes, limit: int = 2 * SLICE_BYTES) -> Iterator[list[bytes]]:
    """Words of a text in lists of about ``limit`` bytes; ``table`` maps each byte to itself, another
    one or, if it ends a word (as all ASCII white space must), to a space."""
    text = text.translate(table)
    start = 0
    while start < len(text):
        stop = text.find(b" ", start + limit) if len(text) > start + limit else -1
        stop = len(text) if stop < 0 else stop
        yield text[start:stop].split()
        start = stop


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the lower-cased (A-Z) words of every text, and the row each word is in.

    Words are runs of bytes other than space and 0x09 to 0x0D; none crosses a row.
    """
    return word_spans(column)[:2]


def word_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """:func:`word_hashes` with the first byte of every word and its length."""
    data, offsets = utf8(column)
    none = np.zeros(0, np.int64)
    if not len(data):
        return np.zeros(0, U64), none, none, none
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
    after = np.concatenate((inside[1:], [False])) & ~edge[1:]
    starts = np.flatnonzero(inside & ~before)
    lengths = np.flatnonzero(inside & ~after) + 1 - starts
    if not len(starts):
        return np.zeros(0, U64), none, none, none
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    weight = _PLACE[place & (len(_PLACE) - 1)] + place.astype(U64) // U64(len(_PLACE))
    hashes = np.add.reduceat(_BYTE[_LOWER[data[inside]]] * weight, first)
    return mix(hashes + lengths.astype(U64)), np.searchsorted(offsets, starts, "right") - 1, starts, lengths


def ngram_hashes(words: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``n`` words inside a row, and their rows."""
    count = len(words) - n + 1
    if count <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    total = np.full(count, U64(n))
    for at in range(n):
        total += words[at : at + count] * _STEP[at]
    inside = rows[:count] == rows[n - 1 :]
    return mix(total[inside]), rows[:count][inside]


def shingle_sets(column: pa.Array, n: int = 5) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``n``-word shingles.

    A text of fewer words has one shingle, the whole sequence; without words it has none.
    """
    words, rows = word_hashes(column)
    counts = np.bincount(rows, minlength=len(column)) if len(rows) else np.zeros(len(column), np.int64)
    ends = np.cumsum(counts)
    hashes, of = ngram_hashes(words, rows, n)
    bounds = np.searchsorted(of, np.arange(len(column) + 1))
    out = []
    for row in range(len(column)):
        if counts[row] >= n:
            out.append(np.unique(hashes[bounds[row] : bounds[row + 1]]))
        elif counts[row]:
            own = words[ends[row] - counts[row] : ends[row]]
            out.append(mix((own * _STEP[: len(own)]).sum(keepdims=True) + U64(len(own))))
        else:
            out.append(np.zeros(0, U64))
    return out
