"""Conversations rendered for training, with loss masks aligned to token offsets."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

#: Control strings of the template. A turn is START role MIDDLE text END.
START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
_ESCAPE, _UNESCAPE = re.compile(r"<(\\*)\|"), re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(MIDDLE) + "(.*?)" + re.escape(END), re.DOTALL)


def escape(text: str) -> str:
    """No ``<|`` is left: ``<``, any number of backslashes and ``|`` gets one backslash more."""
    return _ESCAPE.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"<\1|", text)


def render(turns: Sequence[tuple[str, str]], trained: str) -> tuple[str, np.ndarray]:
    """The conversation as one string, and the spans of the texts of role ``trained`` in it."""
    parts, at, spans = [], 0, []
    for role, text in turns:
        head, body = f"{START}{escape(role)}{MIDDLE}", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, np.int64).reshape(-1, 2)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a rendered conversation."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def align(spans: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens that meet a span, and the part of each that lies inside it.

    Spans and tokens are sorted and do not overlap, so the tokens of a span are a run, found by two
    binary searches.
    """
    first = np.searchsorted(ends, spans[:, 0], "right")
    last = np.searchsorted(starts, spans[:, 1], "left")
    counts = np.maximum(last - first, 0)
    of = np.repeat(np.arange(len(spans)), counts)
    tokens = first[of] + np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    begin, stop = np.maximum(starts[tokens], spans[of, 0]), np.minimum(ends[tokens], spans[of, 1])
    keep = stop > begin
    return tokens[keep], begin[keep], stop[keep]


@cache
def _tokenizer(path: str):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(path)
    known.no_padding()
    known.no_truncation()
    known.add_special_tokens([START, MIDDLE, END])
    return known


def format_conversations(messages: DataFrame, path: str, trained: str = "assistant") -> DataFrame:
    """Render, encode and mask every conversation of ``messages`` (conv_id, turn, role, text).

    Returns one row per conv_id: formatted (string), ids, and for every token that carries loss
    its number (loss_token) and the code points of ``formatted`` it answers for (loss_from,
    loss_to; the end is exclusive). A token that crosses the edge of a text answers for the part inside
    it; of tokens that share a character the first has it.

    Turns are in the order of turn, then role and text (NULL first, repeated rows kept); a NULL
    role or text is empty, rows of NULL conv_id are one conversation. Control strings inside texts
    are escaped, see :func:`escape`. ``path`` is a tokenizer file; the control strings become
    special tokens of it. A conversation is rendered as a whole, so it must fit a task; other
    columns are not read, and no rows give no rows.
    """
    turn = F.struct("turn", "role", "text")
    whole = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    whole = whole.select("conv_id", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _tokenizer(path)
        small = pa.list_(pa.int32())
        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                turns = [
                    [(r or "", t or "") for r, t in zip(*pair, strict=True)]
                    for pair in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True)
                ]
                rendered = [render(own, trained) for own in turns]
                out: list[tuple] = []
                for (text, spans), found in zip(rendered, known.encode_batch([t for t, _ in rendered], add_special_tokens=False), strict=True):
                    ends = np.array([stop for _, stop in found.offsets], np.int64)
                    # Tokens follow each other without a gap: each begins where the one before ended.
                    starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                    out.append((text, found.ids, *align(spans, starts, ends)))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(columns[0], pa.string()), *(pa.array(c, small) for c in columns[1:])],
                    ["conv_id", "formatted", "ids", "loss_token", "loss_from", "loss_to"],
                )

    schema = whole.select("conv_id").schema.add("formatted", "string")
    for name in ("ids", "loss_token", "loss_from", "loss_to"):
        schema = schema.add(name, ArrayType(IntegerType()))
    return whole.mapInArrow(run, schema)


def loss_text(formatted: str, begins: Sequence[int], stops: Sequence[int]) -> str:
    """The text under the mask: neighbouring parts are one run, and each run is unescaped."""
    runs: list[list[int]] = []
    for begin, stop in zip(begins, stops, strict=True):
        if runs and runs[-1][1] == begin:
            runs[-1][1] = stop
        else:
            runs.append([begin, stop])
    return "".join(unescape(formatted[begin:stop]) for begin, stop in runs)
