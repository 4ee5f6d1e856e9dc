"""Token ids in directly addressable codes: files from which any token can be read by its number."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sourcelode.llm.bpe import byte_letters
from sourcelode.llm.words import U64, emptied, slices, utf8, word_spans

#: Ids after which a segment ends, so that no row outgrows a task; a longer document is a segment of its own.
SEGMENT_IDS = 1 << 18
#: Bits of a bitmap between two entries of its rank directory.
RANK_BITS = 512
SCHEMA = (
    "part int, segment long, n_docs long, n_ids long, doc_ids binary, doc_known binary, doc_ends binary, "
    "levels array<binary>, bitmaps array<binary>, ranks array<binary>"
)
FIELDS = [f.split(" ")[0] for f in SCHEMA.split(", ")]


class Codes:
    """One sequence of ids, split into chunks of 8 bits, low chunk first.

    ``levels[0]`` has the low chunk of every id. A bit in ``bitmaps[k]`` says that the id goes on:
    its next chunk is in ``levels[k + 1]``, at the number of set bits before its own (the rank).
    ``ranks[k]`` has that number for every 512th bit, so a rank needs one block of the bitmap.
    """

    def __init__(self, levels: Sequence[bytes], bitmaps: Sequence[bytes], ranks: Sequence[bytes]):
        self.levels = [np.frombuffer(x, np.uint8) for x in levels]
        self.bitmaps = [np.frombuffer(x, np.uint8) for x in bitmaps]
        self.ranks = [np.frombuffer(x, "<i8") for x in ranks]

    @staticmethod
    def pack(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
        levels, bitmaps, ranks = [], [], []
        rest = np.asarray(ids, np.uint64)
        while len(rest):
            levels.append((rest & np.uint64(255)).astype(np.uint8).tobytes())
            on = rest > np.uint64(255)
            bitmaps.append(np.packbits(on, bitorder="little").tobytes())
            blocks = np.add.reduceat(on.astype(np.int64), np.arange(0, len(on), RANK_BITS))
            ranks.append((np.cumsum(blocks) - blocks).astype("<i8").tobytes())
            rest = rest[on] >> np.uint64(8)
        return levels, bitmaps, ranks

    def _bits(self, level: int, start: int, stop: int) -> np.ndarray:
        first = start >> 3
        bits = np.unpackbits(self.bitmaps[level][first : (stop + 7) >> 3], bitorder="little")
        return bits[start - 8 * first : stop - 8 * first].astype(bool)

    def _rank(self, level: int, at: int) -> int:
        block = at // RANK_BITS
        if block >= len(self.ranks[level]):
            block = len(self.ranks[level]) - 1
        return int(self.ranks[level][block]) + int(self._bits(level, block * RANK_BITS, at).sum())

    def token(self, at: int) -> int:
        """The id at one place: one chunk, one bit and at most one bitmap block per level."""
        value, shift = 0, 0
        for level in range(len(self.levels)):
            value |= int(self.levels[level][at]) << shift
            if not self.bitmaps[level][at >> 3] >> (at & 7) & 1:
                break
            at, shift = self._rank(level, at), shift + 8
        return value

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids of a run of places; ids that go on are a run on the next level too."""
        out = np.zeros(max(0, stop - start), np.uint64)
        places = np.arange(len(out))
        for level in range(len(self.levels)):
            if start >= stop:
                break
            out[places] |= self.levels[level][start:stop].astype(np.uint64) << np.uint64(8 * level)
            on = self._bits(level, start, stop)
            places = places[on]
            start = self._rank(level, start)
            stop = start + len(places)
        return out


#: Split of a run between blanks, as the vocabulary's pre-tokenizer makes it (fixed value).
PIECE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: Runs with other characters, or with what may be a special token, go through the whole library:
#: up to U+024F normalisation changes nothing and lower case is character by character.
UNSURE = re.compile("[^\x00-\u012f\u0131-\u024f]|<\\|")


#: Bytes of the runs and of the pieces that a task remembers with their ids; a full memory is emptied.
RUNS, PIECES = 24 << 20, 32 << 20
#: Bytes that a remembered piece takes besides its letters, about.
ENTRY = 250


class Library:
    """The tokenizers library, asked once for every distinct piece while it is remembered.

    Right for vocabularies that lower-case a text, drop its white space and split at it and by
    ``PIECE_PATTERN``. Texts are cut at ASCII white space into runs, which are known by 64-bit
    hashes of their lower-cased bytes; a run of plain characters is split here and its pieces
    go to the library's model, any other run goes to the library as a whole.
    """

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model, self.split = self.tokenizer.model, regex.compile(PIECE_PATTERN).findall
        self.letters = {b: letter for b, letter in enumerate(byte_letters())}
        self.clear()

    def clear(self):
        """Forget runs and pieces, also those the library remembers."""
        self.pieces: dict[str, list[int]] = {}
        self.piece_bytes = 0
        self.model._clear_cache()
        self._clear()

    def _clear(self):
        self.hashes, self.firsts, self.lengths = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.int32)

    def _piece(self, piece: str) -> list[int]:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        self.pieces[piece] = ids
        self.piece_bytes += ENTRY + len(piece) + 8 * len(ids)
        return ids

    def _ask(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.piece_bytes > PIECES:
            self.pieces.clear()
            self.piece_bytes = 0
        known, flat, lengths = self.pieces, [], []
        for run in runs:
            before = len(flat)
            if not run.isascii() and UNSURE.search(run) or "<|" in run:
                flat += self.tokenizer.encode(run, add_special_tokens=False).ids
            else:
                run = run.lower()
                for piece in (run,) if run.isalpha() else self.split(run):
                    flat += known.get(piece) or self._piece(piece)
            lengths.append(len(flat) - before)
        return np.array(flat, np.int32), np.array(lengths, np.int32)

    def _remember(self, hashes: np.ndarray, runs: list[str]) -> None:
        flat, lengths = self._ask(runs)
        firsts = len(self.flat) + np.cumsum(lengths, dtype=np.int64) - lengths
        self.flat = np.concatenate([self.flat, flat])
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.firsts, self.lengths = (
            np.insert(old, at, new) for old, new in ((self.hashes, hashes), (self.firsts, firsts), (self.lengths, lengths))
        )

    @staticmethod
    def _part_cases(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, data: np.ndarray) -> None:
        """Give runs with ``<|`` hashes of their bytes as they are: special tokens are found before
        a text is lower-cased, so such runs differ by case."""
        opened = np.flatnonzero((data[:-1] == ord("<")) & (data[1:] == ord("|")))
        of = np.unique(np.searchsorted(starts, opened, "right") - 1)
        for at in of[of >= 0]:
            run = data[starts[at] : starts[at] + lengths[at]].tobytes()
            hashes[at] = int.from_bytes(hashlib.blake2b(run, digest_size=8).digest(), "little")

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and their number per text."""
        hashes, rows, starts, lengths = word_spans(texts)
        self._part_cases(hashes, starts, lengths, utf8(texts)[0])
        if 20 * len(self.hashes) + 4 * len(self.flat) > RUNS:
            self._clear()
        distinct, first, of = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.hashes, distinct)
        at[at == len(self.hashes)] = 0
        fresh = self.hashes[at] != distinct if len(self.hashes) else np.ones(len(distinct), bool)
        if fresh.any():
            data = utf8(texts)[0].tobytes()
            places = first[fresh]
            self._remember(distinct[fresh], [
                data[b:e].decode("utf-8", "surrogatepass") for b, e in zip(starts[places].tolist(), (starts + lengths)[places].tolist(), strict=True)
            ])
        at = np.searchsorted(self.hashes, distinct)[of]
        sizes = self.lengths[at].astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(sizes)))
        flat = self.flat[np.repeat(self.firsts[at] - upto[:-1], sizes) + np.arange(upto[-1])]
        bounds = upto[np.searchsorted(rows, np.arange(len(texts) + 1))]
        return flat, np.diff(bounds)


@cache
def library(path: str) -> Library:
    return Library(path)


def _encoded(path: str, end_id: int):
    """Batches of doc_id and text become batches of doc_id and packed ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = library(path)  # what it remembers is bounded and serves the next task too
        with emptied():
            for batch in batches:
                for start, stop in slices(batch.column(1)):
                    part = batch.slice(start, stop - start)
                    flat, counts = known.encode(part.column(1))
                    ends = np.cumsum(counts)
                    flat = np.insert(flat, ends, end_id).astype("<u4")
                    ends += np.arange(1, len(ends) + 1)
                    packed = [flat[b:e].tobytes() for b, e in zip(np.append(0, ends[:-1]), ends, strict=True)]
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, ``ids`` (32-bit little-endian integers): the tokens of each whole text and ``end_id``."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encoded(path, end_id), "doc_id long, ids binary")


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a range partition, in order, become one row per segment."""
    task, nth = TaskContext.get().partitionId(), 0
    docs: list[int | None] = []
    ids: list[pa.BinaryScalar] = []
    held = 0

    def row():
        flat = np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in ids])
        levels, bitmaps, ranks = Codes.pack(flat)
        values = [
            task, nth, len(docs), len(flat), np.array([d or 0 for d in docs], "<i8").tobytes(),
            np.array([d is not None for d in docs], np.uint8).tobytes(),
            np.cumsum([len(x.as_buffer()) // 4 for x in ids]).astype("<i8").tobytes(), levels, bitmaps, ranks,
        ]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 3, *[pa.list_(pa.binary())] * 3]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], FIELDS)

    with emptied():
        for batch in batches:
            for doc, own in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                size = len(own.as_buffer()) // 4
                if docs and held + size > SEGMENT_IDS:
                    yield row()
                    nth, docs, ids, held = nth + 1, [], [], 0
                docs.append(doc)
                ids.append(own)
                held += size
        if docs:
            yield row()


def _ordered(rows: DataFrame, content: str) -> DataFrame:
    """Rows (doc_id, ``content``) in ranges of ascending doc_id, sorted; NULL ids come first, rows of one id in
    the order of a hash of their content. Ranges follow rows, whatever the ids are; the place of a
    row in its task parts even rows that are equal."""
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.asc("hash_"), F.asc("at_")]
    placed = rows.select(F.col("doc_id").cast("long"), content, F.xxhash64(content).alias("hash_"), F.monotonically_increasing_id().alias("at_"))
    return placed.repartitionByRange(count, *order).sortWithinPartitions(*order).select("doc_id", content)


def write(tokens: DataFrame, path: str) -> None:
    """Write documents (doc_id, ids) to a Parquet folder of segments in the order of :func:`_ordered`.

    Files are ranges of documents; a segment is a run of about ``SEGMENT_IDS`` ids of a file, and
    (part, segment) is the global order. Spark's writer commits whole tasks, so a lost executor leaves no
    half file. ``tokens`` is read twice, once for the bounds of the ranges.
    """
    _ordered(tokens, "ids").mapInArrow(_segments, SCHEMA).write.parquet(path)


def write_texts(docs: DataFrame, vocabulary: str, end_id: int, path: str) -> None:
    """:func:`encode` and :func:`write` in one pass: the texts are put in order, and each task encodes its range
    and packs it into segments, so that ids are not shuffled. Rows of one doc_id are in the order of a
    hash of their texts."""
    run = _encoded(vocabulary, end_id)
    _ordered(docs, "text").mapInArrow(lambda batches: _segments(run(batches)), SCHEMA).write.parquet(path)


def starts(spark: SparkSession, path: str) -> DataFrame:
    """part, segment and the number of ids before it: running sums inside each part, and the sums of the
    parts before, of which there is one row each."""
    light = spark.read.schema(SCHEMA).parquet(path).select("part", "segment", "n_ids")
    before = lambda window: F.coalesce(F.sum("n_ids").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = light.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("parts_before"))
    inside = light.select("part", "segment", before(Window.partitionBy("part").orderBy("segment")).alias("inside"))
    return inside.join(parts, "part").select("part", "segment", (F.col("parts_before") + F.col("inside")).alias("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Every stored document from its segment: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (unsigned, of the ids as little-endian 32-bit integers)."""

    names = ["part", "segment", "doc_id", "begin", "n_tokens", "ids_crc32"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with emptied():
            for batch in batches:
                for row in range(len(batch)):
                    part, segment, _, _, ids, known, ends, levels, bitmaps, ranks = (c[row].as_py() for c in batch.columns)
                    codes, ends = Codes(levels, bitmaps, ranks), np.frombuffer(ends, "<i8")
                    begins = np.concatenate(([0], ends[:-1]))
                    sums = [zlib.crc32(codes.read(int(b), int(e)).astype("<u4").tobytes()) for b, e in zip(begins, ends, strict=True)]
                    mask = np.frombuffer(known, np.uint8) == 0
                    places = [pa.array([part] * len(ends), pa.int32()), pa.array([segment] * len(ends), pa.int64())]
                    yield pa.RecordBatch.from_arrays(
                        [*places, pa.array(np.frombuffer(ids, "<i8"), mask=mask), pa.array(begins), pa.array(ends - begins), pa.array(sums, pa.int64())], names
                    )

    stored = spark.read.schema(SCHEMA).parquet(path)
    rows = stored.mapInArrow(run, "part int, segment long, doc_id long, begin long, n_tokens long, ids_crc32 long")
    return rows.join(starts(spark, path), ["part", "segment"]).select(
        "doc_id", (F.col("before") + F.col("begin")).alias("start"), "n_tokens", "ids_crc32"
    )


def read_tokens(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """Single tokens by their place in the whole corpus: ``places`` (place long) with ``token``.

    Only segments that hold a place are opened, and only the chunks of those tokens are read.
    Places that are NULL or outside the corpus are left out.
    """
    bounds = starts(spark, path)
    stored = spark.read.schema(SCHEMA).parquet(path)
    bounds = bounds.join(stored.select("part", "segment", "n_ids"), ["part", "segment"])
    wide = F.lit(SEGMENT_IDS)
    # A segment covers few stretches of SEGMENT_IDS places, so places meet segments on the stretch.
    spans = bounds.where("n_ids > 0").withColumn("stretch", F.explode(F.sequence((F.col("before") / wide).cast("long"), ((F.col("before") + F.col("n_ids") - 1) / wide).cast("long"))))
    hits = (
        places.where("place >= 0").select("place", (F.col("place") / wide).cast("long").alias("stretch"))
        .join(spans, "stretch").where("place >= before AND place < before + n_ids")
        .select("segment", "part", "place", (F.col("place") - F.col("before")).alias("at"))
        .withColumn("group_", F.floor(F.col("at") / 4096)).groupBy("segment", "part", "group_")
        .agg(F.collect_list(F.struct("place", "at")).alias("wanted"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                codes = Codes(row["levels"], row["bitmaps"], row["ranks"])
                found = [(w["place"], codes.token(w["at"])) for w in row["wanted"]]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], ["place", "token"])

    joined = stored.select("segment", "part", "levels", "bitmaps", "ranks").join(hits.drop("group_"), ["part", "segment"])
    return joined.select("levels", "bitmaps", "ranks", "wanted").mapInArrow(run, "place long, token long")
