"""Jaccard join of word shingle sets by grouped prefixes, and the components of its links."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sourcelode.llm.components import components
from sourcelode.llm.storage import written
from sourcelode.llm.words import shingle_sets, slices, tidy, U64

#: Counters of the table that estimates how frequent shingles are; a fixed size for any corpus.
COUNTERS = 1 << 18
COUNTER_ROWS = 64
#: An element is 5 bits of frequency class and 43 bits of hash, so that elements sort rare first.
CLASSES, HASH_BITS = 31, 43
#: Bits of the filter that keeps texts without candidates out of the verification.
FILTER_BITS = 1 << 24
#: Shares that the rows of a frequent element are dealt into.
SALTS = 32


def frequency_classes(docs: DataFrame, words: int) -> np.ndarray:
    """Frequency class of every counter: 0 up to four times the mean and 64, one more per doubling.

    All distinct shingles of all documents are counted by the first 18 bits of their hash. The
    classes only order the elements; any order finds all links, this one keeps passages that many
    documents share out of the prefixes.
    """
    step = COUNTERS // COUNTER_ROWS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            texts = batch.column(0)
            for start, stop in slices(texts):
                sets = shingle_sets(texts.slice(start, stop - start), words)
                at = (np.concatenate([*sets, np.zeros(0, U64)]) >> U64(64 - 18)).astype(np.int64)
                total += np.bincount(at, minlength=COUNTERS)
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(COUNTER_ROWS), pa.int32()), pa.array([total[r * step : (r + 1) * step].tobytes() for r in range(COUNTER_ROWS)], pa.binary())],
            ["part", "counts"],
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(counts, np.int64)
                sums[part] = sums[part] + own if part in sums else own
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())], ["part", "counts"]
        )

    schema = "part int, counts binary"
    counted = docs.select("text").mapInArrow(tidy(count), schema).repartition(COUNTER_ROWS, "part").mapInArrow(tidy(add), schema)
    total = np.zeros(COUNTERS, np.int64)
    for row in counted.collect():  # 64 rows of 32 KB
        total[row["part"] * step : (row["part"] + 1) * step] = np.frombuffer(row["counts"], np.int64)
    scale = 4 * total.mean() + 64
    return np.clip(np.ceil(np.log2(np.maximum(total, 1) / scale)), 0, CLASSES).astype(np.uint8)


def elements(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Sorted elements of a set: rare classes first, then by hash."""
    own = classes[(hashes >> U64(64 - 18)).astype(np.int64)].astype(np.int64) << HASH_BITS
    return np.sort(own | (hashes >> U64(64 - HASH_BITS)).astype(np.int64))


def prefix_length(size: int, percent: int) -> int:
    """Elements of which two sets that link share at least one."""
    return size - -(-percent * size // 100) + 1


def parity(values: np.ndarray) -> bytes:
    """A bit per residue of the elements: whether an odd number has it.

    The set bits of two sketches' XOR are at most the elements that only one of the sets has.
    The sketch has about a bit per element; a longer one folds onto a shorter one.
    """
    bits = 64
    while bits < len(values):
        bits *= 2
    odd = np.bincount(values & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def least_difference(left: bytes, right: bytes) -> int:
    """Elements that at least are in one of two sets only, from their sketches."""
    a, b = (int.from_bytes(x, "little") for x in sorted((left, right), key=len))
    bits = 8 * min(len(left), len(right))
    while b >> bits:
        width = bits
        while b >> (2 * width):
            width *= 2
        b = (b >> width) ^ (b & ((1 << width) - 1))
    return (a ^ b).bit_count()


def _describe(classes: np.ndarray, words: int, percent: int):
    names = ["doc_id", "n", "set_key", "group_key", "sketch", "prefix"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                sizes, keys, groups, sketches, prefixes = [], [], [], [], []
                for hashes in shingle_sets(part.column(1), words):
                    size = len(hashes)
                    own = elements(hashes, classes)
                    prefix = own[: prefix_length(size, percent)] if size else own
                    sketches.append(parity(own))
                    sizes.append(size)
                    keys.append(hashlib.blake2b(hashes.tobytes(), digest_size=16).digest())
                    groups.append(hashlib.blake2b(prefix.tobytes() + size.to_bytes(8, "little"), digest_size=16).digest())
                    prefixes.append(prefix)
                ends = np.concatenate(([0], np.cumsum([len(p) for p in prefixes])))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(groups, pa.binary()), pa.array(sketches, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*prefixes, np.zeros(0, np.int64)])))],
                    names,
                )

    return run


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by element and salt, those whose element another row has; rows of salted
    elements pass. Only neighbours are compared, so nothing of a list is held."""
    held: pa.RecordBatch | None = None
    last = None
    for batch in batches:
        if not len(batch):
            continue
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        token, salt = batch.column(0).to_numpy(), batch.column(4).to_numpy()
        same = token[1:] == token[:-1]
        keep = salt >= 0
        keep[1:] |= same
        keep[:-1] |= same
        keep[0] |= bool(last == token[0])
        # The last row waits for the next one.
        yield batch.slice(0, len(batch) - 1).filter(pa.array(keep[:-1]))
        if len(batch) > 1:
            last = token[-2]
        held = batch.slice(len(batch) - 1)
    if held is not None:
        token, salt = held.column(0)[0].as_py(), held.column(4)[0].as_py()
        if salt >= 0 or last == token:
            yield held


def _sets(classes: np.ndarray, words: int, wanted: np.ndarray):
    """Elements of the texts whose id may be wanted, six bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = np.asarray(batch.column(2))
            batch = batch.filter(pa.array((wanted[bit >> 3] >> (bit & 7).astype(np.uint8) & 1).astype(bool)))
            for start, stop in slices(batch.column(1)):
                part = batch.slice(start, stop - start)
                packed = [_pack(elements(h, classes)) for h in shingle_sets(part.column(1), words)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["id", "own"])

    return run


def _pack(values: np.ndarray) -> bytes:
    return values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    out = np.zeros((len(packed) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return out.view("<i8").ravel()


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, known = None, None
        for batch in batches:
            keep = []
            for one, right in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if of != one:  # by content: an id has a set per row
                    of, known = one, _unpack(one)
                other = _unpack(right)
                at = np.searchsorted(known, other)
                at[at == len(known)] = 0
                both = int((known[at] == other).sum()) if len(known) else 0
                keep.append(100 * both >= percent * (len(known) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return run


def _possible(percent: int):
    """Pairs whose sketches allow the similarity: sets of n and m elements link if at most
    (100 - percent) / (100 + percent) * (n + m) are in one of them only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column(2).to_numpy()
            least = np.fromiter(
                (least_difference(a, b) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)), np.int64, len(batch)
            )
            yield batch.select([0, 1]).filter(pa.array((100 + percent) * least <= (100 - percent) * total))

    return run


def verified(pairs: DataFrame, members: DataFrame, docs: DataFrame, classes: np.ndarray, words: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (left, right: ids of different classes) whose whole sets link.

    Sketches of ``members`` (id, n, sketch) leave few of the others; for the rest the texts are read
    again, only those of ids in a pair."""
    light = members.select("id", "n", "sketch")
    pairs = pairs.join(light.toDF("left", "n", "sketch"), "left").join(light.toDF("right", "m", "other"), "right")
    pairs = pairs.select("left", "right", (F.col("n") + F.col("m")).alias("total"), "sketch", "other")
    pairs = written(pairs.mapInArrow(tidy(_possible(percent)), "left long, right long").distinct(), "pairs")
    ids = pairs.select(F.col("left").alias("id")).unionByName(pairs.select(F.col("right").alias("id"))).distinct()
    # A filter of fixed size: a set bit for the hash of every wanted id, gathered as 64-bit words.
    bit = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    gathered = ids.select(bit.alias("bit")).groupBy(F.floor(F.col("bit") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(bit % 64 AS INT))")).alias("bits")
    )
    wanted = np.zeros(FILTER_BITS // 64, np.int64)
    for row in gathered.toLocalIterator():
        wanted[row["word"]] = row["bits"]
    texts = docs.select(F.col("doc_id").alias("id"), "text").withColumn("bit", bit)
    sets = texts.where("id IS NOT NULL").mapInArrow(tidy(_sets(classes, words, wanted.view(np.uint8))), "id long, own binary")
    sets = written(sets.join(ids, "id", "left_semi"), "sets")
    both = pairs.join(sets.withColumnRenamed("id", "right").withColumnRenamed("own", "other"), "right")
    both = both.join(sets.withColumnRenamed("id", "left"), "left").select("left", "right", "own", "other")
    return written(both.mapInArrow(tidy(_verify(percent)), "left long, right long").distinct(), "verified")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text).

    Words are runs of bytes other than space and 0x09 to 0x0D of the text with A-Z lower-cased, a
    document's set its distinct shingles of ``words`` words (all its words, if fewer). Two documents
    link when 100 * intersection >= ``percent`` * union; ``component_id`` is the smallest doc_id that
    links reach. A NULL text, or one without words, has no shingles and no links. Rows of one
    doc_id are one document, so links of any of them hold for all. Rows of NULL doc_id have a NULL component
    and link with nothing. Other columns are not read; no rows give no rows.

    1. Documents with the same set are one class, named by its smallest id; classes with identical
       prefixes and size are one group.
    2. Groups that share a prefix element are candidates if their sizes, and the places of the
       element in both sets, allow the similarity. In a first pass every group meets only the
       most connected group of each of its elements; its members are verified against it.
    3. In a second pass all candidate pairs that are not yet connected are expanded to members
       and verified, so no link between components is lost, and a large group of near copies does
       not become all its pairs.
    4. Components of the verified links are found by star rounds.

    Sets are compared exactly, as 48-bit elements; shingles are known by 64-bit hashes.
    """
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    classes = frequency_classes(docs, words)
    described = written(
        docs.mapInArrow(tidy(_describe(classes, words, percent)), "doc_id long, n long, set_key binary, group_key binary, sketch binary, prefix array<long>"), "described"
    )
    light = described.where("n > 0 AND doc_id IS NOT NULL").select("doc_id", "n", "set_key", "group_key", "sketch")
    members = written(light.groupBy("set_key", "n", "group_key").agg(F.min("doc_id").alias("id"), F.min("sketch").alias("sketch")), "classes")
    groups = (
        described.where("n > 0 AND doc_id IS NOT NULL").groupBy("group_key", "n")
        .agg(F.min("doc_id").alias("group_id"), F.first("prefix").alias("prefix"))
    )
    # One row per prefix element; (element, size, place) tell whether two groups can be alike.
    rows = groups.select(F.posexplode("prefix").alias("place", "token"), "group_id", "n")
    frequent = F.shiftright("token", HASH_BITS) > 0
    salt = F.when(frequent, F.pmod(F.xxhash64("group_id"), F.lit(SALTS)).cast("int")).otherwise(F.lit(-1))
    rows = rows.select("token", "group_id", "n", "place", salt.alias("salt"))
    shuffles = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lists = rows.repartition(shuffles, "token", "salt").sortWithinPartitions("token")
    lists = written(lists.mapInArrow(tidy(_shared), rows.schema).drop("salt"), "lists")

    # First pass: the most connected group of every element, by the summed lengths of its lists.
    lengths = lists.groupBy("token").agg(F.count("*").alias("length")).where("length > 1")
    connected = lists.join(lengths, "token").groupBy("group_id").agg(F.sum("length").alias("weight"))
    weighed = lists.join(connected, "group_id")
    leaders = weighed.groupBy("token").agg(F.max(F.struct("weight", (-F.col("group_id")).alias("minus"), F.col("n").alias("leader_n"))).alias("best"))
    leaders = leaders.select("token", (-F.col("best.minus")).alias("leader"), F.col("best.leader_n").alias("leader_n"))
    sized = f"100 * least(n, leader_n) >= {percent} * greatest(n, leader_n)"
    stars = lists.join(leaders, "token").where(f"group_id <> leader AND {sized}").select("group_id", "leader").distinct()
    group_ids = members.groupBy("group_key").agg(F.min("id").alias("group_id"))
    of_group = written(members.select("id", "group_key").join(group_ids, "group_key").select("id", "group_id"), "members")
    first = of_group.join(stars, "group_id").select(F.col("leader").alias("left"), F.col("id").alias("right"))
    inside = of_group.where("id <> group_id").select(F.col("group_id").alias("left"), F.col("id").alias("right"))
    linked = verified(first.unionByName(inside).distinct(), members, docs, classes, words, percent)

    # Rows of one doc_id with different texts belong together.
    same = light.join(members.select("set_key", "n", "id"), ["set_key", "n"]).groupBy("doc_id").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    same = same.where("low <> high OR low <> doc_id")
    repeated = light.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id")
    same = same.join(repeated, "doc_id").select(F.explode(F.array(F.struct(F.col("low").alias("left"), F.col("high").alias("right")), F.struct(F.col("low").alias("left"), F.col("doc_id").alias("right")))).alias("p")).select("p.*")

    found = components(linked)
    labelled = written(of_group.join(found, of_group["id"] == found["node"], "left").select("id", "group_id", F.coalesce("component", "id").alias("label")), "labels")
    labels = labelled.groupBy("group_id").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    # Second pass: elements whose groups are not all of one component yet.
    marked = lists.join(labels, "group_id")
    mixed = marked.groupBy("token").agg(F.min("low").alias("t_low"), F.max("high").alias("t_high")).where("t_low <> t_high").select("token")
    marked = written(marked.join(mixed, "token", "left_semi"), "mixed")
    other = marked.select("token", *(F.col(c).alias(f"{c}_2") for c in ("group_id", "n", "place", "low", "high")))
    # What follows the element in both sets, the element, and what precedes it bound the overlap.
    bound = "least(n - place, n_2 - place_2) + least(place, place_2)"
    fits = F.expr(
        f"group_id < group_id_2 AND NOT (low = high AND low_2 = high_2 AND low = low_2) AND 100 * least(n, n_2) >= {percent} * greatest(n, n_2)"
        f" AND {100 + percent} * ({bound}) >= {percent} * (n + n_2)"
    )
    # All common elements up to the earlier end of both prefixes are shared prefix elements; at most
    # the rest of one set follows.
    after = f"greatest(ceil({percent} * n / 100), ceil({percent} * n_2 / 100)) - 1"
    candidates = marked.join(other, "token").where(fits).groupBy("group_id", "group_id_2", "n", "n_2").agg(F.count("*").alias("shared"))
    candidates = candidates.where(f"{100 + percent} * (shared + {after}) >= {percent} * (n + n_2)").select("group_id", "group_id_2")
    across = (
        candidates.join(labelled.select("group_id", F.col("id").alias("left"), F.col("label").alias("a")), "group_id")
        .join(labelled.select(F.col("group_id").alias("group_id_2"), F.col("id").alias("right"), F.col("label").alias("b")), "group_id_2")
        .where("a <> b").select("left", "right")
    )
    # Members of one group that its first member does not link with meet each other.
    split = labelled.join(labels.where("low <> high").select("group_id"), "group_id")
    within = split.select("group_id", F.col("id").alias("left"), F.col("label").alias("a")).join(
        split.select("group_id", F.col("id").alias("right"), F.col("label").alias("b")), "group_id"
    ).where("left < right AND a <> b").select("left", "right")
    more = verified(across.unionByName(within).distinct(), members, docs, classes, words, percent)

    joined = found.select(F.col("node").alias("left"), F.col("component").alias("right")).unionByName(more).unionByName(same)
    final = components(joined)
    by_set = members.join(final, members["id"] == final["node"], "left").select("set_key", "n", F.coalesce("component", "id").alias("component_id"))
    out = described.select("doc_id", F.col("n").alias("n_shingles"), "set_key")
    return out.join(by_set.withColumnRenamed("n", "n_shingles"), ["set_key", "n_shingles"], "left").select(
        "doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
