"""Groups of records that share most of their content but for small edits.

Records become sets of hashed word runs. Records with equal sets form a class, and only classes are compared. A class has
a fingerprint of 128 bits, one bit of the smallest element under each of 128 permutations, so that the likeness of two
sets shows in the bits in which their fingerprints differ; a small set, whose bits would hang together, has the map of
its elements' bits instead, whose differences bound those of the sets.

At a likeness of 0.6 alike fingerprints differ in so many bits that an index over them alone prunes nothing. The codes of
the index are therefore a rare word run of the class, on which two codes must agree, followed by the fingerprint, in
which they may differ: a class is entered under each of its rarest runs, as many as make certain that two classes above
the threshold share one. All codes are sorted by Gray rank and dealt to tasks by ranges of it; in a task the
Gray-order index factors the bits that neighbours share into upper nodes and prunes pairs of nodes, with all below them,
by accumulated differences. What is left is decided exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.gray_index import GrayIndex
from recordloom.llm.text import COUNTER_SCHEMA, RollingHash, counter_rows, mix, ranges, total_counts, words
from recordloom.session import materialize

BITS = 128
#: Differences beyond the expected number, in standard deviations, that the radius allows. Were the bits independent, a
#: pair at a likeness of 0.6 would be missed with a chance of about 6 in 10 million; larger sets come near to that.
MARGIN = 5.2
#: Runs of the smaller set below which a pair does not rely on fingerprints.
SMALL = 64
#: log2 of the counters that order word runs by their frequency, from least to most: they grow with the runs, and what is
#: broadcast of them is a byte each. Only the order of runs hangs on them; frequent codes are counted exactly.
SKETCH_BITS = (16, 22)
#: Classes under one run that are compared at once; those of a more frequent run are split into blocks.
PART = 1 << 14
#: Codes of one index, about.
CODES = 1 << 16
#: Copies of one text, byte by byte, that are written as pairs each; of more copies the first stands for all in pairs.
EXPANDED = 32

_RNG = np.random.default_rng(20)
MULTIPLIERS = _RNG.integers(0, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

SET_SCHEMA = "record_id string, class_key long, text_key long, size int, high long, low long, map_high long, map_low long, runs binary"
CODE_SCHEMA = "run long, class_key long, size int, high long, low long, map_high long, map_low long"
CODE_COLUMNS = tuple(c.split(" ")[0] for c in CODE_SCHEMA.split(", "))


def radius(threshold: float) -> int:
    """Bits in which fingerprints of sets with a likeness of ``threshold`` may differ."""
    p = (1 - threshold) / 2
    return math.floor(BITS * p + MARGIN * math.sqrt(BITS * p * (1 - p)))


def run_sets(texts: list[str], run: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the word runs of each text behind each other, and where each text's begin."""
    ids: dict[str, int] = {}
    lists = [words(t) for t in texts]
    flat = np.fromiter((ids.setdefault(w, len(ids)) for t in lists for w in t), np.int64)
    counts = np.array([len(t) for t in lists], np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    if len(flat) < run:
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    hashed = np.fromiter((xxhash.xxh64_intdigest(w) for w in ids), np.uint64, len(ids))
    start = np.flatnonzero(owner[: len(flat) - run + 1] == owner[run - 1 :])
    hashes = RollingHash(hashed[flat]).of(start, start + run)
    order = np.lexsort((hashes, owner[start]))
    own, hashes = owner[start][order], hashes[order]
    new = np.ones(len(own), bool)
    new[1:] = (own[1:] != own[:-1]) | (hashes[1:] != hashes[:-1])
    begin = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(own[new], minlength=len(texts)), out=begin[1:])
    return hashes[new], begin


def fingerprints(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two lanes of one bit per permutation: that of the element which the permutation puts first."""
    lanes = np.zeros((2, len(begin) - 1), np.uint64)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        for k, by in enumerate(MULTIPLIERS):
            bit = np.minimum.reduceat(hashes * by, begin[full]) & np.uint64(1)
            lanes[k // 64, full] |= bit << np.uint64(k % 64)
    return lanes[0], lanes[1]


def bitmaps(hashes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two lanes of 128 bits, those at which some element of the set stands."""
    lanes = np.zeros((2, len(begin) - 1), np.uint64)
    full = np.flatnonzero(np.diff(begin))
    if len(full):
        place = mix(hashes) & np.uint64(BITS - 1)
        for k in range(2):
            bit = np.where(place // np.uint64(64) == k, np.uint64(1) << (place % np.uint64(64)), np.uint64(0))
            lanes[k, full] = np.bitwise_or.reduceat(bit, begin[full])
    return lanes[0], lanes[1]


def _sets(run: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                texts = part.column("text").to_pylist()
                hashes, begin = run_sets(texts, run)
                high, low = fingerprints(hashes, begin)
                map_high, map_low = bitmaps(hashes, begin)
                sums = np.zeros(len(begin), np.uint64)
                total = np.concatenate([[np.uint64(0)], np.cumsum(mix(hashes), dtype=np.uint64)])
                sums = total[begin[1:]] - total[begin[:-1]]
                size = np.diff(begin)
                keep = pa.array(size > 0)
                # Of the bytes themselves: it tells different texts of one class apart.
                text = np.fromiter((xxhash.xxh64_intdigest(t) for t in texts), np.uint64, len(texts))
                rows = [hashes[a:b].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("record_id"),
                        pa.array(mix(sums + size.astype(np.uint64)).view(np.int64)),
                        pa.array(text.view(np.int64)),
                        pa.array(size.astype(np.int32)),
                        pa.array(high.view(np.int64)),
                        pa.array(low.view(np.int64)),
                        pa.array(map_high.view(np.int64)),
                        pa.array(map_low.view(np.int64)),
                        pa.array(rows, pa.binary()),
                    ],
                    names=["record_id", "class_key", "text_key", "size", "high", "low", "map_high", "map_low", "runs"],
                ).filter(keep)

    return work


def _sketch(bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int64)
        for batch in batches:
            hashes = np.frombuffer(b"".join(batch.column("runs").to_pylist()), np.uint64)
            counts += np.bincount((hashes >> np.uint64(64 - bits)).astype(np.int64), minlength=len(counts))
        yield counter_rows(counts)

    return work


def frequencies(sets: DataFrame) -> np.ndarray:
    """Size classes (eighths of powers of two, a byte each) of the counters of all word runs of all records."""
    total = sets.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n")).first().n
    bits = min(max(int(total).bit_length() + 1, SKETCH_BITS[0]), SKETCH_BITS[1])
    counts = total_counts(sets.select("runs").mapInArrow(_sketch(bits), COUNTER_SCHEMA), 1 << bits)
    return np.minimum(np.floor(8 * np.log2(1.0 + counts)), 255).astype(np.uint8)


def _rarest(counts, threshold: float):
    """Each class under its rarest runs; copies of a class leave an Arrow batch once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = counts.value
        shift = np.uint64(64 - (len(table).bit_length() - 1))
        for batch in batches:
            _, fresh = np.unique(batch.column("class_key").to_numpy(), return_index=True)
            batch = batch.take(pa.array(np.sort(fresh)))
            size = batch.column("size").to_numpy().astype(np.int64)
            hashes = np.frombuffer(b"".join(batch.column("runs").to_pylist()), np.uint64)
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((hashes, table[(hashes >> shift).astype(np.int64)], owner))
            take = size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1
            picked = order[ranges(np.cumsum(size) - size, take)]
            rows = pa.array(owner[picked])
            columns = [batch.column(c).take(rows) for c in CODE_COLUMNS[1:]]
            yield pa.RecordBatch.from_arrays([pa.array(hashes[picked].view(np.int64)), *columns], names=list(CODE_COLUMNS))

    return work


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of a frequent run: its classes are split into blocks, and each pair of blocks gets a run of its own."""
    for batch in batches:
        many = -(-batch.column("classes").to_numpy() // PART)
        row = np.repeat(np.arange(batch.num_rows), many)
        other = ranges(np.zeros(batch.num_rows, np.int64), many).astype(np.uint64)
        many = many[row].astype(np.uint64)
        mine = mix(batch.column("class_key").to_numpy().view(np.uint64))[row] % many
        cell = np.minimum(mine, other) * many + np.maximum(mine, other)
        run = batch.column("run").to_numpy().view(np.uint64)[row]
        run = mix(run + (cell + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        rows = pa.array(row)
        columns = [batch.column(c).take(rows) for c in CODE_COLUMNS[1:]]
        yield pa.RecordBatch.from_arrays([pa.array(run.view(np.int64)), *columns], names=list(CODE_COLUMNS))


def gray_column(run: Column) -> Column:
    """Rank of a 64-bit word in the Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        run = run.bitwiseXOR(F.shiftrightunsigned(run, shift))
    return run


def index_pairs(codes: dict[str, np.ndarray], threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of pairs of codes that share their run and are close, and what the indexes tested, pruned and spared."""
    size = codes["size"].astype(np.int64)
    lanes = lambda *names: np.stack([codes[n].view(np.uint64) for n in names])
    found, figures = [], np.zeros(3, np.int64)
    # Sets that differ in d elements have maps that differ in at most d bits, and alike sets differ in few elements.
    share = (1 - threshold) / (1 + threshold)
    for small in (False, True):
        members = np.flatnonzero(size * threshold < SMALL + 1e-9 if small else size >= SMALL)
        if len(members) < 2:
            continue
        if small:
            index = GrayIndex(lanes("run", "map_high", "map_low")[:, members], size[members] * share + 1e-6)
        else:
            index = GrayIndex(lanes("run", "high", "low")[:, members], np.full(len(members), radius(threshold) / 2))
        a, b = (members[x] for x in index.pairs())
        low, high = np.minimum(size[a], size[b]), np.maximum(size[a], size[b])
        keep = (low >= threshold * high - 1e-9) & ((low < SMALL) == small)
        found.append((a[keep], b[keep]))
        figures += (index.tested, index.pruned, index.spared)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *(x for x, _ in found)]), np.concatenate([none, *(y for _, y in found)]), figures


def _close_pairs(threshold: float):
    """Pairs of classes with close codes; rows come sorted by the Gray rank of their run and by class."""

    def compare(codes: dict[str, np.ndarray]) -> pa.RecordBatch:
        run, key = codes["run"], codes["class_key"]
        new = np.ones(len(run), bool)
        new[1:] = (run[1:] != run[:-1]) | (key[1:] != key[:-1])
        codes = {c: x[new] for c, x in codes.items()}
        a, b, _ = index_pairs(codes, threshold)
        x, y = codes["class_key"][a], codes["class_key"][b]
        pairs = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1) if len(x) else np.zeros((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["key_a", "key_b"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            last = batch.column("run")[-1].as_py()
            if size < CODES or held[0].column("run")[0].as_py() == last:
                continue
            whole = pa.Table.from_batches(held).combine_chunks()
            columns = {n: whole.column(n).to_numpy() for n in CODE_COLUMNS}
            cut = int(np.flatnonzero(columns["run"] != last)[-1]) + 1
            yield compare({n: c[:cut] for n, c in columns.items()})
            held = whole.slice(cut).to_batches()
            size = whole.num_rows - cut
        if held:
            whole = pa.Table.from_batches(held)
            yield compare({n: whole.column(n).to_numpy() for n in CODE_COLUMNS})

    return work


def _exact(threshold: float):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, values = [], []
            for i, (a, b) in enumerate(zip(batch.column("runs_a").to_pylist(), batch.column("runs_b").to_pylist())):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                likeness = shared / (len(x) + len(y) - shared)
                if likeness >= threshold:
                    keep.append(i)
                    values.append(likeness)
            part = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column("key_a"), part.column("key_b"), pa.array(values, pa.float64())], names=["key_a", "key_b", "likeness"]
            )

    return work


def record_sets(records: DataFrame, record_id: str | Column, text: Column, run: int) -> DataFrame:
    """The records' sets of word runs, written to the shared folder."""
    column = F.col(record_id) if isinstance(record_id, str) else record_id
    rows = records.select(column.cast("string").alias("record_id"), text.alias("text"))
    rows = rows.filter(F.col("record_id").isNotNull() & F.col("text").isNotNull())
    return materialize(rows.mapInArrow(_sets(run), SET_SCHEMA), "run-sets")


def similar_classes(sets: DataFrame, threshold: float) -> DataFrame:
    """``key_a, key_b, likeness`` of all pairs of classes with at least the likeness, smaller key first."""
    spark = sets.sparkSession
    counts = spark.sparkContext.broadcast(frequencies(sets))
    codes = materialize(sets.mapInArrow(_rarest(counts, threshold), CODE_SCHEMA), "codes")
    # Counted exactly; there are at most as many frequent runs as codes by PART.
    hot = codes.groupBy("run").agg(F.count("*").alias("classes")).filter(F.col("classes") > PART)
    if not hot.isEmpty():
        hot = materialize(hot, "frequent-runs")
        split = codes.join(hot, "run").select(*CODE_COLUMNS, "classes").mapInArrow(_blocks, CODE_SCHEMA)
        codes = codes.join(hot, "run", "left_anti").select(*CODE_COLUMNS).unionByName(split)
    rank = gray_column(F.col("run"))
    sorted_codes = codes.repartition(F.shiftright(rank, 44)).sortWithinPartitions(rank, "class_key")
    pairs = materialize(
        sorted_codes.mapInArrow(_close_pairs(threshold), "key_a long, key_b long").distinct(), "close-pairs"
    )
    # One record stands for each class that is in a pair.
    first = sets.groupBy("class_key").agg(F.min("record_id").alias("record_id"))
    in_pair = pairs.select(F.col("key_a").alias("class_key")).union(pairs.select("key_b")).distinct()
    chosen = first.join(in_pair, "class_key", "left_semi")
    members = sets.select("record_id", "class_key", "runs").join(chosen, ["record_id", "class_key"], "left_semi")
    runs = materialize(members.dropDuplicates(["class_key"]).select("class_key", "runs"), "pair-sets")
    side = lambda s: runs.select(F.col("class_key").alias(f"key_{s}"), F.col("runs").alias(f"runs_{s}"))
    joined = pairs.join(side("a"), "key_a").join(side("b"), "key_b")
    return joined.mapInArrow(_exact(threshold), "key_a long, key_b long, likeness double")


def near_duplicate_pairs(
    records: DataFrame, record_id: str | Column, text: Column, threshold: float = 0.8, run: int = 5
) -> DataFrame:
    """``id_a, id_b`` (smaller first) of records with a likeness of at least ``threshold`` in runs of ``run`` words.

    All pairs of records with different texts come out, whether their sets of runs are equal or not, and so do those of
    texts with up to ``EXPANDED`` byte by byte equal copies; of more copies the first record stands for all in pairs, and
    each other copy is paired with the first. Defined cases: a null id or text takes no part; texts with fewer than
    ``run`` words are in no pair; rows that repeat an id are one record; other columns are ignored.
    """
    sets = record_sets(records, record_id, text, run)
    links = materialize(similar_classes(sets, threshold), "class-links")
    members = sets.select("record_id", "class_key", "text_key").distinct()
    sizes = members.groupBy("class_key", "text_key").agg(F.count("*").alias("copies"), F.min("record_id").alias("first"))
    members = members.join(sizes, ["class_key", "text_key"])
    shown = members.filter((F.col("copies") <= EXPANDED) | (F.col("record_id") == F.col("first")))
    side = lambda s: shown.select(F.col("class_key").alias(f"key_{s}"), F.col("record_id").alias(f"r_{s}"))
    across = links.join(side("a"), "key_a").join(side("b"), "key_b").select("r_a", "r_b")
    within = side("a").join(side("b"), F.col("key_a") == F.col("key_b")).filter("r_a < r_b").select("r_a", "r_b")
    star = members.filter((F.col("copies") > EXPANDED) & (F.col("record_id") != F.col("first")))
    star = star.select(F.col("first").alias("r_a"), F.col("record_id").alias("r_b"))
    return (
        across.union(within).union(star)
        .select(F.least("r_a", "r_b").alias("id_a"), F.greatest("r_a", "r_b").alias("id_b"))
        .filter("id_a <> id_b")
        .distinct()
    )


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of the nodes in ``links(a, b)``: the smallest node of each connected set.

    Each round gives every node the smallest label among its neighbours and then follows the label's own label; both
    are joins, and the labels are written to the shared folder after each round. A label only ever falls, so the rounds
    end.
    """
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), "links")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("label")).withColumnRenamed("a", "node"), "labels")
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(seen.withColumnRenamed("a", "node"), "node").select(
            "node", "label", F.least("label", "near").alias("next")
        )
        jump = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        fresh = step.join(jump, "next", "left").select(
            "node", "label", F.least("next", F.coalesce("far", "next")).alias("new")
        )
        fresh = materialize(fresh, "labels")
        changed = fresh.filter("label <> new").limit(1).count()
        labels = fresh.select("node", F.col("new").alias("label"))
        if not changed:
            return labels.withColumnRenamed("label", "component")


def near_duplicate_groups(
    records: DataFrame, record_id: str | Column, text: Column, threshold: float = 0.8, run: int = 5
) -> DataFrame:
    """One row per record with a word run: its group, its class, the members of the class and the links of the class.

    ``group_id`` is the smallest record id among the classes that links connect, ``class_id`` that of the records with an
    equal set of runs and ``text_id`` that of those with an equal text; ``copies`` counts the records with an equal set,
    ``links`` the other classes with at least the likeness. With ``text_id`` the pairs in which a text's first record
    stands for its copies are those of all of them. Cases as in ``near_duplicate_pairs``.
    """
    sets = record_sets(records, record_id, text, run)
    found = materialize(similar_classes(sets, threshold), "class-links")
    members = sets.select("record_id", "class_key", "text_key").distinct()
    sizes = materialize(
        members.groupBy("class_key").agg(F.countDistinct("record_id").alias("copies"), F.min("record_id").alias("first")), "classes"
    )
    texts = members.groupBy("class_key", "text_key").agg(F.min("record_id").alias("text_id"))
    name = lambda s: sizes.select(F.col("class_key").alias(f"key_{s}"), F.col("first").alias(s))
    named = materialize(found.join(name("a"), "key_a").join(name("b"), "key_b").select("a", "b"), "named-links")
    degree = named.select("a").union(named.select("b")).groupBy("a").agg(F.count("*").alias("links"))
    classes = (
        sizes.join(degree.withColumnRenamed("a", "first"), "first", "left")
        .join(components(named).withColumnRenamed("node", "first"), "first", "left")
        .select(
            "class_key", F.col("first").alias("class_id"), "copies",
            F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "first").alias("group_id"),
        )
    )
    whole = members.join(texts, ["class_key", "text_key"]).join(classes, "class_key")
    return whole.groupBy("record_id").agg(*[F.min(c).alias(c) for c in ("group_id", "class_id", "text_id", "copies", "links")])
