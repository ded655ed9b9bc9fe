"""Stretches of at least a given length that stand verbatim in more than one record.

An automaton over the whole collection can be broadcast no more than the collection itself, and one per shard of it
would send every record past every shard. The automata are therefore built over small reference shards that hold all
that can match: records are cut at content-chosen anchors (the smallest hashed run of ``ANCHOR`` characters in every
``length`` characters), so two records that share a stretch of that length share an anchor inside it. The records'
surroundings of one anchor are a shard. Hashes only tell which shard a record must see: its surroundings are then streamed
through the suffix automaton of the shard for matching statistics, which gives the maximal spans exactly. Where a shard
would be too large for one automaton, its stretches are told apart by hashes of 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.llm.text import RollingHash, code_points, rows_of, sliding
from recordloom.session import materialize

ANCHOR = 50
#: Characters that are hashed at once in a Python worker.
CHUNK = 1 << 20
#: Different surroundings of one anchor beyond which they are compared by hashes of all their stretches instead.
SHARD_WINDOWS = 64
#: Automata that a task keeps.
KEPT = 64

ANCHOR_SCHEMA = "anchor long, around long, row_key long, at int"
PLACE_SCHEMA = ANCHOR_SCHEMA + ", text_key long"


def anchors(texts: list[str], length: int, places: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, hash of its surroundings, number of the text and position, for every anchor of the texts.

    Without ``places`` an anchor that a text has again and again with equal surroundings comes out once.
    """
    data, offsets = code_points(texts)
    n, none = len(data), np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none
    rolling = RollingHash(data)
    hashes = rolling.of(slice(0, n - ANCHOR + 1), slice(ANCHOR, n + 1)) | np.uint64(1)
    smallest = sliding(hashes, length - ANCHOR + 1, np.minimum)
    ends = np.repeat(offsets[1:], np.diff(offsets))[: len(smallest)]
    # A stretch that crosses the end of a text is none.
    smallest[ends - np.arange(len(smallest)) < length] = 0
    pad = np.zeros(length - ANCHOR, np.uint64)
    chosen = np.flatnonzero(sliding(np.concatenate([pad, smallest, pad]), length - ANCHOR + 1, np.maximum) == hashes)
    text = np.searchsorted(offsets, chosen, "right") - 1
    start = np.maximum(offsets[text], chosen - (length - ANCHOR))
    end = np.minimum(offsets[text + 1], chosen + length)
    # Of another lane than the anchor, with which it always goes: 128 bits tell surroundings apart.
    around = RollingHash(data, 1).of(start, end) + (end - start).astype(np.uint64)
    out = hashes[chosen].view(np.int64), around.view(np.int64), text, chosen - offsets[text]
    if places:
        return out
    order = np.lexsort(out[:3])
    a, w, k = (x[order] for x in out[:3])
    new = np.ones(len(order), bool)
    new[1:] = (a[1:] != a[:-1]) | (w[1:] != w[:-1]) | (k[1:] != k[:-1])
    return tuple(x[order][new] for x in out)


def chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``CHUNK`` characters together."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def anchor_rows(length: int, places: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys = batch.column("row_key").to_numpy(zero_copy_only=False)
            text_keys = batch.column("text_key").to_numpy(zero_copy_only=False) if places else None
            for a, b in chunks(texts):
                anchor, around, text, at = anchors(texts[a:b], length, places)
                columns = [pa.array(anchor), pa.array(around), pa.array(keys[a:b][text]), pa.array(at.astype(np.int32))]
                if places:
                    columns.append(pa.array(text_keys[a:b][text]))
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "around", "row_key", "at", "text_key"][: len(columns)])

    return run


class SuffixAutomaton:
    """Automaton of all substrings of some texts; each state knows the smallest and largest key that has it."""

    def __init__(self) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.low: list[int | None] = [None]
        self.high: list[int | None] = [None]

    def _state(self, length: int, link: int, edges: dict[str, int]) -> int:
        self.next.append(edges)
        self.link.append(link)
        self.length.append(length)
        self.low.append(None)
        self.high.append(None)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: str) -> int:
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def add(self, text: str, low: int, high: int) -> None:
        last = 0
        for c in text:
            q = self.next[last].get(c)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._split(last, q, c)
            else:
                new, p = self._state(self.length[last] + 1, 0, {}), last
                while p >= 0 and c not in self.next[p]:
                    self.next[p][c] = new
                    p = self.link[p]
                if p >= 0:
                    q = self.next[p][c]
                    self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, c)
                last = new
            if self.low[last] is None or low < self.low[last]:
                self.low[last] = low
            if self.high[last] is None or high > self.high[last]:
                self.high[last] = high

    def finish(self) -> None:
        """Hand the keys up to the shorter substrings."""
        for s in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            p = self.link[s]
            if p > 0 and self.low[s] is not None:
                if self.low[p] is None or self.low[s] < self.low[p]:
                    self.low[p] = self.low[s]
                if self.high[p] is None or self.high[s] > self.high[p]:
                    self.high[p] = self.high[s]

    def spans(self, text: str, low: int, high: int, length: int) -> list[tuple[int, int]]:
        """Merged spans of at least ``length`` characters that also stand in a text of another key.

        The text is that of the keys ``low`` to ``high``; with more than one key all of it stands elsewhere.
        """
        if low != high:
            return [(0, len(text))] if len(text) >= length else []
        out: list[tuple[int, int]] = []
        state = have = 0
        for i, c in enumerate(text):
            while state and c not in self.next[state]:
                state = self.link[state]
                have = self.length[state]
            if c in self.next[state]:
                state, have = self.next[state][c], have + 1
            while state and self.low[state] == low and self.high[state] == low:
                state = self.link[state]
                have = self.length[state]
            if have >= length:
                start = i + 1 - have
                if out and start <= out[-1][1]:
                    start = min(start, out.pop()[0])
                out.append((start, i + 1))
        return out


def _shard_spans(length: int):
    """Spans by shard; rows come sorted by anchor, and no anchor has more than ``SHARD_WINDOWS`` rows."""

    def shard(anchor: int, rows: list[tuple[int, str, int, int]], out: list[tuple[int, int, int, int]]) -> None:
        automaton = SuffixAutomaton()
        for _, text, low, high in rows:
            automaton.add(text, low, high)
        automaton.finish()
        for around, text, low, high in rows:
            out += [(anchor, around, a, b) for a, b in automaton.spans(text, low, high, length)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            columns = rows_of(batch, "anchor", "around", "surroundings", "low", "high")
            for anchor, *row in zip(*columns):
                if anchor != now and rows:
                    shard(now, rows, out)
                    rows = []
                now = anchor
                rows.append(tuple(row))
            yield _span_batch(out)
        out = []
        if rows:
            shard(now, rows, out)
        yield _span_batch(out)

    return run


def _span_batch(spans: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*spans)) or [()] * 4
    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, types)], names=["anchor", "around", "span_start", "span_end"]
    )


def _right_cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Only the surroundings with the right hash: of an id with several texts the others are cut at a wrong place."""
    for batch in batches:
        if batch.num_rows:
            data, offsets = code_points(batch.column("surroundings").to_pylist())
            start, end = offsets[:-1], offsets[1:]
            hashes = RollingHash(data, 1).of(start, end) + (end - start).astype(np.uint64)
            batch = batch.filter(pa.array(hashes.view(np.int64) == batch.column("around").to_numpy()))
        yield batch


def _stretches(length: int):
    """Hashes of all stretches of the surroundings: for anchors with too many surroundings for one automaton."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("surroundings").to_pylist()
            for first in range(0, len(texts), 2000):
                part = texts[first : first + 2000]
                data, offsets = code_points(part)
                if len(data) < length:
                    continue
                start = np.arange(len(data) - length + 1)
                text = np.searchsorted(offsets, start, "right") - 1
                inside = start + length <= offsets[text + 1]
                start, text = start[inside], text[inside]
                hashes = RollingHash(data, 1).of(start, start + length)
                take = pa.array(text + first)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64))]
                    + [batch.column(c).take(take) for c in ("anchor", "around", "low", "high")]
                    + [pa.array((start - offsets[text]).astype(np.int32))],
                    names=["stretch", "anchor", "around", "low", "high", "span_start"],
                )

    return run


def _prepared(records: DataFrame, record_id: str | Column, text: str | Column, length: int) -> DataFrame:
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = records.select(column(record_id).cast("string").alias("record_id"), column(text).alias("text"))
    rows = rows.filter(F.col("record_id").isNotNull() & (F.length("text") >= length))
    return rows.withColumn("row_key", F.xxhash64("record_id"))


def _candidates(rows: DataFrame, length: int, places: bool) -> DataFrame:
    """Anchors that occur in more than one record, written to the shared folder."""
    taken = rows.select("row_key", "text", *["text_key"] * places)
    every = materialize(taken.mapInArrow(anchor_rows(length, places), PLACE_SCHEMA if places else ANCHOR_SCHEMA), "anchors")
    # Hot anchors leave each task as one row.
    spread = every.groupBy("anchor").agg(F.min("row_key").alias("low"), F.max("row_key").alias("high"))
    shared = spread.filter("low <> high").select("anchor")
    return materialize(every.join(shared, "anchor", "left_semi"), "shared-anchors")


def _spans(rows: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``anchor, around, span_start, span_end`` of the surroundings in ``wanted``; offsets are in the surroundings."""
    back = length - ANCHOR
    first = F.greatest(F.col("at") - back, F.lit(0))
    cut = F.substring("text", first + 1, F.col("at") + length - first)
    one = wanted.groupBy("anchor", "around").agg(
        F.min("row_key").alias("low"), F.max("row_key").alias("high"), F.min(F.struct("row_key", "at")).alias("_from")
    )
    one = one.select("anchor", "around", "low", "high", F.col("_from.row_key").alias("row_key"), F.col("_from.at").alias("at"))
    one = materialize(one, "surroundings-keys")
    sizes = one.groupBy("anchor").agg(F.count("*").alias("shard_size"))
    texts = rows.select("row_key", "text").dropDuplicates(["row_key", "text"])
    columns = ["anchor", "around", "surroundings", "low", "high", "shard_size"]
    pieces = one.join(sizes, "anchor").join(texts, "row_key").withColumn("surroundings", cut).select(columns)
    shards = materialize(pieces.mapInArrow(_right_cuts, pieces.schema), "surroundings")
    # The exchange must come straight from the written table: after a join on the same key it would be left out of the
    # plan as needless, and the join may then be run without one, which tears shards apart.
    small = (
        shards.filter(F.col("shard_size") <= SHARD_WINDOWS)
        .repartition("anchor")
        .sortWithinPartitions("anchor", "around")
        .mapInArrow(_shard_spans(length), "anchor long, around long, span_start int, span_end int")
    )
    stretches = shards.filter(F.col("shard_size") > SHARD_WINDOWS).mapInArrow(
        _stretches(length), "stretch long, anchor long, around long, low long, high long, span_start int"
    )
    # Equal stretches have the same anchor at the same place, so anchor and stretch together are 128 bits of hash.
    twice = stretches.groupBy("anchor", "stretch").agg(F.min("low").alias("_low"), F.max("high").alias("_high"))
    large = stretches.join(twice.filter("_low <> _high"), ["anchor", "stretch"], "left_semi").select(
        "anchor", "around", "span_start", (F.col("span_start") + length).alias("span_end")
    )
    return small.unionByName(large)


def _streamed(length: int):
    """Records whose stretch of text, streamed through the automaton of their shard, matches far enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Rows of a shard mostly follow each other; the automaton of the last shards is kept.
        built: dict[str, SuffixAutomaton] = {}
        for batch in batches:
            out = []
            for key, text, reference in zip(*rows_of(batch, "row_key", "text", "reference")):
                automaton = built.get(reference)
                if automaton is None:
                    if len(built) >= KEPT:
                        built.clear()
                    automaton = built[reference] = SuffixAutomaton()
                    automaton.add(reference, 1, 1)
                    automaton.finish()
                if automaton.spans(text, 0, 0, length):
                    out.append(key)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64())], names=["row_key"])

    return run


def _confirmed(rows: DataFrame, shared: DataFrame, length: int) -> DataFrame:
    """Records with equal surroundings of an anchor, by hash, that the automaton of another such record confirms.

    A record sees one shard, the first of those. The shard's reference text comes to the records by a join on the shard,
    so a shard with a third of all records is split like any hot join key.
    """
    place = F.struct("row_key", "at")
    groups = shared.groupBy("anchor", "around").agg(F.min(place).alias("low"), F.max(place).alias("high"))
    groups = groups.filter("low.row_key <> high.row_key")
    seen = shared.join(groups, ["anchor", "around"])
    first = F.min(F.struct("anchor", "around", "at", "low", "high")).alias("s")
    seen = seen.groupBy("row_key").agg(first).select("row_key", "s.*")
    other = F.when(F.col("row_key") != F.col("low.row_key"), F.col("low")).otherwise(F.col("high"))
    seen = materialize(seen.select("anchor", "around", "row_key", "at", other.alias("other")), "shards-seen")
    texts = rows.select("row_key", "text").dropDuplicates(["row_key", "text"])
    begin = F.greatest(F.col("at") - (length - ANCHOR), F.lit(0))
    cut = F.substring("text", begin + 1, F.col("at") + length - begin)
    own = seen.join(texts, "row_key").select("anchor", "around", "row_key", F.col("other.row_key").alias("other_key"), cut.alias("text"))
    needed = seen.select("anchor", "around", F.col("other.row_key").alias("row_key"), F.col("other.at").alias("at")).distinct()
    references = needed.join(texts, "row_key").select("anchor", "around", F.col("row_key").alias("other_key"), cut.alias("reference"))
    together = own.join(references, ["anchor", "around", "other_key"]).select("row_key", "text", "reference")
    return together.mapInArrow(_streamed(length), "row_key long").distinct()


def records_with_shared_spans(
    records: DataFrame, record_id: str | Column = "id", text: str | Column = "response_text", length: int = 200
) -> DataFrame:
    """``record_id`` of each record of whose text ``length`` characters also stand in a record with another id.

    Defined cases: a null id or text takes no part; texts shorter than ``length`` share nothing; rows that repeat an id
    are one record; texts may be of any length; other columns are ignored.
    """
    rows = _prepared(records, record_id, text, length)
    shared = _candidates(rows, length, False)
    found = materialize(_confirmed(rows, shared, length), "found")
    # The records that this does not decide go on, with whatever shares an anchor with them.
    open_rows = shared.join(found, "row_key", "left_anti")
    wanted = materialize(shared.join(open_rows.select("anchor").distinct(), "anchor", "left_semi"), "open-anchors")
    spans = _spans(rows, wanted, length).select("anchor", "around").distinct()
    late = wanted.join(spans, ["anchor", "around"], "left_semi").select("row_key")
    every = found.unionByName(late).distinct()
    return rows.select("record_id", "row_key").distinct().join(every, "row_key", "left_semi").select("record_id")


def shared_span_shares(
    records: DataFrame, record_id: str | Column = "id", text: str | Column = "response_text", length: int = 200
) -> DataFrame:
    """Per record with shared stretches: characters, shared characters, their share, spans and the longest span.

    Overlapping and touching spans are merged. Defined cases as in ``records_with_shared_spans``; each text of an
    id that occurs with several texts is a row.
    """
    rows = _prepared(records, record_id, text, length).withColumn("text_key", F.xxhash64("text"))
    shared = _candidates(rows, length, True)
    spread = shared.groupBy("anchor", "around").agg(F.min("row_key").alias("low"), F.max("row_key").alias("high"))
    uneven = spread.filter("low = high").select("anchor", "around")
    # Where all of an anchor's surroundings are equal, they are the span; the others go through the automata.
    mixed = materialize(shared.join(uneven.select("anchor").distinct(), "anchor", "left_semi"), "mixed-anchors")
    back = length - ANCHOR
    first = F.greatest(F.col("at") - back, F.lit(0))
    whole = shared.join(spread.filter("low <> high"), ["anchor", "around"], "left_semi").select(
        "row_key", "text_key", first.alias("span_start"), (F.col("at") + length).alias("span_end")
    )
    parts = mixed.join(_spans(rows, mixed, length), ["anchor", "around"]).select(
        "row_key", "text_key", (first + F.col("span_start")).alias("span_start"), (first + F.col("span_end")).alias("span_end")
    )
    sizes = rows.select("record_id", "row_key", "text_key", F.length("text").alias("chars")).distinct()
    spans = whole.unionByName(parts).distinct().join(sizes, ["row_key", "text_key"])
    spans = spans.withColumn("span_end", F.least("span_end", "chars"))
    # Merged per record by a running end; a record's spans are bounded by its own length.
    by = Window.partitionBy("record_id", "text_key", "chars")
    before = by.orderBy("span_start", "span_end").rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max("span_end").over(before), F.lit(-1))
    starts = spans.withColumn("_new", (F.col("span_start") > reached).cast("int"))
    groups = starts.withColumn("_group", F.sum("_new").over(by.orderBy("span_start", "span_end").rowsBetween(Window.unboundedPreceding, 0)))
    merged = groups.groupBy("record_id", "text_key", "chars", "_group").agg(
        F.min("span_start").alias("a"), F.max("span_end").alias("b")
    )
    shares = merged.groupBy("record_id", "text_key", "chars").agg(
        F.sum(F.col("b") - F.col("a")).cast("long").alias("shared_chars"),
        F.round(F.sum(F.col("b") - F.col("a")) / F.col("chars"), 6).alias("shared_share"),
        F.count("*").alias("spans"),
        F.max(F.col("b") - F.col("a")).alias("longest_span"),
    )
    return shares.drop("text_key")
