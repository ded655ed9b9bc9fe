"""Two tokenisations of one text on its axis of bytes, and likelihoods of the chunks they share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of text whose ends are in memory at once (a longer text is taken alone).
PART_BYTES = 4 << 20
SHAPES = ("1:1", "1:N", "N:1", "N:M")
#: What the SQL's \s matches: tab, line feed, form feed, carriage return, blank. All are single bytes in UTF-8.
_SPACE = np.isin(np.arange(256), [9, 10, 12, 13, 32])


def with_ends(sizes: Column) -> Column:
    """Cumulative ends of an array of lengths, inside the row (no exchange)."""
    return F.aggregate(
        sizes,
        F.array().cast("array<long>"),
        lambda done, n: F.array_append(done, F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0)) + n),
    )


def word_lengths(text: Column) -> Column:
    """Bytes of the pieces of a text: each word with the white space before it, and the white space at the end."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(\s*\S+|\s+$)"), 1), lambda t: F.octet_length(t).cast("long"))


def fixed_lengths(text: Column, size: int) -> Column:
    """Bytes of pieces of a fixed size; the last one may be shorter."""
    total = F.octet_length(text)
    starts = F.when(total > 0, F.sequence(F.lit(0), total - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.least(F.lit(size), total - s).cast("long"))


def chunk_shapes(left: Column, right: Column) -> Column:
    """Chunks of two arrays of ends: array of structs ``end, left, right`` (how many pieces of each side)."""
    common = F.array_intersect(left, right)
    count = lambda ends, low, high: F.size(F.filter(ends, lambda e: (e > low) & (e <= high)))
    before = F.concat(F.array(F.lit(0).cast("long")), common)
    return F.transform(common, lambda e, i: F.struct(
        e.alias("end"), count(left, F.element_at(before, i + 1), e).alias("left"), count(right, F.element_at(before, i + 1), e).alias("right")
    ))


def align_tokens(left: DataFrame, right: DataFrame, record: str) -> DataFrame:
    """Chunk number of every token of two long tables ``record, position, end_byte``.

    A chunk ends where both sides end. Boundaries come from an equi-join on (record, end); each side's tokens get the
    number of boundaries before them by a running count in the record, so no token is compared with any other. Tokens
    after the last common end are in no chunk.
    """
    ends = left.select(record, "end_byte").intersect(right.select(record, "end_byte")).withColumn("_cut", F.lit(1))
    by = Window.partitionBy(record, "side").orderBy("end_byte", "position")
    both = left.select(record, "position", "end_byte").withColumn("side", F.lit("left")).unionByName(
        right.select(record, "position", "end_byte").withColumn("side", F.lit("right"))
    )
    marked = both.join(ends, [record, "end_byte"], "left")
    cuts_before = F.coalesce(F.sum("_cut").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.coalesce(F.sum("_cut").over(Window.partitionBy(record, "side")), F.lit(0))
    chunk = F.when(cuts_before < total, cuts_before.cast("int"))
    return marked.select(record, "side", "position", "end_byte", chunk.alias("chunk"))


def word_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Ends, on the axis of all bytes, of the words of the texts from offset to offset, each with the white space before it.

    White space at the end of a text is a piece of its own. As ``word_lengths``, but a vertical tab is part of a word.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    space = _SPACE[data]
    last = np.zeros(len(data), bool)
    last[:-1] = ~space[:-1] & space[1:]
    last[offsets[1:][offsets[1:] > offsets[:-1]] - 1] = True
    return np.flatnonzero(last) + 1


def fixed_ends(offsets: np.ndarray, size: int) -> np.ndarray:
    """Ends, on the axis of all bytes, of the pieces of ``fixed_lengths`` of the texts from offset to offset."""
    pieces = -(-np.diff(offsets) // size)
    nth = np.arange(1, pieces.sum() + 1) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.minimum(np.repeat(offsets[:-1], pieces) + size * nth, np.repeat(offsets[1:], pieces))


def shared_chunks(left: np.ndarray, right: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, left and right pieces of each chunk; both sides are rising ends on the axis of all bytes.

    A chunk ends where both sides end and begins at the chunk before it or at its text's start. Pieces after a text's
    last common end are in no chunk.
    """
    marks = np.zeros(offsets[-1] + 1, bool)
    marks[right] = True
    at_left = np.flatnonzero(marks[left])
    common = left[at_left]
    marks[right] = False
    marks[common] = True
    at_right = np.flatnonzero(marks[right])
    text = np.searchsorted(offsets, common) - 1
    first = np.ones(len(common), bool)
    first[1:] = text[1:] != text[:-1]
    counts = []
    for ends, at in ((left, at_left), (right, at_right)):
        before = np.concatenate([[0], at[:-1] + 1]).astype(np.int64)[: len(at)]
        before[first] = np.searchsorted(ends, offsets[text[first]], "right")
        counts.append(at + 1 - before)
    return text, *counts


def shape_counts(rows: DataFrame, record: str, text: str, size: int) -> DataFrame:
    """Per row of ``rows`` its record and ``chunks_K, left_K, right_K``: chunks of shape K (place in ``SHAPES``) that words
    and pieces of ``size`` bytes have in common, and their words and pieces.

    Texts are read once (Arrow batches in Python); no token is a row and nothing is exchanged. A null text is empty, and
    an empty text has no chunk.
    """
    kinds = [f"{what}_{k}" for what in ("chunks", "left", "right") for k in range(len(SHAPES))]

    def counted(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        rows, left, right = shared_chunks(word_ends(data, offsets), fixed_ends(offsets, size), offsets)
        key = len(SHAPES) * rows + 2 * (left > 1) + (right > 1)
        n = len(SHAPES) * (len(offsets) - 1)
        sums = [np.bincount(key, w, n).astype(np.int64).reshape(-1, len(SHAPES)) for w in (None, left, right)]
        return np.concatenate(sums, axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            _, ends, data = texts.buffers()
            offsets = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
            data = np.frombuffer(data or b"", np.uint8)
            start = 0
            while start < len(texts):
                stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + PART_BYTES, "right")) - 1)
                own = offsets[start : stop + 1]
                counts = counted(data[own[0] : own[-1]], own - own[0])
                arrays = [batch.column("record").slice(start, stop - start), *(pa.array(c) for c in counts.T)]
                yield pa.RecordBatch.from_arrays(arrays, names=["record", *kinds])
                start = stop

    source = rows.select(F.col(record).alias("record"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = source.schema["record"].dataType.simpleString()
    return source.mapInArrow(run, f"record {kind}, " + ", ".join(f"{c} long" for c in kinds)).withColumnRenamed("record", record)


def shape_totals(counts: DataFrame) -> DataFrame:
    """``shape, chunks, left_tokens, right_tokens`` of the shapes that occur in rows of ``shape_counts``."""
    sums = counts.agg(*[F.sum(f"{what}_{k}").alias(f"{what}_{k}") for what in ("chunks", "left", "right") for k in range(len(SHAPES))])
    listed = F.array(*[
        F.struct(F.lit(name).alias("shape"), F.col(f"chunks_{k}").alias("chunks"), F.col(f"left_{k}").alias("left_tokens"), F.col(f"right_{k}").alias("right_tokens"))
        for k, name in enumerate(SHAPES)
    ])
    return sums.select(F.inline(listed)).filter("chunks > 0")


def contiguous(tokens: DataFrame, record: str) -> DataFrame:
    """Per record of a table ``record, position, start_byte, end_byte``: whether each token starts where the last ended."""
    by = Window.partitionBy(record).orderBy("position")
    gaps = tokens.select(record, (F.col("start_byte") != F.coalesce(F.lag("end_byte").over(by), F.lit(0))).alias("_gap"), "end_byte")
    return gaps.groupBy(record).agg((~F.bool_or("_gap")).alias("contiguous"), F.max("end_byte").alias("bytes"))


def chunk_sums(tokens: DataFrame, record: str, chunk: str, value: str) -> DataFrame:
    """Sum of the values of each chunk; tokens in no chunk are left out."""
    return tokens.filter(F.col(chunk).isNotNull()).groupBy(record, chunk).agg(F.sum(value).alias("chunk_logprob"), F.count("*").alias("tokens"))


def dense_chunks(chunks: DataFrame, record: str, chunk: str) -> DataFrame:
    """Chunks numbered from 0 without gaps, after some were dropped."""
    return chunks.withColumn("dense_chunk", F.dense_rank().over(Window.partitionBy(record).orderBy(chunk)) - 1)


def clipped(start: Column, end: Column, low: Column, high: Column) -> tuple[Column, Column, Column]:
    """Whether a span touches a range, and the part inside it."""
    return (end > low) & (start < high), F.greatest(start, low), F.least(end, high)


def end_labels(positions: Column, keep: Column, ends: Column) -> Column:
    """Labels of a sequence: tokens of the answer, and exactly one end token; -100 elsewhere."""
    return F.transform(positions, lambda x, i: F.when((F.element_at(keep, i + 1)) | (F.element_at(ends, i + 1)), x).otherwise(F.lit(-100)))


def end_audit(labels: Column, end_token: Column) -> Column:
    """Struct: labelled tokens, labelled end tokens, whether the last labelled token is the end."""
    labelled = F.filter(labels, lambda x: x != -100)
    return F.struct(
        F.size(labelled).alias("labelled"),
        F.size(F.filter(labelled, lambda x: x == end_token)).alias("ends"),
        F.coalesce(F.try_element_at(labelled, F.lit(-1)) == end_token, F.lit(False)).alias("ends_last"),
    )


def single_occurrence(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key occurs once: counted with partial sums, so a frequent key is never in one place."""
    once = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n = 1").drop("_n")
    same = [rows[k].eqNullSafe(once[k]) for k in keys]
    return rows.join(once, same, "left_semi")
