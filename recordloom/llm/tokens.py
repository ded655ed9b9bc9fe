"""Token counts of texts under an existing tokenizer, without the tokens.

Only counts of distinct normalised segments are computed; a text is the sum over its segments. For a unigram vocabulary
the count of a segment is the length of the best path (Viterbi) through a double-array trie of the pieces. The piece
vocabularies at hand are of the merge (BPE) kind, for which a best path by score is not what the tokenizer does; their
segments are counted by the merges of the tokenizer's own library.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Distinct segments whose counts a worker keeps; beyond, it starts anew.
CACHE = 300_000
SPACE = "▁"
#: A character that no piece covers costs this much more than the worst piece.
UNKNOWN_PENALTY = 10.0


class DoubleArray:
    """Trie over byte strings in two arrays: the child of state s by byte b is base[s] + b + 1 if check there is s."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for k, key in enumerate(keys):
            at = 0
            for b in key:
                if b not in children[at]:
                    children[at][b] = len(children)
                    children.append({})
                    value.append(-1)
                at = children[at][b]
            value[at] = k
        self.base, self.check, self.value = [0], [-1], [-1]
        place = {0: 0}
        # Where nodes with as many children were put last: the places before are taken, for the most part.
        last: dict[int, int] = {}
        for node in range(len(children)):
            if not children[node]:
                continue
            codes = sorted(children[node])
            base = last.get(len(codes), 0)
            while any(base + c + 1 < len(self.check) and self.check[base + c + 1] != -1 for c in codes):
                base += 1
            last[len(codes)] = base
            grow = base + codes[-1] + 2 - len(self.check)
            if grow > 0:
                self.base += [0] * grow
                self.check += [-1] * grow
                self.value += [-1] * grow
            state = place.pop(node)
            self.base[state] = base
            for c in codes:
                child = children[node][c]
                self.check[base + c + 1] = state
                self.value[base + c + 1] = value[child]
                place[child] = base + c + 1

    def prefixes(self, data: bytes, start: int) -> Iterator[tuple[int, int]]:
        """End and key number of every key that starts at ``start``."""
        state, base, check, value = 0, self.base, self.check, self.value
        for at in range(start, len(data)):
            child = base[state] + data[at] + 1
            if child >= len(check) or check[child] != state:
                return
            state = child
            if value[state] >= 0:
                yield at + 1, value[state]


class UnigramCounter:
    """Length of the best path of a segment through a unigram vocabulary."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool = False):
        self.trie = DoubleArray([p.encode() for p, _ in pieces])
        self.scores = [s for _, s in pieces]
        self.unknown = min(self.scores, default=0.0) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback

    def count(self, segment: str) -> int:
        """Pieces on the best path; neighbouring unknown characters are one piece, or one per byte with fallback."""
        data = segment.encode()
        n = len(data)
        best = [-math.inf] * (n + 1)
        length = [0] * (n + 1)
        unknown = [False] * (n + 1)
        best[0] = 0.0
        for at in range(n):
            if best[at] == -math.inf or 0x80 <= data[at] < 0xC0:
                continue
            first = data[at]
            step = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            covered = False
            for end, key in self.trie.prefixes(data, at):
                covered |= end == at + step
                if (score := best[at] + self.scores[key]) > best[end]:
                    best[end], length[end], unknown[end] = score, length[at] + 1, False
            if not covered and (score := best[at] + self.unknown) > best[at + step]:
                new = step if self.byte_fallback else 0 if unknown[at] else 1
                best[at + step], length[at + step], unknown[at + step] = score, length[at] + new, True
        return length[n]


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Number and value of the fields of a protocol buffer."""

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value, at

    at = 0
    while at < len(data):
        tag, at = varint(at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(at)
        else:
            size, at = (8, at) if kind == 1 else (4, at) if kind == 5 else varint(at)
            value, at = data[at : at + size], at + size
        yield tag >> 3, value


def is_unigram(model: bytes) -> bool:
    """Whether a piece model says that it is of the unigram kind (which is also the kind when it says nothing)."""
    trainer = next((v for k, v in _fields(model) if k == 2), b"")
    return next((v for k, v in _fields(trainer) if k == 3), 1) == 1


class TokenCounter:
    """Counts under the piece model at ``path``; white space is a mark that starts pieces."""

    SEGMENT = re.compile(" *[^ ]+| +")

    def __init__(self, path: str = DEFAULT_VOCABULARY):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        with open(path, "rb") as f:
            unigram = is_unigram(f.read())
        p = self.processor
        plain = [i for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        pieces = [p.id_to_piece(i) for i in plain]
        # Segments are independent only where no piece goes on past a mark.
        self.parted = not any(SPACE in x.lstrip(SPACE) for x in pieces)
        self.unigram = None
        if unigram:
            fallback = any(p.is_byte(i) for i in range(p.get_piece_size()))
            self.unigram = UnigramCounter([(x, p.get_score(i)) for x, i in zip(pieces, plain)], fallback)
        self.cache: dict[str, int] = {}

    def _of_segments(self, segments: list[str]) -> list[int]:
        if self.unigram:
            return [self.unigram.count(s.replace(" ", SPACE)) for s in segments]
        # The library puts a mark in front of what it is given, in place of the segment's own.
        counts = [len(x) for x in self.processor.encode([s[1:] for s in segments], num_threads=1)]
        return [c if s != " " else 1 for c, s in zip(counts, segments)]

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """Tokens of each text; 0 for null and empty texts."""
        out = np.zeros(len(texts), np.int64)
        parts: list[tuple[int, Counter]] = []
        new: dict[str, None] = {}
        for i, text in enumerate(texts):
            if not text:
                continue
            if self.unigram or self.parted:
                if self.unigram:
                    text = self.processor.normalize(text)
                    found = Counter(self.SEGMENT.findall(text.replace(SPACE, " ")))
                else:
                    found = Counter(self.SEGMENT.findall(" " + text.replace(SPACE, " ")))
                parts.append((i, found))
                new.update(dict.fromkeys(s for s in found if s not in self.cache))
            else:
                out[i] = len(self.processor.encode(text))
        fresh = list(new)
        self.cache.update(zip(fresh, self._of_segments(fresh)))
        get = self.cache.__getitem__
        for i, found in parts:
            out[i] = sum(map(int.__mul__, map(get, found), found.values()))
        if len(self.cache) > CACHE:
            self.cache.clear()
        return out


def with_token_counts(rows: DataFrame, text: str, count: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """``rows`` with the text column replaced by its tokens in column ``count``; the vocabulary is read by each task."""
    others = [f for f in rows.schema.fields if f.name != text]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + [f"`{count}` long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(vocabulary)
        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                counts = counter.counts(part.column(text).to_pylist())
                columns = [part.column(f.name) for f in others] + [pa.array(counts)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in others] + [count])

    return rows.mapInArrow(run, schema)


def language(column: str | Column) -> Column:
    """Lower-case language without region; ``und`` for null and blank."""
    c = F.col(column) if isinstance(column, str) else column
    base = F.lower(F.trim(F.regexp_extract(c, r"^\s*([A-Za-z]+)", 1)))
    return F.when(c.isNull() | (base == ""), "und").otherwise(base)


def slice_name(column: str | Column) -> Column:
    """Lower-case name without white space around it; ``unknown`` for null and blank."""
    c = F.lower(F.trim(F.col(column) if isinstance(column, str) else column))
    return F.when(c.isNull() | (c == ""), "unknown").otherwise(c)


def token_budget(texts: DataFrame, unique: bool = False, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """Tokens, texts and characters per ``origin, source, lang, subject_domain`` of ``texts``.

    ``texts`` has these columns, ``key``, ``text`` and ``stated_tokens`` (a count that came with the text, or null).
    With ``unique`` rows with one key are one text. Each slice leaves a task as one row, so a hot source is no hot key.
    Defined cases: null and empty texts count as texts with 0 tokens; null names are ``unknown``, null languages
    ``und``; rows with a null key are texts of their own; an empty table gives an empty result.
    """
    own = F.concat(F.lit("#"), F.monotonically_increasing_id())
    prepared = texts.select(
        F.coalesce(F.concat(F.lit("="), F.col("key").cast("string")), own).alias("key"),
        "origin",
        slice_name("source").alias("source"),
        language("lang").alias("lang"),
        slice_name("subject_domain").alias("subject_domain"),
        "stated_tokens",
        F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
        "text",
    )
    counted = with_token_counts(prepared if unique else prepared.drop("key"), "text", "tokens", vocabulary)
    if unique:
        # Only the counts travel; a key that occurs often leaves each task once.
        counted = counted.dropDuplicates(["key"])
    return counted.groupBy("origin", "source", "lang", "subject_domain").agg(
        F.count("*").alias("texts"),
        F.sum("chars").alias("chars"),
        F.sum("tokens").alias("tokens"),
        F.sum(F.when(F.col("stated_tokens") > 0, F.col("stated_tokens"))).alias("stated_tokens"),
    )
