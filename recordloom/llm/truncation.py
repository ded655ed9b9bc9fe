"""Texts that were cut at a fixed length or in transfer.

A backward character model reads a text from its end: the character before a place, and the first token of the line it
stands in. For each such context it counts, over all texts, how often it occurs, how often the line ends
there and how often the text does; shorter contexts back up longer ones. The likelihood of an end after the final
context of a text, as against that of going on, is that of the line's end there and of the text's after such a line. A
text whose log-odds lie below the threshold is cut; the threshold is found per column and language, where the log-odds
of all its texts leave a gap. The one thing that is not learned is whether a place lies between fences of code.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.text import COUNTER_BLOCK, COUNTER_SCHEMA, counter_rows, mix, total_counts
from recordloom.llm.tokens import language, slice_name
from recordloom.session import materialize

#: Marks that are put where text was lost.
LOST = ("…", "[…]", "[...]", "�")
FENCE = "```"
#: Symbols of characters: a letter of the alphabet is itself, others are classes.
_SINGLE = " \n.,;:!?()[]{}`'\"-_—。，！？：；"
OTHER, LETTER, IDEOGRAPH, DIGIT = 0, 27, 28, 29
_IDEOGRAPHS = "\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af"
SYMBOLS = 64
CHUNK = 1 << 20
#: Counters of the contexts; contexts are hashed to them.
COUNTERS = 1 << 21
#: Characters of a line's first token that tell lines apart.
TOKEN = 12
#: Weight of the shorter context's likelihood in that of the longer one.
BACKUP = 20.0
#: Bins of the log-odds, from LOWEST to 0, and the range in which the threshold is sought.
BINS, LOWEST = 96, -24.0
THRESHOLDS = (-13.0, -6.0)
#: Bins on either side that should be empty at a threshold, bins beyond that should not, and texts of all languages that
#: back up those of one.
AROUND, BESIDE, SHARED = 3, 8, 2000.0


def _symbol_table() -> np.ndarray:
    table = np.zeros(1 << 16, np.int8)
    for cp in range(1 << 16):
        c = chr(cp)
        if c.isdigit():
            table[cp] = DIGIT
        elif c.isalpha():
            low = c.lower()[0]
            table[cp] = ord(low) - 96 if "a" <= low <= "z" else IDEOGRAPH if cp >= 0x2E80 else LETTER
    for k, c in enumerate(_SINGLE):
        table[ord(c)] = 30 + k
    return table


_TABLE = _symbol_table()
BREAK = int(_TABLE[10])


def symbols(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _TABLE[np.minimum(data, 0xFFFF)].astype(np.int64)


#: First tokens: ideographs in a row, as they are not parted by blanks, or else what stands before a blank or ideograph.
_FIRST = re.compile(f"[{_IDEOGRAPHS}]{{1,4}}|[^ {_IDEOGRAPHS}]{{1,{TOKEN}}}")


def opening(line: str) -> tuple[int, int]:
    """Of a line's first token: what class of characters it begins with, and a hash of the token, digits as one."""
    match = _FIRST.match(line)
    if not match:
        return 0, 0
    token = match[0]
    if token[0].isdigit():
        return DIGIT, DIGIT
    first = token[0]
    kind = (1 if first.isupper() else 2 if first.islower() else 3) if first.isalpha() else 64 + int(_TABLE[min(ord(first), 0xFFFF)])
    return kind, xxhash.xxh64_intdigest(token) & 0xFFFFFFFFFF


def fences(lines: list[str]) -> list[bool]:
    """Whether the end of each line lies between fences of code."""
    out, inside = [], False
    for line in lines:
        inside ^= line.startswith(FENCE)
        out.append(inside)
    return out


def body(text: str) -> tuple[str, bool]:
    """The text without white space and marks of loss at its end, and whether there was a mark."""
    text = text.rstrip()
    lost = False
    while text.endswith(LOST):
        mark = max((m for m in LOST if text.endswith(m)), key=len)
        text, lost = text[: -len(mark)].rstrip(), True
    return text, lost


def _hashes(level: int, *parts: np.ndarray) -> np.ndarray:
    """Hash of what a context has of its line, or of a symbol alone."""
    out = np.full(len(parts[0]), level, np.uint64)
    for p in parts:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + p.astype(np.uint64))
    return (out & np.uint64(COUNTERS - 1)).astype(np.int32)


#: Hashes of the symbols, and of their classes, in which letters and ideographs are one each.
_EACH = np.arange(SYMBOLS)
_SYMBOL_HASH, _CLASS_HASH = _hashes(7, _EACH), _hashes(8, np.where(_EACH < LETTER, np.minimum(_EACH, 1), _EACH))


class _Chunk:
    """Places of some texts behind each other: their contexts, and which of them are ends of lines and of texts.

    Each text is ``(text without marks, hash of its column and language, whether it had a mark)``.
    """

    def __init__(self, texts: list[tuple[str, int, bool]]):
        lines = [t.split("\n") for t, *_ in texts]
        # A line break belongs to the line that it ends, and one more parts the texts.
        s0 = symbols("".join(t + "\n" for t, *_ in texts))
        flat = [x for ls in lines for x in ls]
        size = np.array([len(x) + 1 for x in flat])
        code = np.array([x for ls in lines for x in fences(ls)], np.int64)
        kind, token = (np.array(x, np.int64) for x in zip(*map(opening, flat)))
        lang = np.repeat(np.array([x for _, x, _ in texts], np.int64), [len(ls) for ls in lines])
        lengths = np.array([len(t) + 1 for t, *_ in texts])
        self.starts = np.cumsum(lengths) - lengths
        self.last = np.cumsum(lengths) - 2
        self.lengths = lengths
        self.inside = s0 != BREAK
        self.line_ends = np.append(s0[1:] == BREAK, False) & self.inside
        # The end of a marked text, or of one inside a block, speaks for nothing.
        self.own = ~np.array([lost for *_, lost in texts]) & (code[np.cumsum([len(ls) for ls in lines]) - 1] == 0)
        self.text_ends = np.zeros(len(s0), bool)
        self.text_ends[self.last] = self.own
        self.line_ends[self.last] = self.own
        # Shorter contexts first. Further characters before the last one make the odds no better, see the README. What a
        # context has of its line is hashed once a line.
        symbol, coarse = _SYMBOL_HASH[s0], _CLASS_HASH[s0]
        tokens = np.repeat(_hashes(3, code, token), size)
        self.numbers = [
            np.repeat(_hashes(0, code), size) ^ symbol,
            np.repeat(_hashes(1, code, lang), size) ^ symbol,
            np.repeat(_hashes(2, code * 256 + kind), size) ^ symbol,
            tokens ^ coarse,
            tokens ^ symbol,
        ]

    def add_to(self, counts: np.ndarray) -> None:
        places = self.inside, np.flatnonzero(self.line_ends), np.flatnonzero(self.text_ends)
        for number in self.numbers:
            for k, which in enumerate(places):
                counts[k * COUNTERS : (k + 1) * COUNTERS] += np.bincount(number[which], minlength=COUNTERS)


def _chunks(batch: pa.RecordBatch) -> Iterator[tuple[list[int], "_Chunk"]]:
    """Row numbers of texts that are not empty without their marks, and their places."""
    rows: list[int] = []
    texts: list[tuple[str, int, bool]] = []
    size = 0
    for i, (text, lang) in enumerate(zip(batch.column("text").to_pylist(), batch.column("lang_no").to_pylist())):
        text, lost = body(text)
        if text:
            rows.append(i)
            texts.append((text, lang, lost))
            size += len(text)
        if size >= CHUNK:
            yield rows, _Chunk(texts)
            rows, texts, size = [], [], 0
    if texts:
        yield rows, _Chunk(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each context occurs anywhere, then how often at the end of a line and of a text."""
    counts = np.zeros(-(-3 * COUNTERS // COUNTER_BLOCK) * COUNTER_BLOCK, np.int64)
    for batch in batches:
        for _, chunk in _chunks(batch):
            chunk.add_to(counts)
    yield counter_rows(counts)


class BackwardModel:
    """Log-odds of an end after a context, from the counts of all texts."""

    def __init__(self, counts: np.ndarray):
        self.every, self.line_ends, self.text_ends = (counts[k * COUNTERS : (k + 1) * COUNTERS].astype(np.int32) for k in range(3))

    def log_odds(self, chunk: _Chunk) -> np.ndarray:
        """For the end of each text, by the counts of all other texts: no text speaks about its own end."""
        line = text = np.full(len(chunk.last), 1e-4)
        line_ends = chunk.line_ends.copy()
        for number in chunk.numbers:
            final = number[chunk.last]
            same = (number == np.repeat(final, chunk.lengths)) & chunk.inside
            every = self.every[final] - np.add.reduceat(same, chunk.starts, dtype=np.int64)
            lines = self.line_ends[final] - np.add.reduceat(same & line_ends, chunk.starts, dtype=np.int64)
            texts = self.text_ends[final] - chunk.own
            # Less their standard error: one or two cut texts with a context are no sign that texts end there.
            line = (np.maximum(lines - np.sqrt(np.maximum(lines, 0)), 0) + BACKUP * line) / (every + BACKUP)
            text = (np.maximum(texts - np.sqrt(np.maximum(texts, 0)), 0) + BACKUP * text) / (lines + BACKUP)
        p = line * np.minimum(text, 1.0)
        return np.log(p / (1 - p + 1e-9))


SCORE_SCHEMA = "text_id string, column string, lang string, source string, lost_mark boolean, log_odds double"


def _score(model):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odds = np.zeros(batch.num_rows)
            for rows, chunk in _chunks(batch):
                odds[rows] = model.value.log_odds(chunk)
            marks = [body(t)[1] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("text_id", "column", "lang", "source")), pa.array(marks), pa.array(odds)],
                names=["text_id", "column", "lang", "source", "lost_mark", "log_odds"],
            )

    return work


def valley(histogram: np.ndarray) -> float:
    """The log-odds within ``THRESHOLDS`` around which a histogram is emptiest for what lies on either side."""
    total = np.concatenate([[0.0], np.cumsum(histogram)])
    edge = np.arange(BINS + 1)
    span = lambda a, b: total[np.clip(b, 0, BINS)] - total[np.clip(a, 0, BINS)]
    near = span(edge - AROUND, edge + AROUND)
    sides = np.minimum(span(edge - AROUND - BESIDE, edge - AROUND), span(edge + AROUND, edge + AROUND + BESIDE))
    value = LOWEST + edge * (-LOWEST / BINS)
    score = np.where((value >= THRESHOLDS[0]) & (value <= THRESHOLDS[1]), (near + 0.5) / (sides + 1.0), np.inf)
    least = np.flatnonzero(score <= score.min() + 1e-9)
    return float(value[least[len(least) // 2]])


def truncation_scores(texts: DataFrame) -> DataFrame:
    """``text_id, column, lang, source, lost_mark, log_odds, threshold, truncated`` of every text with a character that is
    no white space; ``texts`` has ``text_id, text, lang, source`` and may name the ``column`` that a text is of.

    Defined cases: null, empty and blank texts are left out; a text of marks only is not truncated; a null language is
    ``und``, a null source ``unknown``, a null column ``text``; repeated rows are scored as often as they occur.
    """
    spark = texts.sparkSession
    column = F.col("column") if "column" in texts.columns else F.lit(None)
    rows = texts.select(
        F.col("text_id").cast("string").alias("text_id"),
        F.coalesce(column.cast("string"), F.lit("text")).alias("column"),
        "text",
        language("lang").alias("lang"),
        slice_name("source").alias("source"),
    )
    rows = rows.filter(F.col("text").isNotNull() & F.col("text").rlike(r"\S"))
    rows = rows.withColumn("lang_no", F.xxhash64("column", "lang"))
    counts = total_counts(rows.select("text", "lang_no").mapInArrow(_count, COUNTER_SCHEMA), 3 * COUNTERS)
    model = spark.sparkContext.broadcast(BackwardModel(counts))
    scores = materialize(rows.mapInArrow(_score(model), SCORE_SCHEMA), "end-scores")
    bin_no = F.greatest(F.lit(0), F.least(F.lit(BINS - 1), F.floor((F.col("log_odds") - LOWEST) / (-LOWEST / BINS))))
    bins = scores.groupBy("column", "lang", bin_no.cast("int").alias("bin")).agg(F.count("*").alias("texts"))
    whole = np.zeros(BINS)
    for r in bins.groupBy("bin").agg(F.sum("texts").alias("n")).collect():
        whole[r.bin] = r.n
    shared = whole * SHARED / max(whole.sum(), 1)

    def threshold(pdf: pd.DataFrame) -> pd.DataFrame:
        own = np.bincount(pdf["bin"], pdf["texts"], minlength=BINS)
        return pd.DataFrame({"column": pdf["column"].iloc[:1], "lang": pdf["lang"].iloc[:1], "threshold": [valley(own + shared)]})

    limits = bins.groupBy("column", "lang").applyInPandas(threshold, "column string, lang string, threshold double")
    scored = scores.join(limits, ["column", "lang"])
    return scored.withColumn("truncated", F.col("log_odds") < F.col("threshold"))
