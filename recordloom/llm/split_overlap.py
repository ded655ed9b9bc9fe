"""Records of evaluation splits that also stand, exactly or almost, in the training split.

A compressed full-text index is built over the words of a shard of evaluation statements: the Burrows-Wheeler transform as
a wavelet matrix of packed bits with counts of ones, and every ``SAMPLED``-th position of the suffix array, from which
the others are found by steps of the transform. Training texts are streamed through backward search, all positions of a batch at once. The
search yields maximal matches, whose spans are merged per pair, and the counts of shared word runs, from which the
likeness follows exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.text import RollingHash, ranges, statement, words

RUN = 3
#: Evaluation items and characters of one index, about; more are searched in several indexes, each over all training rows.
SHARD_ITEMS, SHARD_CHARS = 4096, 4 << 20

#: Distance of sampled positions, and texts that are searched at once.
SAMPLED, TEXTS = 4, 1024
#: Words after which a match is followed along its occurrences instead of by further steps.
SEED = 32

OVERLAP_SCHEMA = (
    "train_key string, heldout_key string, same_words boolean, shared_runs int, likeness double, "
    "matched_words int, longest_match int"
)


class Bits:
    """Packed bits with the number of ones before each 64 of them."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.uint32)]).astype(np.uint32)[:-1]

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0

    def ones(self, end: np.ndarray) -> np.ndarray:
        """Ones before some places."""
        below = (np.uint64(1) << (end & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[end >> 6].astype(np.int64) + np.bitwise_count(self.words[end >> 6] & below)


class WaveletMatrix:
    """A sequence of symbols, one vector of bits for each bit of a symbol, highest first."""

    def __init__(self, data: np.ndarray, symbols: int):
        self.levels: list[tuple[int, Bits, int]] = []
        for bit in range(max(1, (symbols - 1).bit_length()) - 1, -1, -1):
            ones = (data >> bit & 1).astype(bool)
            self.levels.append((bit, Bits(ones), len(data) - int(ones.sum())))
            data = np.concatenate([data[~ones], data[ones]])
        self.starts = np.zeros(symbols, np.int64)
        self.starts = self.count(np.arange(symbols), np.zeros(symbols, np.int64))

    def count(self, symbol: np.ndarray, end: np.ndarray) -> np.ndarray:
        """How often symbols occur before some places."""
        for bit, bits, zeros in self.levels:
            ones = bits.ones(end)
            end = np.where(symbol >> bit & 1, zeros + ones, end - ones)
        return end - self.starts[symbol]

    def at(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols at some places, and how often each occurs before its place."""
        symbol = np.zeros(len(place), np.int64)
        for bit, bits, zeros in self.levels:
            one, ones = bits[place], bits.ones(place)
            symbol |= one.astype(np.int64) << bit
            place = np.where(one, zeros + ones, place - ones)
        return symbol, place - self.starts[symbol]


class WordIndex:
    """Backward search over the words of some texts; text ids are positions in ``texts``."""

    def __init__(self, texts: list[list[str]]):
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}), 2)}
        # 0 ends the whole, 1 ends each text, words follow.
        ids = [np.array([self.vocabulary[w] for w in t] + [1], np.int64) for t in texts]
        data = np.concatenate([*ids, np.zeros(1, np.int64)])
        self.size = len(data)
        self.lengths = np.array([len(t) for t in texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths + 1)])
        order = _suffix_array(data)
        symbols = len(self.vocabulary) + 2
        self.transform = WaveletMatrix(data[order - 1], symbols)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(data, minlength=symbols))])
        sampled = order % SAMPLED == 0
        self.sampled, self.samples = Bits(sampled), order[sampled].astype(np.int32)
        # The statements' distinct runs: how many each has.
        self.run_counts = np.zeros(len(texts), np.int64)
        for k, t in enumerate(ids):
            t = t[:-1]
            if len(t) >= RUN:
                self.run_counts[k] = len(set(zip(*(t[j:].tolist() for j in range(RUN)))))

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        first = self.first[symbol]
        return first + self.transform.count(symbol, low), first + self.transform.count(symbol, high)

    def positions(self, row: np.ndarray) -> np.ndarray:
        """Positions of the suffixes of some rows: steps back to a sampled one, at most ``SAMPLED`` less one."""
        out, row, open_rows = np.zeros(len(row), np.int64), row.copy(), np.arange(len(row))
        for back in range(SAMPLED):
            done = self.sampled[row]
            out[open_rows[done]] = self.samples[self.sampled.ones(row[done])] + back
            open_rows, row = open_rows[~done], row[~done]
            if not len(row):
                break
            symbol, before = self.transform.at(row)
            row = self.first[symbol] + before
        return out

    def text_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, position, "right") - 1

    def encode(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Word ids of the texts behind each other (-1: not in the index) and the text of each word."""
        get = self.vocabulary.get
        flat = np.fromiter((get(w, -1) for t in texts for w in t), np.int64)
        return flat, np.repeat(np.arange(len(texts)), [len(t) for t in texts])


def _suffix_array(data: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last value is smaller than all others."""
    rank = np.unique(data, return_inverse=True)[1].astype(np.int64)
    n, width = len(data), 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            return order
        width *= 2


def search(index: WordIndex, texts: list[list[str]], threshold: float) -> dict[str, np.ndarray]:
    """Pairs (text, item) with the same words or a likeness of ``threshold``, with their merged spans."""
    flat, owner = index.encode(texts)
    n = len(flat)
    counts = np.array([len(t) for t in texts], np.int64)
    empty = {k: np.zeros(0, np.int64) for k in ("text", "item", "shared", "matched", "longest")}
    if not n or index.size <= 1:
        return empty | {"likeness": np.zeros(0), "same": np.zeros(0, bool)}
    begin = np.concatenate([[0], np.cumsum(counts)])[:-1]
    # depth[i]: length of the longest match that ends at word i; low/high: its rows.
    at = np.flatnonzero(flat >= 0)
    # The rows of a single word are those of the first column.
    low, high = index.first[flat[at]], index.first[flat[at] + 1]
    depth = np.zeros(n, np.int64)
    last_low, last_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    run_low, run_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    depth[at], last_low[at], last_high[at] = 1, low, high
    length = 1
    while len(at) and length < SEED:
        source = at - length
        inside = source >= begin[owner[at]]
        at, low, high, source = at[inside], low[inside], high[inside], source[inside]
        known = flat[source] >= 0
        at, low, high, source = at[known], low[known], high[known], source[known]
        low, high = index.step(flat[source], low, high)
        found = low < high
        at, low, high = at[found], low[found], high[found]
        length += 1
        depth[at], last_low[at], last_high[at] = length, low, high
        if length == RUN:
            run_low[at], run_high[at] = low, high
    deep_at, deep_start = _followed(index, at, low, high, depth)

    def places(ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ends and items of the occurrences of their longest matches."""
        shallow = np.flatnonzero(depth[ends] < SEED)
        width = last_high[ends[shallow]] - last_low[ends[shallow]]
        left, right = (np.searchsorted(deep_at, ends, side) for side in ("left", "right"))
        which = np.concatenate([np.repeat(shallow, width), np.repeat(np.arange(len(ends)), right - left)])
        start = np.concatenate([index.positions(ranges(last_low[ends[shallow]], width)), deep_start[ranges(left, right - left)]])
        return which, index.text_of(start)

    # Distinct runs of each text, known to the index or not.
    runs = _distinct_runs(texts)
    # Counts: each distinct run of a text once, at each item that has it.
    ends = np.flatnonzero(run_high > run_low)
    ends = ends[np.unique(owner[ends] * index.size + run_low[ends], return_index=True)[1]]
    width = run_high[ends] - run_low[ends]
    items = index.text_of(index.positions(ranges(run_low[ends], width)))
    # An item that repeats the run counts once for it.
    end, item = np.divmod(np.unique(np.repeat(np.arange(len(ends)), width) * len(index.lengths) + items), len(index.lengths))
    pair, shared = np.unique(owner[ends[end]] * len(index.lengths) + item, return_counts=True)
    text, item = np.divmod(pair, len(index.lengths))
    likeness = shared / np.maximum(runs[text] + index.run_counts[item] - shared, 1)
    keep = likeness >= threshold
    text, item, shared, likeness = text[keep], item[keep], shared[keep], likeness[keep]
    # The same words: a match as long as both texts.
    tail = begin + counts - 1
    whole = np.flatnonzero((counts > 0) & (depth[np.maximum(tail, 0)] == counts))
    which, same_item = places(tail[whole])
    same_text = whole[which]
    equal = index.lengths[same_item] == counts[same_text]
    same = np.unique(same_text[equal] * len(index.lengths) + same_item[equal])
    pair = text * len(index.lengths) + item
    short = same[~np.isin(same, pair)]
    out = {
        "text": np.concatenate([text, short // len(index.lengths)]),
        "item": np.concatenate([item, short % len(index.lengths)]),
        "shared": np.concatenate([shared, np.zeros(len(short), np.int64)]),
        "likeness": np.concatenate([likeness, np.ones(len(short))]),
        "same": np.concatenate([np.isin(pair, same), np.ones(len(short), bool)]),
    }
    # Maximal matches: those that the next word does not extend. Their spans are merged per pair.
    following = np.zeros(n, np.int64)
    following[:-1] = np.where(owner[1:] == owner[:-1], depth[1:], 0)
    wanted = np.isin(owner, out["text"])
    ends = np.flatnonzero(wanted & (depth >= 1) & (following <= depth))
    which, items = places(ends)
    ends = ends[which]
    key = owner[ends] * len(index.lengths) + items
    order = np.lexsort((ends, key))
    key, ends = key[order], ends[order]
    lengths = depth[ends]
    covered = np.zeros(0, np.int64)
    if len(key):
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        previous = np.concatenate([[0], ends[:-1]])
        gain = np.where(fresh, lengths, np.minimum(lengths, ends - previous))
        groups = np.flatnonzero(fresh)
        covered, longest, names = np.add.reduceat(gain, groups), np.maximum.reduceat(lengths, groups), key[groups]
        pair = out["text"] * len(index.lengths) + out["item"]
        place = np.minimum(np.searchsorted(names, pair), len(names) - 1)
        hit = names[place] == pair
        out["matched"], out["longest"] = np.where(hit, covered[place], 0), np.where(hit, longest[place], 0)
    else:
        out["matched"] = out["longest"] = np.zeros(len(out["text"]), np.int64)
    return out


def _followed(index: WordIndex, at: np.ndarray, low: np.ndarray, high: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends and starts, sorted by end, of the longest matches of more than ``SEED`` words; sets their ``depth``.

    A match of ``SEED`` words goes on where the next word's match has the next occurrence, so occurrences in a row on one
    diagonal are one match, however long.
    """
    width = high - low
    end = np.repeat(at, width)
    start = index.positions(ranges(low, width))
    order = np.lexsort((end, end - start))
    end, start = end[order], start[order]
    fresh = np.append(True, (np.diff(end - start) != 0) | (np.diff(end) != 1))[: len(end)]
    head = np.maximum.accumulate(np.where(fresh, np.arange(len(end)), 0))
    longer = np.arange(len(end)) - head
    np.maximum.at(depth, end, SEED + longer)
    best = depth[end] == SEED + longer
    end, start = end[best], start[best] - longer[best]
    order = np.argsort(end, kind="stable")
    return end[order], start[order]


def _distinct_runs(texts: list[list[str]]) -> np.ndarray:
    """How many distinct runs of three words each text has."""
    ids: dict[str, int] = {}
    flat = np.fromiter((ids.setdefault(w, len(ids)) for t in texts for w in t), np.int64)
    counts = np.array([len(t) for t in texts], np.int64)
    if len(flat) < RUN:
        return np.zeros(len(texts), np.int64)
    owner = np.repeat(np.arange(len(texts)), counts)
    inside = owner[: len(flat) - RUN + 1] == owner[RUN - 1 :]
    start = np.flatnonzero(inside)
    hashes = RollingHash(flat).of(start, start + RUN)
    order = np.lexsort((hashes, owner[start]))
    own, h = owner[start][order], hashes[order]
    new = np.concatenate([[True], (own[1:] != own[:-1]) | (h[1:] != h[:-1])])[: len(own)]
    return np.bincount(own[new], minlength=len(texts))


def split_overlap(
    training: DataFrame,
    heldout: DataFrame,
    train_id: str | Column = "train_id",
    train_text: str | Column = "task.problem_text",
    heldout_id: str = "heldout_id",
    prompt: str = "prompt",
    threshold: float = 0.6,
) -> DataFrame:
    """All pairs of a training and a held-out row with the same words or a likeness of at least ``threshold``.

    The held-out set is searched in shards of about ``SHARD_ITEMS`` items and ``SHARD_CHARS`` characters at most, each
    collected and indexed on its own, so what is broadcast is bounded; the training rows are never shuffled. Defined cases: null and wordless texts match
    nothing; texts of fewer than three words match only when all their words are the same; a null id is kept as null;
    repeated rows give repeated pairs only if their ids differ; other columns are ignored.
    """
    spark = training.sparkSession
    column = lambda c: F.col(c) if isinstance(c, str) else c
    items = heldout.select(F.col(heldout_id).cast("string").alias("k"), F.col(prompt).alias("p")).distinct()
    rows = training.select(column(train_id).cast("string").alias("train_key"), column(train_text).alias("text"))
    rows = rows.filter(F.col("text").isNotNull())
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("p")), F.lit(0)).alias("chars")).first()
    shards = max(1, -(-size.n // SHARD_ITEMS), -(-size.chars // SHARD_CHARS))
    found = None
    for k in range(shards):
        shard = items.filter(F.pmod(F.xxhash64("k", "p"), F.lit(shards)) == k).collect()
        part = _overlap_with(spark, rows, [(r.k, r.p) for r in shard], threshold)
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _overlap_with(spark, rows: DataFrame, shard: list[tuple[str, str]], threshold: float) -> DataFrame:
    shard = sorted(shard, key=lambda x: (x[0] or "", x[1] or ""))
    names = [k for k, _ in shard]
    index = spark.sparkContext.broadcast(WordIndex([words(statement(p)) for _, p in shard]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(first, TEXTS)
                keys = batch.column("train_key").to_pylist()
                hit = search(index.value, [words(t) for t in batch.column("text").to_pylist()], threshold)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[i] for i in hit["text"].tolist()], pa.string()),
                        pa.array([names[i] for i in hit["item"].tolist()], pa.string()),
                        pa.array(hit["same"], pa.bool_()),
                        pa.array(hit["shared"].astype(np.int32)),
                        pa.array(hit["likeness"], pa.float64()),
                        pa.array(hit["matched"].astype(np.int32)),
                        pa.array(hit["longest"].astype(np.int32)),
                    ],
                    names=["train_key", "heldout_key", "same_words", "shared_runs", "likeness", "matched_words", "longest_match"],
                )

    return rows.mapInArrow(run, OVERLAP_SCHEMA)
