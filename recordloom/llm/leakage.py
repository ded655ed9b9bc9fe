"""Passages of evaluation items inside a large corpus.

Latent semantic retrieval. Passages of the corpus are TF-IDF rows over the words of the items, with document frequencies
counted over all passages; a distributed randomised SVD of a bounded sample of these rows gives the latent space. The
items' own passages are folded into it as queries. Corpus passages are candidates of an item by their cosine with its
queries, and candidates are decided by comparing words: runs in a row, longest common subsequences and answers.

Two cosine searches go over the corpus in one scan. The first looks at every stretch of ``run`` words, none of which is
foreign to the items, and takes those that are as near to a query as the least near of the query's own runs: a verbatim
run has that cosine in whatever space, so none is lost, and the better the space the fewer others come along. The second
looks at longer passages, foreign words included, and takes those above a fixed cosine for the tests of reworded text.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.llm.text import array_rows, statement, total_arrays, words
from recordloom.session import materialize

#: Latent dimensions, and further random directions of the sketch.
RANK, OVERSAMPLE = 96, 16
#: Columns of the TF-IDF rows at most: words of the items beyond that share columns.
FEATURES = 1 << 16
#: Corpus passages that the space is fitted to, about, and those that a task contributes at most.
FIT_PASSAGES, FIT_TASK = 1 << 16, 1 << 10
#: Characters of the items of one index, about: what is broadcast has a bound. Further items are searched in further scans.
BLOCK_CHARS = 1 << 25
#: Passages that are compared with the queries at once, and texts that are cut into words at once.
CHUNK, TEXTS = 1 << 11, 256
#: Rows of the sketch that travel together.
SKETCH_ROWS = 64

LEAK_SCHEMA = "doc_key string, heldout_key string, latent_cosine double, longest_run int, common_words int, common_share double, answer_found boolean"
SCAN_SCHEMA = "kind string, hash long, block int, part int, counts binary"


class Vocabulary:
    """Words of some items by number; other words have the number ``size``. A column stands for a word, or for several
    once there are more than ``FEATURES``."""

    def __init__(self, texts: list[list[str]]):
        self.number = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
        self.size = len(self.number)
        self.columns = min(self.size, FEATURES)

    def encode(self, texts: list[list[str]]) -> np.ndarray:
        get, other = self.number.get, self.size
        return np.fromiter((get(w, other) for t in texts for w in t), np.int64)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str], list[list[str]]]]:
    for batch in batches:
        for first in range(0, batch.num_rows, TEXTS):
            part = batch.slice(first, TEXTS)
            raw = part.column("text").to_pylist()
            yield part, raw, [words(t) for t in raw]


def _steps(lengths: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and text of each ``step`` words of the texts; the last of a text may be shorter."""
    per = -(-lengths // step)
    text = np.repeat(np.arange(len(lengths)), per)
    place = np.arange(len(text)) - np.repeat(np.cumsum(per) - per, per)
    return (np.cumsum(lengths) - lengths)[text] + place * step, text


def _scan(vocabulary, width: int):
    """Passages of ``width`` words: in how many each column occurs, how many there are, and a sample of them by hash.

    The sample of a task are the passages whose hash lies below a limit, halved whenever the sample gets too large.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary.value
        counts = np.zeros(voc.columns + 1, np.int64)
        held: dict[int, bytes] = {}
        limit = 1 << 63
        for _, _, texts in _texts(batches):
            flat = voc.encode(texts)
            start, _ = _steps(np.array([len(t) for t in texts], np.int64), width)
            if not len(start):
                continue
            passage = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(flat))))
            known = flat < voc.size
            column = flat[known] % max(voc.columns, 1)
            counts[:-1] += np.bincount(np.unique(passage[known] * (voc.columns + 1) + column) % (voc.columns + 1), minlength=voc.columns)[: voc.columns]
            counts[-1] += len(start)
            size = np.bincount(passage[known], minlength=len(start))
            begin = np.cumsum(size) - size
            for a, n in zip(begin.tolist(), size.tolist()):
                ids = column[a : a + n].astype(np.int32).tobytes()
                hashed = xxhash.xxh64_intdigest(ids) >> 1
                if n and hashed < limit:
                    held[hashed] = ids
            while len(held) > FIT_TASK:
                limit //= 2
                held = {h: i for h, i in held.items() if h < limit}
        rows = array_rows(np.zeros(1), [counts])
        yield pa.RecordBatch.from_arrays([pa.array(["counts"]), pa.array([0]), *rows.columns], names=["kind", "hash", *rows.schema.names])
        n = len(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(["sample"] * n + ["limit"]), pa.array([*held, limit - 1]), pa.array([0] * (n + 1), pa.int32()),
             pa.array([0] * (n + 1), pa.int32()), pa.array([*held.values(), b""], pa.binary())],
            names=["kind", "hash", *rows.schema.names],
        )

    return work


def randomised_svd(passages: DataFrame, idf: np.ndarray, rank: int) -> np.ndarray:
    """Right singular vectors (columns x ``rank``) of the normalised TF-IDF rows ``ids binary`` (32-bit columns each).

    Each task multiplies its rows with the sketch; the products are summed over the tasks by rows of the result, so the
    matrix itself is never in one place. Two power iterations sharpen the spectrum.
    """
    spark, size = passages.sparkSession, len(idf)
    width = min(rank + OVERSAMPLE, size)
    sketch = np.random.default_rng(7).standard_normal((size, width))
    values = np.zeros(0)
    for _ in range(3):
        sketch, _ = np.linalg.qr(sketch)
        shared = spark.sparkContext.broadcast((sketch.astype(np.float32), idf.astype(np.float32)))

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            right, weight = shared.value
            total = np.zeros((-(-size // SKETCH_ROWS) * SKETCH_ROWS, right.shape[1]))
            for batch in batches:
                raw = batch.column("ids").to_pylist()
                for first in range(0, len(raw), CHUNK):
                    part = raw[first : first + CHUNK]
                    ids = np.frombuffer(b"".join(part), np.int32)
                    row = np.repeat(np.arange(len(part)), [len(x) // 4 for x in part])
                    # Of equal entries of a row one stands for all, with their number.
                    cell, times = np.unique(row * size + ids, return_counts=True)
                    row, ids = cell // size, cell % size
                    value = times * weight[ids]
                    value /= np.maximum(np.sqrt(np.bincount(row, value**2, minlength=len(part))), 1e-9)[row]
                    head = np.flatnonzero(np.append(True, row[1:] != row[:-1])[: len(row)])
                    products = np.add.reduceat(right[ids] * value[:, None], head, axis=0)
                    by = np.argsort(ids, kind="stable")
                    head = np.flatnonzero(np.append(True, np.diff(ids[by]) > 0)[: len(ids)])
                    place = np.searchsorted(np.unique(row), row)
                    total[ids[by][head]] += np.add.reduceat(products[place[by]] * value[by][:, None], head, axis=0)
            blocks = total.reshape(-1, SKETCH_ROWS, right.shape[1])
            used = np.flatnonzero(blocks.any(axis=(1, 2)))
            yield array_rows(used, blocks[used])

        sketch = np.zeros((-(-size // SKETCH_ROWS) * SKETCH_ROWS, width))
        for block, product in total_arrays(passages.mapInArrow(work, "block int, part int, counts binary"), np.float64).items():
            sketch[block * SKETCH_ROWS : (block + 1) * SKETCH_ROWS] = product.reshape(SKETCH_ROWS, width)
        sketch = sketch[:size]
        shared.unpersist()
        # Columns are A'A q: their norms stand for squared singular values.
        sketch, values, _ = np.linalg.svd(sketch, full_matrices=False)
    keep = values > 1e-9 * max(float(values[0]) if len(values) else 0.0, 1e-300)
    return sketch[:, keep][:, :rank].astype(np.float32)


class LatentIndex:
    """The items' passages as queries in the latent space, with the words that decide about candidates."""

    def __init__(self, texts: list[list[str]], vocabulary: Vocabulary, idf: np.ndarray, space: np.ndarray, foreign: float, run: int):
        self.run, self.vocabulary, self.items = run, vocabulary, len(texts)
        column = np.arange(vocabulary.size) % max(vocabulary.columns, 1)
        self.space = (space * idf[:, None])[column].astype(np.float32)
        #: Squared length that a word adds to a passage outside the space: a foreign word all of its own.
        self.beside = np.append(np.zeros(vocabulary.size), foreign**2)
        self.texts = [np.array([vocabulary.number[w] for w in t], np.int64) for t in texts]
        self.length = np.array([len(t) for t in texts], np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.concatenate([*self.texts, np.zeros(run, np.int64)])
        #: Queries of the two searches: those of runs begin every half run and hold the runs that begin before the next.
        self.step = max(1, run // 2)
        self.run_item, self.run_start, self.runs = self._queries(run + self.step - 1, self.step, run)
        self.long_item, self.long_start, self.longs = self._queries(2 * run, run, 1)
        self.thresholds = np.ones(len(self.run_item), np.float32)
        end = (self.begin + self.length)[self.run_item]
        for k in range(self.step):
            inside = self.run_start + k + run <= end
            own = self.vectors(self.run_start[inside] + k, self.flat)
            size = np.linalg.norm(own, axis=1)
            near = np.einsum("ij,ij->i", own, self.runs[inside]) / np.maximum(size, 1e-12)
            self.thresholds[inside] = np.minimum(self.thresholds[inside], np.where(size > 0, near, -1))
        # A little less, for rounding.
        self.thresholds -= np.float32(1e-4)
        # Words of the items by item and word, and at which places they stand, for the subsequences.
        key = np.repeat(np.arange(self.items), self.length) * (vocabulary.size + 1) + self.flat[: int(self.length.sum())]
        place = np.arange(len(key)) - np.repeat(self.begin, self.length)
        self.mark_keys, which = np.unique(key, return_inverse=True)
        self.mark_bits = np.zeros((max(1, -(-int(self.length.max(initial=0)) // 64)), len(self.mark_keys) + 1), np.uint64)
        np.bitwise_or.at(self.mark_bits, (place // 64, which), np.uint64(1) << (place % 64).astype(np.uint64))

    def marks(self, item: np.ndarray, word: np.ndarray, lanes: int) -> np.ndarray:
        """The places of words in items, as bits."""
        key = item * (self.vocabulary.size + 1) + word
        at = np.searchsorted(self.mark_keys, key)
        at[at < len(self.mark_keys)] = np.where(
            self.mark_keys[at[at < len(self.mark_keys)]] == key[at < len(self.mark_keys)], at[at < len(self.mark_keys)], len(self.mark_keys)
        )
        return self.mark_bits[:lanes, at]

    def _queries(self, width: int, step: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Item, first word and unit vector of an item passage every ``step`` words, of those with ``least`` words."""
        start, item = _steps(self.length, step)
        end = (self.begin + self.length)[item]
        keep = start + least <= end
        if least == 1:
            keep &= (start == self.begin[item]) | (start + width - step < end)
        start, item, end = start[keep], item[keep], end[keep]
        vectors = np.zeros((len(start), self.space.shape[1]), np.float32)
        for k in range(width):
            inside = start + k < end
            vectors[inside] += self.space[self.flat[start[inside] + k]]
        return item, start, vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-12)

    def vectors(self, start: np.ndarray, flat: np.ndarray) -> np.ndarray:
        """Vectors of the runs of known words that begin at some places."""
        out = np.zeros((len(start), self.space.shape[1]), np.float32)
        for k in range(self.run):
            out += self.space[flat[start + k]]
        return out

    def near_runs(self, flat: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """First word and query of runs of known words that are as near to a query as its own runs."""
        if len(flat) < self.run or not len(self.run_item):
            return
        foreign = np.concatenate([[0], np.cumsum(flat == self.vocabulary.size)])
        ends = np.repeat(np.cumsum(lengths), lengths)[: len(flat) - self.run + 1]
        start = np.arange(len(ends))
        start = start[(start + self.run <= ends) & (foreign[self.run :] == foreign[: -self.run])]
        for first in range(0, len(start), CHUNK):
            at = start[first : first + CHUNK]
            own = self.vectors(at, flat)
            size = np.linalg.norm(own, axis=1)
            own /= np.maximum(size, 1e-12)[:, None]
            row, query = np.nonzero(own @ self.runs.T >= self.thresholds)
            yield at[row], query

    def same_run(self, flat: np.ndarray, at: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Whether the run is, word by word, one of the runs of the query."""
        hit = np.zeros(len(at), bool)
        end = (self.begin + self.length)[self.run_item[query]]
        for k in range(self.step):
            start = self.run_start[query] + k
            same = start + self.run <= end
            for j in range(self.run):
                left = np.flatnonzero(same)
                same[left] = flat[at[left] + j] == self.flat[np.minimum(start[left] + j, len(self.flat) - 1)]
            hit |= same
        return hit

    def near_passages(self, flat: np.ndarray, lengths: np.ndarray, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Text, first word, item and cosine of passages of two steps of ``run`` words above a cosine with an item."""
        start, text = _steps(lengths, self.run)
        if not len(start) or not len(self.long_item):
            return
        known = flat < self.vocabulary.size
        step = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(flat))))
        beside = np.bincount(step, self.beside[flat], minlength=len(start))
        size = np.bincount(step[known], minlength=len(start))
        begin = np.cumsum(size) - size
        ids = flat[known]
        joined = np.append(text[1:] == text[:-1], False)
        for first in range(0, len(start), CHUNK):
            last = min(first + CHUNK, len(start))
            stop = min(last + 1, len(start))
            some = ids[begin[first] : begin[stop - 1] + size[stop - 1]]
            sums = np.zeros((stop - first, self.space.shape[1]), np.float32)
            full = np.flatnonzero(size[first:stop])
            if len(full):
                sums[full] = np.add.reduceat(self.space[some], begin[first:stop][full] - begin[first], axis=0)
            own, other = sums[: last - first].copy(), beside[first:last].copy()
            both = np.flatnonzero(joined[first:last])
            own[both] += sums[both + 1]
            other[both] += beside[first:stop][both + 1]
            norm = np.sqrt(np.square(own).sum(axis=1) + other)
            live = np.flatnonzero(np.linalg.norm(own, axis=1) >= cosine * norm)
            likeness = own[live] @ self.longs.T / np.maximum(norm[live], 1e-12)[:, None]
            row, query = np.nonzero(likeness >= cosine)
            # Of several queries of an item the nearest counts.
            cell = live[row] * self.items + self.long_item[query]
            order = np.lexsort((-likeness[row, query], cell))
            head = order[np.append(True, np.diff(cell[order]) > 0)[: len(order)]]
            step_no = first + live[row[head]]
            yield text[step_no], start[step_no], self.long_item[query[head]], likeness[row[head], query[head]]


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, by bit parallel rows."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for x in b:
        match = row & where.get(x, 0)
        row = ((row + match) | (row - match)) & full
    return len(a) - row.bit_count()


def common_subsequences(ix: "LatentIndex", item: np.ndarray, flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of items and stretches of words, many at once by bit parallel rows.

    A row of bits stands for the words of an item; sums carry over from lane to lane of 64 bits.
    """
    lanes = max(1, -(-int(ix.length[item].max(initial=0)) // 64))
    ones = np.uint64(0xFFFFFFFFFFFFFFFF)
    row = np.full((lanes, len(item)), ones)
    for k in range(int((end - begin).max(initial=0))):
        live = np.flatnonzero(begin + k < end)
        marks = ix.marks(item[live], flat[begin[live] + k], lanes)
        carry = np.zeros(len(live), np.uint64)
        for lane in range(lanes):
            now = row[lane, live]
            both = now & marks[lane]
            total = now + both
            over = total < now
            total += carry
            over |= total < carry
            carry = over.astype(np.uint64)
            row[lane, live] = total | (now & ~marks[lane])
    out = np.zeros(len(item), np.int64)
    for lane in range(lanes):
        bits = np.clip(ix.length[item] - 64 * lane, 0, 64)
        used = np.where(bits == 64, ones, (np.uint64(1) << np.minimum(bits, 63).astype(np.uint64)) - np.uint64(1))
        out += np.bitwise_count(~row[lane] & used)
    return out


def longest_common_run(a: list[int], b: list[int], other: int) -> int:
    """Length of the longest run of words that stands in both; the word ``other`` matches nothing."""
    where: dict[int, list[int]] = defaultdict(list)
    for i, x in enumerate(a):
        where[x].append(i)
    best, last = 0, {}
    for x in b:
        now = {i: last.get(i - 1, 0) + 1 for i in where.get(x, ())} if x != other else {}
        best = max([best, *now.values()])
        last = now
    return best


def _item_blocks(heldout: DataFrame, heldout_id: str, prompt: str, *more: Column) -> Iterator[list]:
    """The items in blocks of about ``BLOCK_CHARS`` characters; a held-out table mostly is one block."""
    items = heldout.select(F.col(heldout_id).cast("string").alias("k"), F.col(prompt).alias("p"), *more)
    items = items.filter(F.col("k").isNotNull() & F.col("p").isNotNull()).distinct()
    chars = items.agg(F.coalesce(F.sum(F.length("p")), F.lit(0)).alias("chars")).first().chars
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for k in range(blocks):
        yield items.filter(F.pmod(F.xxhash64("k", "p"), F.lit(blocks)) == k).orderBy("k", "p").collect()


def _index(corpus: DataFrame, texts: list[list[str]], run: int) -> LatentIndex:
    """Document frequencies over all passages of the corpus, the space of a sample of them, and the items in it."""
    spark = corpus.sparkSession
    vocabulary = Vocabulary(texts)
    shared = spark.sparkContext.broadcast(vocabulary)
    scan = materialize(corpus.select("text").mapInArrow(_scan(shared, 2 * run), SCAN_SCHEMA), "passages")
    counts = total_arrays(scan.filter("kind = 'counts'").select("block", "part", "counts")).get(0)
    if counts is None or not counts[-1]:
        counts = np.ones(vocabulary.columns + 1, np.int64)
    idf = np.log((1.0 + counts[-1]) / (1.0 + counts[:-1])) + 1e-3
    limit = scan.filter("kind = 'limit'").agg(F.min("hash")).first()[0]
    wanted = min(limit if limit is not None else 0, int((1 << 63) * min(1.0, FIT_PASSAGES / max(int(counts[-1]), 1))) - 1)
    sample = scan.filter((F.col("kind") == "sample") & (F.col("hash") <= wanted)).select(F.col("counts").alias("ids"))
    space = randomised_svd(sample, idf, RANK) if vocabulary.size else np.zeros((0, 1), np.float32)
    if vocabulary.size and not space.shape[1]:
        space = np.zeros((vocabulary.columns, 1), np.float32)
    return LatentIndex(texts, vocabulary, idf, space, float(np.log(1.0 + counts[-1])), run)


def _documents(corpus: DataFrame, doc_id: str | Column, text: str | Column) -> DataFrame:
    column = lambda c: F.col(c) if isinstance(c, str) else c
    rows = corpus.select(column(doc_id).cast("string").alias("doc_key"), column(text).alias("text"))
    return rows.filter(F.col("text").isNotNull() & F.col("doc_key").isNotNull())


def _verbatim(ix: LatentIndex, flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Text, first word and item of all runs that stand in an item, and the candidates that were looked at."""
    out, looked = [(np.zeros(0, np.int64),) * 3], 0
    ends = np.cumsum(lengths)
    for at, query in ix.near_runs(flat, lengths):
        looked += len(at)
        hit = ix.same_run(flat, at, query)
        at, query = at[hit], query[hit]
        out.append((np.searchsorted(ends, at, "right"), at, ix.run_item[query]))
    return *(np.concatenate([x[k] for x in out]) for k in range(3)), looked


def leaked_passages(
    corpus: DataFrame,
    heldout: DataFrame,
    doc_id: str | Column = "doc_id",
    text: str | Column = "text",
    heldout_id: str = "heldout_id",
    prompt: str = "prompt",
    run: int = 12,
) -> DataFrame:
    """``doc_key, heldout_key``: the document has ``run`` consecutive words of the item's statement.

    The corpus is scanned twice, for the space and for the search, and never shuffled. Defined cases: null ids and texts
    take no part; a statement with fewer than ``run`` words is in no document; repeated rows give one pair; documents
    may be of any length; other columns are ignored.
    """
    rows = _documents(corpus, doc_id, text)
    found = None
    for block in _item_blocks(heldout, heldout_id, prompt):
        names = [r.k for r in block]
        index = rows.sparkSession.sparkContext.broadcast(_index(rows, [words(statement(r.p)) for r in block], run))

        def work(batches: Iterator[pa.RecordBatch], index=index, names=names) -> Iterator[pa.RecordBatch]:
            ix = index.value
            for part, _, texts in _texts(batches):
                flat, lengths = ix.vocabulary.encode(texts), np.array([len(t) for t in texts], np.int64)
                own, _, item, _ = _verbatim(ix, flat, lengths)
                pairs = np.unique(own * max(len(names), 1) + item)
                keys = part.column("doc_key").to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[i] for i in (pairs // max(len(names), 1)).tolist()], pa.string()),
                        pa.array([names[i] for i in (pairs % max(len(names), 1)).tolist()], pa.string()),
                    ],
                    names=["doc_key", "heldout_key"],
                )

        part = rows.mapInArrow(work, "doc_key string, heldout_key string")
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def answers_of(assertion: str | None) -> list[str]:
    """The expected values of assert lines."""
    return [x.strip() for x in re.findall(r"==\s*(.+)", assertion or "")]


def leak_report(
    corpus: DataFrame,
    heldout: DataFrame,
    doc_id: str | Column = "doc_id",
    text: str | Column = "text",
    heldout_id: str = "heldout_id",
    prompt: str = "prompt",
    entry_point: str = "entry_point",
    assertion: str = "assertion_text",
    run: int = 12,
    share: float = 0.5,
    cosine: float = 0.5,
) -> DataFrame:
    """Documents with a passage of an item, verbatim or reworded.

    A pair comes out when the document has ``run`` words of the item in a row, or a passage with a cosine of at least
    ``cosine`` whose surroundings hold, in order, at least ``share`` of the statement's words (longest common
    subsequence). Its figures are the largest of all its passages. ``answer_found`` tells whether the document names the
    item's function together with one of its expected values. Cases as in ``leaked_passages``.
    """
    rows = _documents(corpus, doc_id, text)
    found = None
    for block in _item_blocks(heldout, heldout_id, prompt, F.col(entry_point).alias("e"), F.col(assertion).alias("a")):
        facts = [(r.k, r.e, answers_of(r.a)) for r in block]
        index = rows.sparkSession.sparkContext.broadcast(_index(rows, [words(statement(r.p)) for r in block], run))

        def work(batches: Iterator[pa.RecordBatch], index=index, facts=facts) -> Iterator[pa.RecordBatch]:
            for part, raw, texts in _texts(batches):
                yield _report(index.value, facts, part, raw, texts, share, cosine)

        part = rows.mapInArrow(work, LEAK_SCHEMA)
        found = part if found is None else found.unionByName(part)
    return found.groupBy("doc_key", "heldout_key").agg(
        *[F.max(c).alias(c) for c in ("latent_cosine", "longest_run", "common_words", "common_share", "answer_found")]
    )


def _report(ix: LatentIndex, facts: list, part: pa.RecordBatch, raw: list[str], texts: list[list[str]], share: float, cosine: float) -> pa.RecordBatch:
    flat, lengths = ix.vocabulary.encode(texts), np.array([len(t) for t in texts], np.int64)
    ends = np.cumsum(lengths)
    own, at, item, _ = _verbatim(ix, flat, lengths)
    # Of the runs of a pair those that no run before overlaps: their surroundings hold the others.
    certain: dict[tuple[int, int], list[tuple[int, float]]] = defaultdict(list)
    for d, w, h in sorted(set(zip(own.tolist(), at.tolist(), item.tolist()))):
        if not certain[d, h] or w >= certain[d, h][-1][0] + ix.run:
            certain[d, h].append((w, 0.0))
    near = [np.concatenate(x) for x in zip(*ix.near_passages(flat, lengths, cosine))] or [np.zeros(0, np.int64)] * 4
    known = [(d, w, h, 0.0) for (d, h), places in certain.items() for w, _ in places]
    more = [np.array(x) for x in zip(*known)] or [np.zeros(0, np.int64)] * 4
    # Places of runs and passages, with the length of the item's longest subsequence around each.
    own, at, item, likeness = (np.concatenate([x, y]) for x, y in zip(near, more))
    own, at, item = own.astype(np.int64), at.astype(np.int64), item.astype(np.int64)
    begin = np.maximum(ends[own] - lengths[own], at - ix.length[item])
    end = np.minimum(ends[own], at + ix.length[item] + 2 * ix.run)
    common = np.zeros(len(own), np.int64)
    for first in range(0, len(own), 4 * CHUNK):
        part_of = slice(first, first + 4 * CHUNK)
        common[part_of] = common_subsequences(ix, item[part_of], flat, begin[part_of], end[part_of])
    verbatim = np.isin(own * ix.items + item, [d * ix.items + h for d, h in certain])
    keep = np.flatnonzero(verbatim | (common >= share * ix.length[item]))
    best: dict[tuple[int, int], tuple] = {}
    for i in keep.tolist():
        key = int(own[i]), int(item[i])
        length = longest_common_run(ix.texts[key[1]].tolist(), flat[begin[i] : end[i]].tolist(), ix.vocabulary.size)
        mine = float(likeness[i]), length, int(common[i])
        best[key] = tuple(map(max, best[key], mine)) if key in best else mine
    out = []
    for (d, h), (cosine_of, length, shared) in best.items():
        _, entry, answers = facts[h]
        answered = bool(entry) and entry in raw[d] and any(re.search(rf"(?<!\w){re.escape(a)}(?!\w)", raw[d]) for a in answers)
        size = int(ix.length[h])
        out.append((part.column("doc_key")[d].as_py(), facts[h][0], round(cosine_of, 6), length, shared, round(shared / size, 6), answered))
    columns = list(zip(*out)) or [()] * 7
    types = (pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_())
    names = [x.split(" ")[0] for x in LEAK_SCHEMA.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
