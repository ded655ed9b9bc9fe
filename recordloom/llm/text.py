"""Words, statements and vectorised hashing shared by the operators on text."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"\w+")
#: The marks that may enclose the statement of a held-out item.
TRIPLE_QUOTES = ('"""', "'''")


def words(text: str | None) -> list[str]:
    """Runs of letters, digits and underscores of the text in NFKC form and case-folded; none for null."""
    if not text:
        return []
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return WORD.findall(text.casefold())


def statement(prompt: str | None) -> str:
    """What stands inside the first pair of triple quotes (all of it when there is none), without assert lines."""
    if not prompt:
        return ""
    starts = [(at, q) for q in TRIPLE_QUOTES if (at := prompt.find(q)) >= 0 and prompt.find(q, at + 3) >= 0]
    if starts:
        at, quote = min(starts)
        prompt = prompt[at + 3 : prompt.find(quote, at + 3)]
    return "\n".join(line for line in prompt.split("\n") if not line.startswith("assert "))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values, in place of a cryptographic hash."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All characters of the texts behind each other, and the offset at which each text starts (and the end)."""
    data = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return data, offsets


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
_BASE = 0x9E3779B97F4A7C15 | 1


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, int(n).bit_length())
    if size not in _POWERS:
        _POWERS.clear()
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


class RollingHash:
    """Hashes of all stretches of a sequence of 64-bit values, each from two prefix values (arithmetic modulo 2**64)."""

    def __init__(self, values: np.ndarray, lane: int = 0):
        """Hashes of different lanes are independent of each other."""
        mixed = mix(values.astype(np.uint64) + np.uint64((0x632BE59BD9B4E019 * (2 * lane + 1)) % (1 << 64)))
        self._up, down = _powers(len(values) + 1)
        self._sum = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(mixed * down[: len(values)], out=self._sum[1:])

    def of(self, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
        first = start if isinstance(start, np.ndarray) else np.arange(start.start or 0, start.stop)
        # The power that aligns the stretch to its start.
        return mix((self._sum[end] - self._sum[start]) * self._up[first])


def sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    """``pick`` (np.minimum or np.maximum) of every ``width`` neighbouring values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = pick(out[: len(out) - have], out[have:])
        have *= 2
    if have < width:
        out = pick(out[: len(out) - (width - have)], out[width - have :])
    return out


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, count values each, behind each other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    step = np.ones(total, np.int64)
    keep = counts > 0
    starts, counts = starts[keep], counts[keep]
    step[0] = starts[0]
    at = np.cumsum(counts)[:-1]
    step[at] = starts[1:] - (starts[:-1] + counts[:-1] - 1)
    return np.cumsum(step)


def rows_of(batch: pa.RecordBatch, *names: str) -> list[list]:
    """Columns of an Arrow batch as Python lists."""
    return [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names]


#: Counters of one row, when arrays of counters travel.
COUNTER_BLOCK = 4096
COUNTER_SCHEMA = "block int, part int, counts binary"


def counter_rows(counts: np.ndarray) -> pa.RecordBatch:
    """The blocks of an array of counters that are not all zero, as an Arrow batch of ``COUNTER_SCHEMA``."""
    blocks = counts.astype(np.int64).reshape(-1, COUNTER_BLOCK)
    used = np.flatnonzero(blocks.any(axis=1))
    return array_rows(used, blocks[used])


def array_rows(keys: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """One row for each key with the array that stands for it in this task, as an Arrow batch of ``COUNTER_SCHEMA``."""
    context = TaskContext.get()
    part = context.partitionId() % 64 if context else 0
    return pa.RecordBatch.from_arrays(
        [
            pa.array(keys.astype(np.int32)),
            pa.array(np.full(len(keys), part, np.int32)),
            pa.array([v.tobytes() for v in values], pa.binary()),
        ],
        names=["block", "part", "counts"],
    )


def _summed(dtype):
    """Adds arrays of equal keys as they stream by: a task holds one array a key, however many tasks sent one."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for block, part, counts in zip(*rows_of(batch, "block", "part", "counts")):
                values = np.frombuffer(counts, dtype)
                if (block, part) in total:
                    total[block, part] += values
                else:
                    total[block, part] = values.copy()
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in total], pa.int32()),
                pa.array([k[1] for k in total], pa.int32()),
                pa.array([v.tobytes() for v in total.values()], pa.binary()),
            ],
            names=["block", "part", "counts"],
        )

    return work


def total_arrays(rows: DataFrame, dtype=np.int64) -> dict[int, np.ndarray]:
    """Sum of the arrays of each block over all tasks, in two steps so that no task reads what all tasks sent of a block.

    What comes back has the size of the arrays, whatever the data.
    """
    halves = rows.repartition("block", "part").mapInArrow(_summed(dtype), COUNTER_SCHEMA)
    whole = halves.select("block", F.lit(0).alias("part"), "counts").repartition("block").mapInArrow(_summed(dtype), COUNTER_SCHEMA)
    return {r.block: np.frombuffer(r.counts, dtype) for r in whole.collect()}


def total_counts(rows: DataFrame, size: int) -> np.ndarray:
    """Sum of the counters of all tasks, of a fixed size."""
    total = np.zeros(size, np.int64)
    for block, counts in total_arrays(rows).items():
        total[block * COUNTER_BLOCK : (block + 1) * COUNTER_BLOCK] = counts
    return total
