"""Items of varying length put into containers of fixed capacity, with little room left over.

Sum-of-squares packing: an item goes where the sum, over all gaps, of the squared number of open containers with that
gap becomes smallest. The rule looks at one item after the other, so it runs in shards of bounded size; the containers
of all shards are numbered through. What lies in containers that are not full at the end of a shard is packed anew,
largest first and each where the least room remains, if that needs fewer of them. Items larger than a container fill containers of their own, and their rest is an
item as any other.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recordloom.session import materialize

#: Items that one shard packs, about.
SHARD_ITEMS = 50_000


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number (from 0) of each item, in the order given; no size exceeds the capacity.

    Ties go to the smallest gap that remains. Items of size 0 take no room: they go to the container opened last.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]  # by gap
    number = np.zeros(capacity + 1, np.int64)  # how many are open, by gap; gap 0 is closed
    out = np.zeros(len(sizes), np.int64)
    made = 0
    for i, size in enumerate(sizes.tolist()):
        if size == 0:
            if not made:
                open_bins[capacity].append(made)
                number[capacity] += 1
                made = 1
            out[i] = made - 1
            continue
        # Moving a container from gap g to gap g - size changes the sum by 2 * (n[g - size] - n[g]) + 2; a full one
        # leaves the sum.
        gaps = number[size:]
        change = 2 * (number[: len(gaps)] - gaps) + 2
        change[0] = 1 - 2 * gaps[0]
        change[gaps == 0] = np.iinfo(np.int64).max
        best = int(change.argmin())
        fresh = 2 * number[capacity - size] + 1 if size < capacity else 0
        if gaps[best] == 0 or fresh < change[best]:
            container, gap = made, capacity - size
            made += 1
        else:
            gap = best
            container = open_bins[best + size].pop()
            number[best + size] -= 1
        out[i] = container
        if gap:
            open_bins[gap].append(container)
            number[gap] += 1
    return out


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item, largest items first, each where the least room remains."""
    gaps: list[tuple[int, int]] = []
    out = np.zeros(len(sizes), np.int64)
    made = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect.bisect_left(gaps, (size, -1))
        if at < len(gaps):
            gap, container = gaps.pop(at)
        else:
            gap, container = capacity, made
            made += 1
        out[i] = container
        if gap > size:
            bisect.insort(gaps, (gap - size, container))
    return out


def pack_shard(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number (from 0) of each item of a shard: sum of squares, then a second packing of what is not full."""
    numbers = sum_of_squares(sizes, capacity)
    fill = np.bincount(numbers, sizes, minlength=1).astype(np.int64)
    loose = np.flatnonzero(fill[numbers] < capacity) if len(sizes) else np.zeros(0, np.int64)
    anew = best_fit(sizes[loose], capacity)
    used = np.unique(numbers[loose])
    # Items of size 0 fit anywhere, so they never open a container of their own here.
    if len(loose) and anew.max() + 1 < len(used):
        numbers[loose] = used[anew]
        numbers = np.unique(numbers, return_inverse=True)[1]
    return numbers


def pack(items: DataFrame, item_id: str, size: str | Column, capacity: int, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """``item_id, container, piece, tokens``: where each item goes; pieces of an item are numbered from 0.

    An item is split only if it exceeds the capacity: its full pieces get containers of their own and its rest is
    packed. Rows are dealt to shards by hash of the id, so shards are of even size whatever the sizes or sources are.
    Defined cases: a null or negative size counts as 0, and items of size 0 still get a container; a null id is an id
    like any other; a repeated id is packed as often as it occurs; no row gives no row; other columns are ignored.
    """
    column = F.col(size) if isinstance(size, str) else size
    rows = items.select(F.col(item_id).alias("item_id"), F.greatest(F.coalesce(column, F.lit(0)), F.lit(0)).cast("long").alias("size"))
    rows = materialize(rows, "item-sizes")
    shards = max(1, -(-rows.count() // shard_items))
    dealt = rows.withColumn("_shard", F.pmod(F.xxhash64("item_id", "size"), F.lit(shards)).cast("int"))
    full = F.floor(F.col("size") / capacity)
    # An exact multiple of the capacity has no rest.
    dealt = dealt.withColumn("full", full.cast("long")).withColumn("rest", F.col("size") - full * capacity)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rest", "item_id"], ascending=[False, True], kind="stable", ignore_index=True)
        whole = (pdf["rest"] == 0) & (pdf["full"] > 0)
        packed = pdf[~whole]
        numbers = pack_shard(packed["rest"].to_numpy(), capacity)
        first = int(numbers.max()) + 1 if len(numbers) else 0
        big = pdf[pdf["full"] > 0]
        times = big["full"].to_numpy()
        pieces = pd.DataFrame(
            {
                "item_id": np.repeat(big["item_id"].to_numpy(), times),
                "local": first + np.arange(int(times.sum())),
                "piece": np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times),
                "tokens": capacity,
            }
        )
        rest = pd.DataFrame({"item_id": packed["item_id"], "local": numbers, "piece": packed["full"], "tokens": packed["rest"]})
        out = pd.concat([rest, pieces], ignore_index=True)
        out["_shard"] = pdf["_shard"].iloc[0]
        return out

    kind = rows.schema["item_id"].dataType.simpleString()
    schema = f"item_id {kind}, local long, piece long, tokens long, _shard int"
    local = materialize(dealt.groupBy("_shard").applyInPandas(work, schema), "packed")
    # One row per shard: the containers before it.
    sizes = local.groupBy("_shard").agg((F.max("local") + 1).alias("made"))
    before = F.sum("made").over(Window.orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_shard", F.coalesce(before, F.lit(0)).alias("start"))
    return local.join(starts, "_shard").select(
        F.col("item_id").alias(item_id), (F.col("start") + F.col("local")).alias("container"), "piece", "tokens"
    )
