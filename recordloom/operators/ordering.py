"""Positions in a total order, and what is selected by them, without a sort in one task."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.session import materialize

_SHIFT = 33  # monotonically_increasing_id keeps the partition in the bits above


def with_position(rows: DataFrame, order: list[Column | str], name: str = "position") -> DataFrame:
    """``rows`` with their place (from 0) in the order, which must be total.

    The rows are range partitioned and sorted in each partition; only the sizes of the partitions meet in one place, and
    these are as many as shuffle partitions.
    """
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    local = rows.repartitionByRange(width, *keys).sortWithinPartitions(*keys)
    local = materialize_sorted(local.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", _SHIFT)
    sizes = sorted((r.p, r["count"]) for r in local.groupBy(part.alias("p")).count().collect())
    starts, total = {}, 0
    for p, n in sizes:
        starts[p] = total
        total += n
    if not starts:
        return local.withColumn(name, F.lit(0).cast("long")).drop("_at")
    table = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
    local_at = F.col("_at").bitwiseAND((1 << _SHIFT) - 1)
    return local.withColumn(name, F.try_element_at(table, part) + local_at).drop("_at")


def materialize_sorted(rows: DataFrame) -> DataFrame:
    """Write the numbered rows once: a lost executor must not number them anew."""
    return materialize(rows, "ordered")


def with_place(rows: DataFrame, group: str, order: list[str], name: str = "place") -> DataFrame:
    """Place (from 0) of each row in its group; a group may hold any share of the rows.

    The place is the position in the order of (group, order) less that of the group's first row.
    """
    numbered = with_position(rows, [group, *order], "_position")
    first = numbered.groupBy(group).agg(F.min("_position").alias("_first"))
    joined = numbered.join(first.withColumnRenamed(group, "_group"), F.col(group).eqNullSafe(F.col("_group")))
    return joined.withColumn(name, F.col("_position") - F.col("_first")).drop("_group", "_position", "_first")


def interleaved(rows: DataFrame, source: str, order: list[str], name: str = "position") -> DataFrame:
    """Round robin over the sources, in the order of their first rows; the order in each source is kept."""
    placed = with_place(rows, source, order, "_round")
    key = F.struct(*order)
    firsts = placed.filter("_round = 0").select(F.col(source).alias("_source"), key.alias("_lead"))
    joined = placed.join(firsts, F.col(source).eqNullSafe(F.col("_source"))).drop("_source")
    return with_position(joined, ["_round", "_lead"], name).drop("_round", "_lead")


def hash_rank(seed: int, key: Column | str) -> Column:
    """A rank that depends on the seed and the key only."""
    c = F.col(key) if isinstance(key, str) else key
    return F.sha2(F.concat(F.lit(f"{seed}\u0000"), c.cast("string")), 256)


def hash_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The n rows of smallest rank: each task keeps n of its own, and n of these are taken."""
    return rows.withColumn("selection_rank", hash_rank(seed, key)).orderBy("selection_rank", key).limit(n)


def seeded_sample(rows: DataFrame, order: list[str], n: int, seed: int) -> DataFrame:
    """The rows at the positions that Python's ``random.Random(seed).sample`` draws, in the order drawn.

    The draw needs the number of rows and n, which bound what the driver holds.
    """
    numbered = with_position(rows, order, "_position")
    total = numbered.count()
    if n > total:
        raise ValueError(f"{n} rows asked for, {total} there")
    drawn = list(enumerate(random.Random(seed).sample(range(total), n)))
    table = rows.sparkSession.createDataFrame(drawn, "draw int, _position long")
    return numbered.join(table, "_position").drop("_position")


def batches(position: Column, first: int, size: int) -> Column:
    """Number (from 1) of the contiguous batch of a position; the first batch has its own size."""
    rest = F.floor((position - first) / size) + 2
    return F.when(position < first, F.lit(1)).otherwise(rest).cast("long")


def shard(position: Column, size: int) -> Column:
    return F.floor(position / size).cast("long")


def first_rows(rows: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first n rows of an order."""
    return rows.orderBy(*order).limit(n)


def target_and_reserve(rows: DataFrame, order: list[str], target: int) -> DataFrame:
    """Column ``part``: target for the first rows of the order, reserve for the others."""
    numbered = with_position(rows, order)
    return numbered.withColumn("part", F.when(F.col("position") < target, "target").otherwise("reserve"))
