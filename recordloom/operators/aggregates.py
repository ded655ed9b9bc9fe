"""Aggregates and reports."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.numeric import rate
from recordloom.operators.ordering import with_position


def nearest_rank(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """count, min, max, mean, median and the 95th percentile by nearest rank; nulls are left out."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*group).agg(
        F.count("*").alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.median(value), 6).alias("median"),
        F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY `{value}`)").alias("p95"),
    )


def interpolated(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """count, min, max, median and the 95th percentile between neighbours; nulls are left out."""
    return rows.filter(F.col(value).isNotNull()).groupBy(*group).agg(
        F.count("*").alias("n"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
        F.round(F.percentile(value, F.lit(0.5)), 6).alias("median"),
        F.round(F.percentile(value, F.lit(0.95)), 6).alias("p95"),
    )


def surplus(rows: DataFrame, key: list[str]) -> DataFrame:
    """Rows beyond the first of each key: one row with the keys that repeat and the rows to spare."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).agg(
        F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).cast("long").alias("repeated_keys"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("surplus_rows"),
    )


def key_sums(rows: DataFrame, fields: Column) -> DataFrame:
    """Sum per key of a map column, of the values that are there."""
    return rows.select(F.explode(fields).alias("key", "value")).filter(F.col("value").isNotNull()).groupBy("key").agg(
        F.count("*").alias("n"), F.sum("value").cast("long").alias("total")
    )


def totals_and_groups(rows: DataFrame, group: str, measures: list[Column]) -> DataFrame:
    """One row per group and one (null group, ``is_total``) over all, in one pass."""
    return rows.rollup(group).agg(F.grouping(group).cast("int").alias("is_total"), *measures)


def pass_at(attempts: DataFrame, problem: str, number: str, passed: Column, most: int) -> DataFrame:
    """Per k up to ``most``: problems with a pass among their first k attempts, and their share of all problems."""
    earliest = attempts.groupBy(problem).agg(F.min(F.when(passed, F.col(number))).alias("first_pass"))
    ks = earliest.agg(
        F.count("*").alias("problems"),
        *[F.count(F.when(F.col("first_pass") <= k, 1)).alias(f"_{k}") for k in range(1, most + 1)],
    )
    pairs = F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"_{k}").alias("passed")) for k in range(1, most + 1)])
    return ks.select("problems", F.explode(pairs).alias("_p")).select(
        F.col("_p.k").alias("k"), "problems", F.col("_p.passed").alias("passed"),
        F.round(rate(F.col("_p.passed"), F.col("problems")), 6).alias("pass_rate"),
    )


def ordered_hash(rows: DataFrame, order: list[str], value: str) -> DataFrame:
    """SHA-256 of the values joined by line feeds, in order: one row ``n, sha256``.

    The hash is serial by definition. Sort and encoding are distributed; one task then streams over the encoded blocks in
    order and keeps none of them. A null value is the text ``null`` in angle brackets, which an empty value is not.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, batch in enumerate(batches):
            values = [("<null>" if x is None else x).encode() for x in batch.column("v").to_pylist()]
            if values:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([TaskContext.get().partitionId()]), pa.array([k]), pa.array([len(values)]), pa.array([b"\n".join(values)])],
                    names=["part", "block", "n", "bytes"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole, n = hashlib.sha256(), 0
        for batch in batches:
            for size, block in zip(batch.column("n").to_pylist(), batch.column("bytes").to_pylist()):
                whole.update((b"\n" if n else b"") + block)
                n += size
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([whole.hexdigest()])], names=["n", "sha256"])

    values = rows.orderBy(*order).select(F.col(value).cast("string").alias("v"))
    blocks = values.mapInArrow(encode, "part long, block long, n long, bytes binary")
    return blocks.repartition(1).sortWithinPartitions("part", "block").mapInArrow(run, "n long, sha256 string")


def steps_report(logs: DataFrame, run: str, step: str, epoch: Column, value: str, edge: int = 5) -> DataFrame:
    """Per run and epoch (rounded up, at least 1): steps, mean, and whether the run's steps are 1 to n."""
    spread = logs.groupBy(run).agg(
        ((F.min(step) == 1) & (F.max(step) == F.count("*")) & (F.countDistinct(step) == F.count("*"))).alias("contiguous"),
        F.max(step).alias("_last"),
    )
    joined = logs.join(spread, run)
    return joined.groupBy(run, F.greatest(F.lit(1), F.ceil(epoch - 1e-9)).cast("int").alias("epoch")).agg(
        F.count("*").alias("steps"),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(F.avg(F.when(F.col(step) <= edge, F.col(value))), 6).alias("mean_of_first"),
        F.round(F.avg(F.when(F.col(step) > F.col("_last") - edge, F.col(value))), 6).alias("mean_of_last"),
        F.first("contiguous").alias("contiguous"),
    )


def weighted_cost(amounts: list[tuple[Column, float]], per: float = 1e6) -> Column:
    """Cost of amounts by their rates, for ``per`` units each."""
    return sum((amount.cast("double") * rate for amount, rate in amounts), F.lit(0.0)) / per


def gates(rows: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """One row with the outcome of each condition over all rows, an aggregate each, and whether all hold."""
    found = rows.agg(*[F.coalesce(c, F.lit(False)).alias(n) for n, c in conditions.items()])
    return found.withColumn("all_hold", sum((F.col(n).cast("int") for n in conditions), F.lit(0)) == len(conditions))


def most_common(rows: DataFrame, value: str, seen: str) -> DataFrame:
    """Values by number of rows, most first; of equal numbers the one seen first."""
    counted = rows.groupBy(value).agg(F.count("*").alias("n"), F.min(seen).alias("first_seen"))
    return with_position(counted, [F.desc("n"), "first_seen", value]).select(value, "n", (F.col("position") + 1).alias("place"))
