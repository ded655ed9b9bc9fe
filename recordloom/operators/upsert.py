"""Exactly one copy of messages that were delivered at least once.

The store is a table of hash buckets: an upsert collapses equal identifiers in memory, task by task, and writes a sorted
run of one file per bucket; a compaction merges the sorted runs of each bucket so that equal identifiers collapse to one
row. Both keep a log of what they collapsed. Which copy wins is decided by an order that is total, so upserts may be
repeated, reordered, split or restarted without changing the result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from recordloom.session import file_system, new_table_path

#: Rows that a task holds in memory before it hands on the winners among them.
MEMTABLE = 1 << 18
#: Runs among which the batches of one upsert are dealt by hash: a flush covers many small batches.
RUNS = 4


def strip(column: Column | str) -> Column:
    """The text without white space of any kind around it."""
    c = F.col(column) if isinstance(column, str) else column
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _differs(table: pa.Table, names: list[str]) -> pa.Array:
    """For each row but the first, whether any of the columns differs from the row before."""
    out = None
    for name in names:
        column = table.column(name).combine_chunks()
        now, before = column[1:], column[:-1]
        same = pc.or_(pc.fill_null(pc.equal(now, before), False), pc.and_(pc.is_null(now), pc.is_null(before)))
        out = pc.invert(same) if out is None else pc.or_(out, pc.invert(same))
    return out


def _memtable(order: list[str]):
    """Mark the rows that another row of the same run and key beats; rows that repeat another one are left out."""

    def flush(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        if not table.num_rows:
            return
        keys = [(c, "ascending") for c in ("run", "k", *order)]
        table = table.take(pc.sort_indices(table, sort_keys=keys, null_placement="at_start"))
        first = pa.concat_arrays([pa.array([True]), _differs(table, ["run", "k"])])
        fresh = pa.concat_arrays([pa.array([True]), _differs(table, ["run", "k", *order])])
        table = table.append_column("lost", pc.invert(first)).filter(fresh)
        yield from table.combine_chunks().to_batches()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= MEMTABLE:
                yield from flush(held)
                held, size = [], 0
        if held:
            yield from flush(held)

    return work


class BucketedStore:
    """Rows by identifier in ``buckets`` hash buckets, as sorted runs under ``path``.

    Only the key, the columns of the winning order and ``payload`` are stored. The row whose ``order`` columns are
    smallest wins (null sorts first). Rows without a key are not upserted; callers keep them as they are. A store is
    opened again, after a restart or elsewhere, by naming its path and columns: its runs are those found on storage.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: list[str], payload: list[str], buckets: int):
        self.spark, self.path, self.key, self.order, self.payload = spark, path, key, order, payload
        self.buckets = buckets
        rest = [c for c in dict.fromkeys([*order, *payload]) if c != key]
        #: Names in storage, so that no column of a caller clashes with those of the store.
        self._stored = {key: "k"} | {c: f"c{i}" for i, c in enumerate(rest)}
        self._sorted = [self._stored[c] for c in order if c != key]
        self._table = f"store_{uuid.uuid4().hex}"
        self._known = False
        fs, target = file_system(spark, f"{path}/runs")
        if fs.exists(target):
            self._create(spark.read.parquet(f"{path}/runs").drop("run").schema)

    @property
    def runs(self) -> list[str]:
        """Names of the runs on storage."""
        fs, target = file_system(self.spark, f"{self.path}/runs")
        if not fs.exists(target):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(target)]
        return sorted(n.removeprefix("run=") for n in names if n.startswith("run="))

    def _create(self, schema) -> None:
        """Name the runs on storage as a bucketed table of this session, so that plans know where an identifier lies."""
        columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema)
        by = ", ".join(["k", *self._sorted])
        self.spark.sql(
            f"CREATE TABLE {self._table} ({columns}, run STRING) USING parquet PARTITIONED BY (run) "
            f"CLUSTERED BY (k) SORTED BY ({by}) INTO {self.buckets} BUCKETS LOCATION '{self.path}/runs'"
        )
        if self.runs:
            self.spark.catalog.recoverPartitions(self._table)
        self._known = True

    def upsert(self, rows: DataFrame, run: str | Column) -> None:
        """Write ``rows`` as the sorted run ``run``, or as several by a column; writing a run again replaces it.

        A task collapses what it holds before the exchange, so an identifier with a third of all rows leaves it as a few.
        """
        name = F.lit(run) if isinstance(run, str) else run.cast("string")
        picked = rows.select(*[F.col(c).alias(s) for c, s in self._stored.items()], name.alias("run"))
        picked = picked.filter(F.col("k").isNotNull())
        if not self._known:
            self._create(picked.drop("run").schema)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in picked.schema)
        # What a task held, winners and losers, is logged first; the runs are made from the log.
        log = f"{self.path}/log/upsert={run if isinstance(run, str) else uuid.uuid4().hex}"
        marked = picked.mapInArrow(_memtable(self._sorted), schema + ", lost boolean")
        marked.write.mode("overwrite").partitionBy("lost").parquet(log)
        kept = self.spark.read.schema(marked.schema).parquet(log).filter("not lost").select(*picked.columns)
        # One task per bucket, and so one sorted file per bucket and run.
        again = set(self.runs)
        if again:
            names = [run] if isinstance(run, str) else [r.run for r in kept.select("run").distinct().collect()]
            self._drop([r for r in names if r in again])
        kept = kept.repartition(self.buckets, "k").sortWithinPartitions("run", "k", *self._sorted)
        kept.write.insertInto(self._table)

    def _drop(self, runs: list[str]) -> None:
        for run in runs:
            self.spark.sql(f"ALTER TABLE {self._table} DROP IF EXISTS PARTITION (run = '{run}')")
            fs, target = file_system(self.spark, f"{self.path}/runs/run={run}")
            fs.delete(target, True)

    def _merged(self) -> DataFrame:
        """Rows of all runs by place among the copies of their identifier. The table's buckets make an exchange needless:
        each task sorts the sorted files of its bucket into one another."""
        if not self._known or not self.runs:
            raise ValueError("nothing was upserted")
        by = Window.partitionBy("k").orderBy(*[F.col(c).asc_nulls_first() for c in self._sorted])
        # Copies of the winner itself, from a run that was upserted twice, are no other rows.
        same = F.lit(True)
        for c in self._sorted:
            same &= F.col(c).eqNullSafe(F.first(c).over(by))
        return self.spark.table(self._table).withColumn("place", F.row_number().over(by)).withColumn("same", same)

    def compact(self, run: str = "merged") -> None:
        """Merge all runs into one, in which every identifier occurs once.

        The merged run is complete before the others go, and a store with both gives the same rows.
        """
        old = self.runs
        if run in old:
            raise ValueError(f"run {run!r} is among those to be merged")
        merged = self._merged()
        lost = merged.filter("place > 1 AND NOT same").drop("place", "same", "run")
        lost.write.mode("overwrite").parquet(f"{self.path}/collapsed/run={run}")
        kept = merged.filter("place = 1").drop("place", "same").withColumn("run", F.lit(run))
        kept.write.insertInto(self._table)
        self._drop(old)

    def _named(self, rows: DataFrame) -> DataFrame:
        return rows.select(*[F.col(s).alias(c) for c, s in self._stored.items()])

    def rows(self) -> DataFrame:
        """The winner of every identifier, whether or not the runs were compacted."""
        return self._named(self._merged().filter("place = 1"))

    def collapsed(self) -> DataFrame:
        """Rows that gave way to another of their identifier so far, in memory or in a compaction; some more than once."""
        types = self.spark.table(self._table).drop("run").schema
        log = self.spark.read.schema(StructType([*types, StructField("lost", BooleanType())])).parquet(f"{self.path}/log")
        lost = log.filter("lost").select(*types.names)
        fs, target = file_system(self.spark, f"{self.path}/collapsed")
        if fs.exists(target):
            lost = lost.unionByName(self.spark.read.schema(types).parquet(f"{self.path}/collapsed").select(*types.names))
        return self._named(lost)


def rank_deliveries(deliveries: DataFrame, payload: list[str] | None = None) -> DataFrame:
    """Key and winning order of deliveries: ``delivery_key``, ``not_ok``, ``received_at``, ``delivery_no``, and ``payload``."""
    status = F.lower(strip("status"))
    return deliveries.select(
        strip("id").alias("delivery_key"),
        F.when(status == "ok", 0).otherwise(1).alias("not_ok"),
        "received_at",
        "delivery_no",
        *(payload or []),
    )


def delivery_store(deliveries: DataFrame, payload: list[str] | None = None, buckets: int | None = None) -> BucketedStore:
    """The deliveries upserted by batch and compacted: every batch belongs to one of ``RUNS`` runs."""
    spark = deliveries.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["not_ok", "received_at", "delivery_no"]
    batch = F.col("batch_id") if "batch_id" in deliveries.columns else F.lit(None)
    # A column of the caller's may have the name of one of the order; it travels under another name.
    ranked = rank_deliveries(deliveries.withColumn("_batch_run", F.pmod(F.xxhash64(batch), F.lit(RUNS))), [*(payload or []), "_batch_run"])
    store = BucketedStore(spark, new_table_path(spark, "deliveries"), "delivery_key", order, payload or [], buckets)
    store.upsert(ranked, F.concat(F.lit("batches-"), F.col("_batch_run")))
    store.compact()
    return store


def surplus_deliveries(deliveries: DataFrame, buckets: int | None = None) -> DataFrame:
    """``delivery_no`` of every delivery but the kept one of its attempt: what upserts and compaction collapsed.

    Deliveries are of one attempt when their ``id`` is equal without the white space around it. Kept is one with status
    ok (white space around it and case ignored) if there is any, among these the first by ``received_at``, then the
    lowest ``delivery_no``. Defined cases: a null ``id`` belongs to no attempt and is never surplus; an ``id`` of white
    space only is the attempt with the empty ``id``; a null status is not ok; a null ``received_at`` comes first; rows
    that repeat another one are one delivery; an empty table gives an empty result; other columns are ignored.
    """
    if deliveries.filter(F.col("id").isNotNull()).isEmpty():
        return deliveries.select("delivery_no").limit(0)
    return delivery_store(deliveries, None, buckets).collapsed().select("delivery_no").distinct()


def kept_deliveries(deliveries: DataFrame, payload: list[str] | None = None, buckets: int | None = None) -> DataFrame:
    """The kept delivery of every attempt: key, winning order and ``payload`` columns. Cases as in ``surplus_deliveries``."""
    if deliveries.filter(F.col("id").isNotNull()).isEmpty():
        return rank_deliveries(deliveries, payload).limit(0)
    return delivery_store(deliveries, payload, buckets).rows()
