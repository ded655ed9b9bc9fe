"""Durable queues as streams: raw records to normal records or errors, then to verdicts.

The file source takes a file as it is when it is first seen, so records land in whole new files (written beside, then
renamed), never by appending. Every query runs over what is there and stops (``availableNow``), and goes on from its
checkpoint when it is started again.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery

from recordloom.operators.records import RAW, normalise, split_errors


def land(records: list[dict], folder: str) -> str:
    """Put records into a queue folder as one new file."""
    os.makedirs(folder, exist_ok=True)
    target = os.path.join(folder, f"{uuid.uuid4().hex}.json")
    beside = os.path.join(folder, f".{os.path.basename(target)}.part")
    with open(beside, "w", encoding="utf-8") as f:
        f.writelines(json.dumps(r, ensure_ascii=False) + "\n" for r in records)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, target)
    return target


def stream(spark: SparkSession, folder: str, schema: T.StructType | str, files_at_once: int = 64) -> DataFrame:
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once)
    return reader.json(folder)


def run_batches(rows: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hand each micro-batch to ``work`` until nothing is left; ``work`` must give the same result when repeated."""
    query = rows.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def normalise_stream(spark: SparkSession, raw: str, normal: str, errors: str, checkpoint: str) -> StreamingQuery:
    """Raw queue to normal records and errors. A batch writes to folders of its number, so a repeat replaces itself."""

    def work(batch: DataFrame, number: int) -> None:
        once = normalise(batch).persist()
        good, bad = split_errors(once)
        good.write.mode("overwrite").parquet(f"{normal}/batch={number}")
        bad.write.mode("overwrite").parquet(f"{errors}/batch={number}")
        once.unpersist()

    return run_batches(stream(spark, raw, RAW), work, checkpoint)


def distinct_stream(spark: SparkSession, folder: str, schema: T.StructType | str, key: str, out: str, checkpoint: str, late: tuple[str, str] | None = None) -> StreamingQuery:
    """Each key once, across batches and restarts. With ``late`` (time column, delay) keys are forgotten after the delay,
    which bounds the state; without it the state holds every key."""
    rows = stream(spark, folder, schema)
    if late:
        rows = rows.withWatermark(*late).dropDuplicatesWithinWatermark([key])
    else:
        rows = rows.dropDuplicates([key])
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """Keys that a queue holds more than once: for queues where a repeat is an error."""
    return rows.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def lags(raw: DataFrame, normal: DataFrame, errors: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: ids that wait between the queues."""
    ids = lambda df: df.select("id").distinct()
    ok = ids(raw.filter(F.lower(F.trim("status")) == "ok"))
    left = lambda a, b: a.join(b, "id", "left_anti").agg(F.count("*").alias("n"))
    a = left(ok, ids(normal).union(ids(errors))).withColumnRenamed("n", "raw_to_normal")
    b = left(ids(normal), ids(verdicts)).withColumnRenamed("n", "normal_to_verdict")
    return a.crossJoin(b)  # one row each


class StateReport(StreamingQueryListener):
    """Writes the progress of queries to a file that is always whole."""

    def __init__(self, path: str):
        self.path, self.state = path, {"batches": 0, "rows": 0, "ended": 0, "errors": []}

    def _write(self) -> None:
        # Replaced in one step: a reader finds the last state or this one.
        with open(self.path + ".part", "w", encoding="utf-8") as f:
            f.write(json.dumps(self.state, sort_keys=True, ensure_ascii=False, indent=1) + "\n")
            f.flush()
            os.fsync(f.fileno())
        os.replace(self.path + ".part", self.path)

    def onQueryStarted(self, event) -> None:
        self._write()

    def onQueryProgress(self, event) -> None:
        self.state["batches"] += 1
        self.state["rows"] += event.progress.numInputRows
        self._write()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.state["ended"] += 1
        if event.exception:
            self.state["errors"].append(str(event.exception).split("\n")[0][:500])
        self._write()


def finished(raw: DataFrame, normal: DataFrame, errors: DataFrame, verdicts: DataFrame) -> bool:
    """Whether nothing waits in any queue."""
    r = lags(raw, normal, errors, verdicts).first()
    return r.raw_to_normal == 0 and r.normal_to_verdict == 0
