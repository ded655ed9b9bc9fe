"""Queries that run a stream over all that is there, and return what it left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.upsert import strip
from recordloom.plans.deliveries import _RANKED
from recordloom.session import new_table_path, read_table
from recordloom.streaming.pipeline import run_batches


def _stream(spark: SparkSession, folder: str, table: str) -> DataFrame:
    schema = read_table(spark, folder, table).schema
    # As a pattern, the path may be one file as well as a folder of files.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(f"{folder}/{table}.parque[t]")


def streamed_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries by status, counted as they come in: each micro-batch leaves its counts in a folder of its own."""
    out = new_table_path(spark, "statuses")

    def work(batch: DataFrame, number: int) -> None:
        batch.groupBy("status").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = _stream(spark, folder, "raw_deliveries").select(F.lower(strip("status")).alias("status"))
    run_batches(rows, work, new_table_path(spark, "statuses-checkpoint"))
    return spark.read.parquet(out).groupBy("status").agg(F.sum("n").alias("deliveries"))


def streamed_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts by number, each id once across the batches of the stream."""
    out = new_table_path(spark, "attempt-stream")
    rows = _stream(spark, folder, "normalized_attempts").select("id", F.col("task.attempt_number").alias("attempt_number"))
    query = (
        rows.filter("id is not null").dropDuplicates(["id"]).writeStream.format("parquet").option("path", out)
        .option("checkpointLocation", new_table_path(spark, "attempt-checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out).groupBy("attempt_number").agg(F.count("*").alias("attempts"))


def streamed_lags(spark: SparkSession, folder: str) -> DataFrame:
    """Ids that wait between the queues: delivered and not normalised, normalised and without a verdict."""
    raw = read_table(spark, folder, "raw_deliveries").filter(F.lower(strip("status")) == "ok").select(strip("id").alias("id")).filter("id is not null").distinct()
    normal = read_table(spark, folder, "normalized_attempts").select("id").distinct()
    verdicts = read_table(spark, folder, "verifier_results").select("id").distinct()
    lag = lambda a, b, name: a.join(b, "id", "left_anti").agg(F.lit(name).alias("queue"), F.count("*").alias("waiting"))
    return lag(raw, normal, "raw to normal").union(lag(normal, verdicts, "normal to verdict"))


def hourly_deliveries(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries per hour of arrival, as a windowed stream with a watermark longer than the table's time span."""
    out = new_table_path(spark, "hours")

    def work(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    rows = _stream(spark, folder, "raw_deliveries").select(F.col("received_at").cast("timestamp").alias("received_at"))
    counts = rows.withWatermark("received_at", "3650 days").groupBy(F.window("received_at", "1 hour")).agg(F.count("*").alias("n"))
    query = (
        counts.writeStream.outputMode("update").foreachBatch(work)
        .option("checkpointLocation", new_table_path(spark, "hours-checkpoint")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    last = spark.read.parquet(out).groupBy("window").agg(F.max("n").alias("deliveries"))
    return last.select(F.date_format("window.start", "yyyy-MM-dd HH").alias("hour"), "deliveries")


QUERIES = {f.__name__: f for f in (streamed_statuses, streamed_attempts, streamed_lags, hourly_deliveries)}

ORACLES = {
    "streamed_statuses": r"""SELECT lower(regexp_replace(status, '^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$', '', 'g')) AS status, count(*) AS deliveries FROM raw_deliveries GROUP BY 1""",
    "streamed_attempts": "SELECT attempt_number, count(*) AS attempts FROM (SELECT DISTINCT id, task.attempt_number AS attempt_number FROM normalized_attempts WHERE id IS NOT NULL) GROUP BY 1",
    "streamed_lags": f"""WITH {_RANKED}, r AS (SELECT DISTINCT delivery_key AS id FROM ranked WHERE not_ok = 0), n AS (SELECT DISTINCT id FROM normalized_attempts), v AS (SELECT DISTINCT id FROM verifier_results)
SELECT 'raw to normal' AS queue, count(*) AS waiting FROM r WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = r.id)
UNION ALL SELECT 'normal to verdict', count(*) FROM n WHERE NOT EXISTS (SELECT 1 FROM v WHERE v.id = n.id)""",
    "hourly_deliveries": "SELECT strftime(date_trunc('hour', received_at), '%Y-%m-%d %H') AS hour, count(*) AS deliveries FROM raw_deliveries GROUP BY 1",
}
