"""Queries on messages delivered at least once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.operators.upsert import rank_deliveries, surplus_deliveries
from recordloom.session import read_table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return surplus_deliveries(read_table(spark, folder, "raw_deliveries"))


def p3_attempts(spark: SparkSession, folder: str) -> DataFrame:
    """Per number of deliveries of an attempt: attempts, and those that were kept as ok."""
    ranked = rank_deliveries(read_table(spark, folder, "raw_deliveries")).filter(F.col("delivery_key").isNotNull())
    attempts = ranked.groupBy("delivery_key").agg(F.count("*").alias("deliveries"), F.min("not_ok").alias("not_ok"))
    return attempts.groupBy("deliveries").agg(
        F.count("*").alias("attempts"), F.sum(1 - F.col("not_ok").cast("long")).alias("ok_attempts")
    )


QUERIES = {"p3_found": p3_found, "p3_attempts": p3_attempts}

_RANKED = r"""
ranked AS (
  SELECT delivery_no, received_at, regexp_replace(id, '^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$', '', 'g') AS delivery_key,
    CASE WHEN lower(regexp_replace(status, '^[\s\x{00A0}\x{3000}]+|[\s\x{00A0}\x{3000}]+$', '', 'g')) = 'ok' THEN 0 ELSE 1 END AS not_ok
  FROM raw_deliveries WHERE id IS NOT NULL)
"""
ORACLES = {
    "p3_found": f"""
WITH {_RANKED}, placed AS (
  SELECT delivery_no, row_number() OVER (PARTITION BY delivery_key ORDER BY not_ok, received_at, delivery_no) AS place FROM ranked)
SELECT delivery_no FROM placed WHERE place > 1
""",
    "p3_attempts": f"""
WITH {_RANKED}, attempts AS (
  SELECT delivery_key, count(*) AS deliveries, min(not_ok) AS not_ok FROM ranked GROUP BY delivery_key)
SELECT deliveries, count(*) AS attempts, CAST(sum(1 - not_ok) AS BIGINT) AS ok_attempts FROM attempts GROUP BY deliveries
""",
}
