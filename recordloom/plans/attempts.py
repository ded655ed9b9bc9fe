"""Queries on deliveries, normal records and verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.numeric import rate
from recordloom.operators import aggregates, joins
from recordloom.operators.upsert import kept_deliveries, rank_deliveries
from recordloom.plans.deliveries import _RANKED
from recordloom.session import read_table

MOST_ATTEMPTS = 3


def _attempts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per attempt with its problem, number and verdict."""
    normal = read_table(spark, folder, "normalized_attempts").select(
        "id", F.col("task.problem_id").alias("problem_id"), F.col("task.attempt_number").alias("attempt_number")
    )
    verdicts = read_table(spark, folder, "verifier_results").select("id", "failure_category").distinct()
    return normal.distinct().join(verdicts, "id")


_ATTEMPTS = """attempts AS (
  SELECT DISTINCT n.id, n.task.problem_id AS problem_id, n.task.attempt_number AS attempt_number, v.failure_category
  FROM normalized_attempts n JOIN verifier_results v ON n.id = v.id)"""


def attempt_funnel(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct attempts at each stage, and their share of those before."""
    ranked = rank_deliveries(read_table(spark, folder, "raw_deliveries")).filter("delivery_key is not null")
    raw = ranked.groupBy(F.col("delivery_key").alias("id")).agg(F.min("not_ok").alias("not_ok"))
    normal = read_table(spark, folder, "normalized_attempts").select("id").distinct().withColumn("n", F.lit(1))
    verdicts = read_table(spark, folder, "verifier_results").groupBy("id").agg(F.max((F.col("failure_category") == "passed").cast("int")).alias("passed"))
    joined = raw.join(normal, "id", "left").join(verdicts, "id", "left")
    counts = joined.agg(
        F.count("*").alias("delivered"),
        F.count(F.when(F.col("not_ok") == 0, 1)).alias("ok"),
        F.count("n").alias("normalised"),
        F.count("passed").alias("verified"),
        F.coalesce(F.sum("passed"), F.lit(0)).cast("long").alias("passed"),
    )
    return counts.withColumns({
        "ok_rate": F.round(rate(F.col("ok"), F.col("delivered")), 6),
        "normalised_rate": F.round(rate(F.col("normalised"), F.col("ok")), 6),
        "passed_rate": F.round(rate(F.col("passed"), F.col("verified")), 6),
    })


def verdict_counts(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "verifier_results").select("id", "failure_category").distinct()
    return rows.groupBy("failure_category").agg(F.count("*").alias("attempts"))


def verdicts_by_number(spark: SparkSession, folder: str) -> DataFrame:
    return _attempts(spark, folder).groupBy("attempt_number", "failure_category").agg(F.count("*").alias("attempts"))


def earliest_pass(spark: SparkSession, folder: str) -> DataFrame:
    passed = F.when(F.col("failure_category") == "passed", F.col("attempt_number"))
    return _attempts(spark, folder).groupBy("problem_id").agg(F.min(passed).alias("first_pass"), F.count("*").alias("attempts"))


def pass_at_k(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.pass_at(_attempts(spark, folder), "problem_id", "attempt_number", F.col("failure_category") == "passed", MOST_ATTEMPTS)


def mean_first_pass(spark: SparkSession, folder: str) -> DataFrame:
    firsts = earliest_pass(spark, folder)
    return firsts.agg(
        F.count("first_pass").alias("passed_problems"), F.round(F.avg("first_pass"), 6).alias("mean_first_pass"),
        F.round(rate(F.sum("attempts"), F.count("first_pass")), 6).alias("attempts_per_pass"),
    )


def attempt_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """What became of each delivered attempt, counted."""
    raw = kept_deliveries(read_table(spark, folder, "raw_deliveries")).select(F.col("delivery_key").alias("id"), "not_ok")
    normal = read_table(spark, folder, "normalized_attempts").select("id", "lang").dropDuplicates(["id"])
    verdicts = read_table(spark, folder, "verifier_results").select("id", "failure_category").dropDuplicates(["id"])
    joined = joins.attempt_join(raw, normal, verdicts)
    outcome = (
        F.when(F.col("raw.not_ok") == 1, "api_error").when(F.col("normalised").isNull(), "not_normalised")
        .when(F.col("verdict").isNull(), "verification_missing").otherwise(F.col("verdict.failure_category"))
    )
    return joined.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("attempts"))


def reference_violations(spark: SparkSession, folder: str) -> DataFrame:
    ranked = rank_deliveries(read_table(spark, folder, "raw_deliveries")).filter("delivery_key is not null")
    named = {
        "raw": ranked.select(F.col("delivery_key").alias("id")),
        "ok": ranked.filter("not_ok = 0").select(F.col("delivery_key").alias("id")),
        "normal": read_table(spark, folder, "normalized_attempts").select("id"),
        "verdict": read_table(spark, folder, "verifier_results").select("id"),
        "training": read_table(spark, folder, "training_records").select(F.col("train_id").alias("id")),
    }
    rules = [("normal", "ok"), ("verdict", "normal"), ("training", "normal"), ("ok", "normal")]
    found = joins.reference_violations(named, "id", rules)
    return found.groupBy("rule").agg(F.count("*").alias("violations"), F.min("key").alias("first_key"))


def pending_verification(spark: SparkSession, folder: str) -> DataFrame:
    normal = read_table(spark, folder, "normalized_attempts").select("id").distinct()
    return joins.pending(normal, read_table(spark, folder, "verifier_results"), "id")


def complete_problems(spark: SparkSession, folder: str) -> DataFrame:
    """Problems by the number of different attempts that were seen."""
    per = _attempts(spark, folder).groupBy("problem_id").agg(F.countDistinct("attempt_number").alias("seen"))
    return per.groupBy("seen").agg(F.count("*").alias("problems"))


def delivery_surplus(spark: SparkSession, folder: str) -> DataFrame:
    ranked = rank_deliveries(read_table(spark, folder, "raw_deliveries")).filter("delivery_key is not null")
    return aggregates.surplus(ranked, ["delivery_key"])


def usage_totals(spark: SparkSession, folder: str) -> DataFrame:
    names = ("prompt_tokens", "completion_tokens", "total_tokens")
    fields = F.create_map(*[x for n in names for x in (F.lit(n), F.col(f"token_usage.{n}"))])
    return aggregates.key_sums(read_table(spark, folder, "normalized_attempts"), fields)


def durations(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "raw_deliveries").withColumn("model", F.col("request.model"))
    return aggregates.nearest_rank(rows, ["model"], "request_duration_seconds")


def response_lengths(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "normalized_attempts").select("lang", F.length("response_text").alias("chars"))
    return aggregates.interpolated(rows, ["lang"], "chars")


def verification_coverage(spark: SparkSession, folder: str) -> DataFrame:
    verdicts = read_table(spark, folder, "verifier_results")
    candidates = read_table(spark, folder, "normalized_attempts").select("id")
    done, failed = verdicts.filter("failure_category = 'passed'"), verdicts.filter("failure_category <> 'passed'")
    states = joins.coverage(candidates, done.select("id"), failed.select("id"), "id")
    return states.groupBy("state").agg(F.count("*").alias("attempts"))


def last_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "verifier_results").select("id", "failure_category", "verified_at").filter("verified_at is not null")
    return joins.last_of_each(rows, "id", "verified_at").select("id", "failure_category")


def open_slots(spark: SparkSession, folder: str) -> DataFrame:
    """Of the grid of problems and attempt numbers: how many were tried."""
    attempts = _attempts(spark, folder)
    grid = joins.slots(attempts, "problem_id", MOST_ATTEMPTS)
    tried = attempts.select("problem_id", "attempt_number").distinct().withColumn("tried", F.lit(1))
    return grid.join(tried, ["problem_id", "attempt_number"], "left").groupBy("attempt_number").agg(
        F.count("*").alias("slots"), F.count("tried").alias("tried")
    )


def first_retries(spark: SparkSession, folder: str) -> DataFrame:
    """First attempt after the first one, of each problem."""
    later = _attempts(spark, folder).filter("attempt_number > 1")
    return later.groupBy("problem_id").agg(F.min_by("id", F.struct("attempt_number", "id")).alias("id"))


def dataset_licences(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "tasks").select(F.lower("source.dataset").alias("dataset"), F.col("source.license").alias("license"))
    return rows.groupBy("dataset").agg(F.count("*").alias("tasks"), F.array_join(F.sort_array(F.collect_set("license")), ",").alias("licences"))


def verdict_totals(spark: SparkSession, folder: str) -> DataFrame:
    """Per category and over all: attempts and those whose fence was removed."""
    rows = read_table(spark, folder, "verifier_results")
    return aggregates.totals_and_groups(rows, "failure_category", [
        F.count("*").alias("rows"), F.count(F.when(F.col("removed_markdown_fence"), 1)).alias("fence_removed"),
    ])


QUERIES = {f.__name__: f for f in (
    attempt_funnel, verdict_counts, verdicts_by_number, earliest_pass, pass_at_k, mean_first_pass, attempt_outcomes,
    reference_violations, pending_verification, complete_problems, delivery_surplus, usage_totals, durations,
    response_lengths, verification_coverage, last_verdicts, open_slots, first_retries, dataset_licences, verdict_totals,
)}

ORACLES = {
    "attempt_funnel": f"""
WITH {_RANKED}, raw AS (SELECT delivery_key AS id, min(not_ok) AS not_ok FROM ranked GROUP BY 1),
verdicts AS (SELECT id, max(CASE WHEN failure_category = 'passed' THEN 1 ELSE 0 END) AS passed FROM verifier_results GROUP BY 1),
counts AS (
  SELECT count(*) AS delivered, count(CASE WHEN not_ok = 0 THEN 1 END) AS ok, count(n.id) AS normalised, count(v.passed) AS verified,
    CAST(coalesce(sum(v.passed), 0) AS BIGINT) AS passed
  FROM raw LEFT JOIN (SELECT DISTINCT id FROM normalized_attempts) n ON raw.id = n.id LEFT JOIN verdicts v ON raw.id = v.id)
SELECT *, round(ok / nullif(delivered, 0)::DOUBLE, 6) AS ok_rate, round(normalised / nullif(ok, 0)::DOUBLE, 6) AS normalised_rate,
  round(passed / nullif(verified, 0)::DOUBLE, 6) AS passed_rate FROM counts""",
    "verdict_counts": "SELECT failure_category, count(*) AS attempts FROM (SELECT DISTINCT id, failure_category FROM verifier_results) GROUP BY 1",
    "verdicts_by_number": f"WITH {_ATTEMPTS} SELECT attempt_number, failure_category, count(*) AS attempts FROM attempts GROUP BY 1, 2",
    "earliest_pass": f"""WITH {_ATTEMPTS} SELECT problem_id, min(CASE WHEN failure_category = 'passed' THEN attempt_number END) AS first_pass,
  count(*) AS attempts FROM attempts GROUP BY 1""",
    "pass_at_k": f"""WITH {_ATTEMPTS}, firsts AS (
  SELECT problem_id, min(CASE WHEN failure_category = 'passed' THEN attempt_number END) AS f FROM attempts GROUP BY 1),
ks AS (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS k)
SELECT k, count(*) AS problems, count(CASE WHEN f <= k THEN 1 END) AS passed,
  round(count(CASE WHEN f <= k THEN 1 END) / count(*)::DOUBLE, 6) AS pass_rate FROM ks, firsts GROUP BY k""",
    "mean_first_pass": f"""WITH {_ATTEMPTS}, firsts AS (
  SELECT problem_id, min(CASE WHEN failure_category = 'passed' THEN attempt_number END) AS f, count(*) AS n FROM attempts GROUP BY 1)
SELECT count(f) AS passed_problems, round(avg(f), 6) AS mean_first_pass, round(sum(n) / nullif(count(f), 0)::DOUBLE, 6) AS attempts_per_pass FROM firsts""",
    "attempt_outcomes": f"""WITH {_RANKED}, raw AS (SELECT delivery_key AS id, min(not_ok) AS not_ok FROM ranked GROUP BY 1),
v AS (SELECT DISTINCT id, failure_category FROM verifier_results), n AS (SELECT DISTINCT id FROM normalized_attempts)
SELECT CASE WHEN not_ok = 1 THEN 'api_error' WHEN n.id IS NULL THEN 'not_normalised' WHEN v.id IS NULL THEN 'verification_missing'
  ELSE v.failure_category END AS outcome, count(*) AS attempts
FROM raw LEFT JOIN n ON raw.id = n.id LEFT JOIN v ON raw.id = v.id GROUP BY 1""",
    "reference_violations": f"""WITH {_RANKED}, ok AS (SELECT DISTINCT delivery_key AS id FROM ranked WHERE not_ok = 0),
n AS (SELECT DISTINCT id FROM normalized_attempts), v AS (SELECT DISTINCT id FROM verifier_results),
t AS (SELECT DISTINCT train_id AS id FROM training_records),
bad AS (SELECT 'normal in ok' AS rule, id FROM n WHERE id NOT IN (SELECT id FROM ok)
  UNION ALL SELECT 'verdict in normal', id FROM v WHERE id NOT IN (SELECT id FROM n)
  UNION ALL SELECT 'training in normal', id FROM t WHERE id NOT IN (SELECT id FROM n)
  UNION ALL SELECT 'ok in normal', id FROM ok WHERE id NOT IN (SELECT id FROM n))
SELECT rule, count(*) AS violations, min(id) AS first_key FROM bad GROUP BY 1""",
    "pending_verification": "SELECT DISTINCT id FROM normalized_attempts n WHERE NOT EXISTS (SELECT 1 FROM verifier_results v WHERE v.id = n.id)",
    "complete_problems": f"""WITH {_ATTEMPTS} SELECT seen, count(*) AS problems FROM (
  SELECT problem_id, count(DISTINCT attempt_number) AS seen FROM attempts GROUP BY 1) GROUP BY 1""",
    "delivery_surplus": f"""WITH {_RANKED} SELECT CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS repeated_keys,
  CAST(coalesce(sum(n - 1), 0) AS BIGINT) AS surplus_rows FROM (SELECT delivery_key, count(*) AS n FROM ranked GROUP BY 1)""",
    "usage_totals": """WITH kv AS (
  SELECT 'prompt_tokens' AS key, token_usage.prompt_tokens AS value FROM normalized_attempts
  UNION ALL SELECT 'completion_tokens', token_usage.completion_tokens FROM normalized_attempts
  UNION ALL SELECT 'total_tokens', token_usage.total_tokens FROM normalized_attempts)
SELECT key, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM kv WHERE value IS NOT NULL GROUP BY 1""",
    "durations": """SELECT request.model AS model, count(*) AS n, min(request_duration_seconds) AS min, max(request_duration_seconds) AS max,
  round(avg(request_duration_seconds), 6) AS mean, round(median(request_duration_seconds), 6) AS median,
  quantile_disc(request_duration_seconds, 0.95) AS p95 FROM raw_deliveries WHERE request_duration_seconds IS NOT NULL GROUP BY 1""",
    "response_lengths": """SELECT lang, count(*) AS n, CAST(min(length(response_text)) AS INTEGER) AS min, CAST(max(length(response_text)) AS INTEGER) AS max,
  round(median(length(response_text)), 6) AS median, round(quantile_cont(length(response_text), 0.95), 6) AS p95
FROM normalized_attempts WHERE response_text IS NOT NULL GROUP BY 1""",
    "verification_coverage": """WITH c AS (SELECT DISTINCT id FROM normalized_attempts),
d AS (SELECT DISTINCT id FROM verifier_results WHERE failure_category = 'passed'), f AS (SELECT DISTINCT id FROM verifier_results WHERE failure_category <> 'passed'),
k AS (SELECT id FROM c UNION SELECT id FROM d UNION SELECT id FROM f)
SELECT CASE WHEN c.id IS NULL THEN 'unknown' WHEN d.id IS NOT NULL AND f.id IS NOT NULL THEN 'both' WHEN d.id IS NOT NULL THEN 'done'
  WHEN f.id IS NOT NULL THEN 'failed' ELSE 'neither' END AS state, count(*) AS attempts
FROM k LEFT JOIN c ON k.id = c.id LEFT JOIN d ON k.id = d.id LEFT JOIN f ON k.id = f.id GROUP BY 1""",
    "last_verdicts": "SELECT id, arg_max(failure_category, verified_at) AS failure_category FROM verifier_results WHERE verified_at IS NOT NULL GROUP BY 1",
    "open_slots": f"""WITH {_ATTEMPTS}, grid AS (SELECT DISTINCT problem_id, k AS attempt_number FROM attempts, (SELECT CAST(unnest([1, 2, 3]) AS INTEGER) AS k)),
tried AS (SELECT DISTINCT problem_id, attempt_number FROM attempts)
SELECT g.attempt_number, count(*) AS slots, count(t.problem_id) AS tried FROM grid g LEFT JOIN tried t
  ON g.problem_id = t.problem_id AND g.attempt_number = t.attempt_number GROUP BY 1""",
    "first_retries": f"""WITH {_ATTEMPTS} SELECT problem_id, id FROM (
  SELECT problem_id, id, row_number() OVER (PARTITION BY problem_id ORDER BY attempt_number, id) AS place FROM attempts WHERE attempt_number > 1) WHERE place = 1""",
    "dataset_licences": """SELECT lower(source.dataset) AS dataset, count(*) AS tasks, coalesce(array_to_string(list_sort(list(DISTINCT source.license) FILTER (source.license IS NOT NULL)), ','), '') AS licences
FROM tasks GROUP BY 1""",
    "verdict_totals": """SELECT failure_category, CAST(grouping(failure_category) AS INTEGER) AS is_total, count(*) AS rows,
  count(CASE WHEN removed_markdown_fence THEN 1 END) AS fence_removed FROM verifier_results GROUP BY ROLLUP (failure_category)""",
}
