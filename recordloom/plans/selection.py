"""Queries that order, select, deal out and compare sets of rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions.text import prompt_body, whole_fingerprint
from recordloom.operators import aggregates, dedup, joins, ordering
from recordloom.session import read_table
from recordloom.sources.tasks import union_in_order

SEED, SAMPLE = 42, 100
FIRST_BATCH, BATCH, SHARD, TARGET = 50, 200, 128, 200


def hash_sample(spark: SparkSession, folder: str) -> DataFrame:
    """A sample of fixed size that further rows hardly change."""
    tasks = read_table(spark, folder, "tasks").select("problem_id")
    return ordering.hash_sample(tasks, "problem_id", SAMPLE, SEED)


def seeded_sample(spark: SparkSession, folder: str) -> DataFrame:
    """The draw of Python's generator over the tasks in their order."""
    tasks = read_table(spark, folder, "tasks").select("problem_id", "selection_index")
    return ordering.seeded_sample(tasks, ["selection_index", "problem_id"], SAMPLE, SEED)


def ordered_ids_hash(spark: SparkSession, folder: str) -> DataFrame:
    return aggregates.ordered_hash(read_table(spark, folder, "training_records"), ["record_no", "train_id"], "train_id")


def task_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks in contiguous batches, the first of another size: per batch the rows and the first and last task."""
    tasks = read_table(spark, folder, "tasks").select("problem_id", "selection_index")
    placed = ordering.with_position(tasks, ["selection_index", "problem_id"])
    batch = ordering.batches(F.col("position"), FIRST_BATCH, BATCH)
    at = F.struct("position", "problem_id")
    grouped = placed.groupBy(batch.alias("batch")).agg(F.count("*").alias("tasks"), F.min(at).alias("a"), F.max(at).alias("b"))
    return grouped.select("batch", "tasks", F.col("a.problem_id").alias("first_task"), F.col("b.problem_id").alias("last_task"))


def record_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard of each training record in order, by number of rows: per shard the rows and characters."""
    records = read_table(spark, folder, "training_records").select("record_no", "train_id", F.length("response_text").alias("chars"))
    placed = ordering.with_position(records, ["record_no", "train_id"])
    return placed.groupBy(ordering.shard(F.col("position"), SHARD).alias("shard")).agg(F.count("*").alias("records"), F.sum("chars").alias("chars"))


def round_robin(spark: SparkSession, folder: str) -> DataFrame:
    """Training records interleaved over their datasets."""
    records = read_table(spark, folder, "training_records").select(
        "train_id", "record_no", F.coalesce(F.lower("task.source.dataset"), F.lit("unknown")).alias("dataset")
    )
    return ordering.interleaved(records, "dataset", ["record_no", "train_id"]).select("train_id", "dataset", "position")


def target_and_reserve(spark: SparkSession, folder: str) -> DataFrame:
    records = read_table(spark, folder, "training_records").select("train_id", "record_no", F.col("task.lang").alias("lang"))
    parts = ordering.target_and_reserve(records, ["record_no", "train_id"], TARGET)
    return parts.groupBy("part", "lang").agg(F.count("*").alias("records"))


def first_unused_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """The first tasks in order that no training record uses."""
    tasks = read_table(spark, folder, "tasks").select("problem_id", "selection_index")
    left = joins.without(tasks, [read_table(spark, folder, "training_records")], "problem_id")
    return ordering.first_rows(left, ["selection_index", "problem_id"], SAMPLE)


def sources_in_order(spark: SparkSession, folder: str) -> DataFrame:
    """All statements of three tables, by table and rank of the table."""
    parts = [
        ("tasks", read_table(spark, folder, "tasks").select(F.col("problem_text").alias("text"))),
        ("heldout", read_table(spark, folder, "heldout_tasks").select(F.col("prompt").alias("text"))),
        ("documents", read_table(spark, folder, "documents").select("text")),
    ]
    return union_in_order(parts).groupBy("source_rank", "source_name").agg(
        F.count("*").alias("rows"), F.count("text").alias("texts"), F.sum(F.length("text")).alias("chars")
    )


def repeated_statements(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks whose statement has the words of an earlier task's."""
    tasks = read_table(spark, folder, "tasks").select("problem_id", "selection_index", whole_fingerprint("problem_text").alias("words"))
    return dedup.duplicates_of(tasks.filter(F.length("words") > 0), "problem_id", "words", ["selection_index", "problem_id"])


def first_statements(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks that are the first with their words."""
    tasks = read_table(spark, folder, "tasks").select("problem_id", "selection_index", whole_fingerprint("problem_text").alias("words"))
    return dedup.keep_first(tasks.filter("words is not null"), ["words"], ["selection_index", "problem_id"]).select("problem_id", "selection_index")


def greedy_records(spark: SparkSession, folder: str) -> DataFrame:
    """Attempts in order of time, kept when neither the problem nor the words of the answer were kept before."""
    normal = read_table(spark, folder, "normalized_attempts")
    rows = normal.select(
        F.concat_ws(" ", F.date_format("collected_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "id").alias("seq"),
        "id", F.col("task.problem_id").alias("problem_id"), whole_fingerprint("response_text").alias("words"),
    ).dropDuplicates(["seq"])
    found = dedup.greedy_distinct(rows, ["id", "problem_id", "words"], "seq")
    return found.groupBy("kept", "reason").agg(F.count("*").alias("rows"))


def shared_original_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Original ids that tasks and held-out items share, as numbers."""
    a = read_table(spark, folder, "tasks").select(F.col("source.original_id").try_cast("bigint").alias("number"))
    b = read_table(spark, folder, "heldout_tasks").select(F.regexp_extract("heldout_id", r"(\d+)", 1).try_cast("bigint").alias("number"))
    return a.filter("number is not null").intersect(b.filter("number is not null"))


def unseen_problems(spark: SparkSession, folder: str) -> DataFrame:
    tasks = read_table(spark, folder, "tasks").select("problem_id").distinct()
    return tasks.exceptAll(read_table(spark, folder, "raw_deliveries").select("problem_id").distinct())


def batch_contiguity(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the delivery numbers of a batch are a run without gaps."""
    rows = read_table(spark, folder, "raw_deliveries")
    return rows.groupBy("batch_id").agg(
        F.count("*").alias("deliveries"), F.countDistinct("delivery_no").alias("numbers"),
        (F.max("delivery_no") - F.min("delivery_no") + 1 == F.countDistinct("delivery_no")).alias("contiguous"),
    )


def layout_drift(spark: SparkSession, folder: str) -> DataFrame:
    """Training records whose answer or end differs from that of the attempt."""
    training = read_table(spark, folder, "training_records").select(F.col("train_id").alias("id"), "response_text", "finish_reason")
    normal = read_table(spark, folder, "normalized_attempts").select("id", "response_text", "finish_reason").distinct()
    found = joins.drift(training, normal.join(training.select("id"), "id", "left_semi"), "id", ["response_text", "finish_reason"])
    return found.groupBy("side", F.array_join("differ", ",").alias("differ")).agg(F.count("*").alias("rows"))


def statement_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Training records whose statement has exactly the words of a held-out one."""
    return joins.exact_overlap(
        read_table(spark, folder, "training_records"), read_table(spark, folder, "heldout_tasks"), "train_id", "heldout_id",
        whole_fingerprint("task.problem_text"), whole_fingerprint(prompt_body("prompt")),
    )


QUERIES = {f.__name__: f for f in (
    hash_sample, seeded_sample, ordered_ids_hash, task_batches, record_shards, round_robin, target_and_reserve,
    first_unused_tasks, sources_in_order, repeated_statements, first_statements, greedy_records, shared_original_ids,
    unseen_problems, batch_contiguity, layout_drift, statement_overlap,
)}


def _words(text: str) -> str:
    return rf"array_to_string(regexp_extract_all(regexp_replace(lower({text}), 'ß', 'ss', 'g'), '[\p{{L}}\p{{N}}_]+'), ' ')"


#: The statement of a held-out item in SQL; q1 and q2 are the two kinds of triple quotes.
BODY = """array_to_string(list_filter(string_split(
  CASE WHEN len(string_split(prompt, q2)) >= 3 AND (len(string_split(prompt, q1)) < 3 OR strpos(prompt, q2) < strpos(prompt, q1)) THEN split_part(prompt, q2, 2)
    WHEN len(string_split(prompt, q1)) >= 3 THEN split_part(prompt, q1, 2) ELSE prompt END,
  chr(10)), lambda x: NOT starts_with(x, 'assert ')), chr(10))"""
HELDOUT = f"""held AS (SELECT heldout_id, split, prompt, entry_point, assertion_text, {BODY} AS body
  FROM (SELECT *, repeat(chr(39), 3) AS q1, repeat(chr(34), 3) AS q2 FROM heldout_tasks))"""
_PLACED_TASKS = "placed AS (SELECT problem_id, row_number() OVER (ORDER BY selection_index, problem_id) - 1 AS position FROM tasks)"

ORACLES = {
    "hash_sample": f"""SELECT problem_id, sha256('{SEED}' || chr(0) || problem_id) AS selection_rank FROM tasks
ORDER BY selection_rank, problem_id LIMIT {SAMPLE}""",
    "ordered_ids_hash": "SELECT count(*) AS n, sha256(string_agg(train_id, chr(10) ORDER BY record_no, train_id)) AS sha256 FROM training_records",
    "task_batches": f"""WITH {_PLACED_TASKS}, b AS (SELECT *, CAST(CASE WHEN position < {FIRST_BATCH} THEN 1
  ELSE floor((position - {FIRST_BATCH}) / {BATCH}) + 2 END AS BIGINT) AS batch FROM placed)
SELECT batch, count(*) AS tasks, arg_min(problem_id, position) AS first_task, arg_max(problem_id, position) AS last_task FROM b GROUP BY 1""",
    "record_shards": f"""WITH placed AS (SELECT length(response_text) AS chars, row_number() OVER (ORDER BY record_no, train_id) - 1 AS position FROM training_records)
SELECT CAST(floor(position / {SHARD}) AS BIGINT) AS shard, count(*) AS records, CAST(sum(chars) AS BIGINT) AS chars FROM placed GROUP BY 1""",
    "round_robin": """WITH r AS (SELECT train_id, record_no, coalesce(lower(task.source.dataset), 'unknown') AS dataset FROM training_records),
p AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY record_no, train_id) AS round FROM r),
f AS (SELECT dataset, row_number() OVER (ORDER BY record_no, train_id) AS lead FROM p WHERE round = 1)
SELECT train_id, p.dataset, row_number() OVER (ORDER BY round, lead) - 1 AS position FROM p JOIN f ON p.dataset = f.dataset""",
    "target_and_reserve": f"""WITH p AS (SELECT task.lang AS lang, row_number() OVER (ORDER BY record_no, train_id) AS n FROM training_records)
SELECT CASE WHEN n <= {TARGET} THEN 'target' ELSE 'reserve' END AS part, lang, count(*) AS records FROM p GROUP BY 1, 2""",
    "first_unused_tasks": f"""SELECT problem_id, selection_index FROM tasks t WHERE NOT EXISTS (SELECT 1 FROM training_records r WHERE r.problem_id = t.problem_id)
ORDER BY selection_index, problem_id LIMIT {SAMPLE}""",
    "sources_in_order": """SELECT source_rank, source_name, count(*) AS rows, count(text) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars FROM (
  SELECT 0 AS source_rank, 'tasks' AS source_name, problem_text AS text FROM tasks UNION ALL SELECT 1, 'heldout', prompt FROM heldout_tasks
  UNION ALL SELECT 2, 'documents', text FROM documents) GROUP BY 1, 2""",
    "repeated_statements": f"""WITH t AS (SELECT problem_id, selection_index, {_words('problem_text')} AS words FROM tasks),
p AS (SELECT problem_id, first_value(problem_id) OVER (PARTITION BY words ORDER BY selection_index, problem_id) AS duplicate_of FROM t WHERE length(words) > 0)
SELECT problem_id, duplicate_of FROM p WHERE problem_id <> duplicate_of""",
    "first_statements": f"""WITH t AS (SELECT problem_id, selection_index, {_words('problem_text')} AS words FROM tasks WHERE problem_text IS NOT NULL)
SELECT problem_id, selection_index FROM (SELECT *, row_number() OVER (PARTITION BY words ORDER BY selection_index, problem_id) AS place FROM t) WHERE place = 1""",
    "shared_original_ids": r"""SELECT number FROM (SELECT try_cast(source.original_id AS BIGINT) AS number FROM tasks) WHERE number IS NOT NULL
INTERSECT SELECT number FROM (SELECT try_cast(nullif(regexp_extract(heldout_id, '(\d+)', 1), '') AS BIGINT) AS number FROM heldout_tasks) WHERE number IS NOT NULL""",
    "unseen_problems": "SELECT DISTINCT problem_id FROM tasks EXCEPT SELECT problem_id FROM raw_deliveries",
    "batch_contiguity": """SELECT batch_id, count(*) AS deliveries, count(DISTINCT delivery_no) AS numbers,
  max(delivery_no) - min(delivery_no) + 1 = count(DISTINCT delivery_no) AS contiguous FROM raw_deliveries GROUP BY 1""",
    "layout_drift": """WITH n AS (SELECT DISTINCT id, response_text, finish_reason FROM normalized_attempts),
j AS (SELECT n.id AS n_id, concat_ws(',', CASE WHEN t.response_text IS DISTINCT FROM n.response_text THEN 'response_text' END,
  CASE WHEN t.finish_reason IS DISTINCT FROM n.finish_reason THEN 'finish_reason' END) AS differ FROM training_records t LEFT JOIN n ON t.train_id = n.id)
SELECT CASE WHEN n_id IS NULL THEN 'left only' ELSE 'both' END AS side, CASE WHEN n_id IS NULL THEN NULL ELSE differ END AS differ, count(*) AS rows
FROM j WHERE n_id IS NULL OR differ <> '' GROUP BY 1, 2""",
    "statement_overlap": f"""WITH {HELDOUT}, h AS (SELECT heldout_id, {_words('body')} AS words FROM held),
t AS (SELECT train_id, {_words('task.problem_text')} AS words FROM training_records)
SELECT train_id AS left_id, heldout_id AS right_id FROM t JOIN h ON t.words = h.words WHERE length(t.words) > 0""",
}
