"""Queries on the states of attempt slots, gates, landed files and short sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import text as X
from recordloom.functions.numeric import bytes_match, bytes_valid
from recordloom.operators import aggregates, alignment, joins, ordering
from recordloom.operators.upsert import rank_deliveries
from recordloom.plans.attempts import _ATTEMPTS, MOST_ATTEMPTS, _attempts
from recordloom.plans.deliveries import _RANKED
from recordloom.session import new_table_path, read_table
from recordloom.sources import jsonl, sinks, tasks

RECORD = "id string, lang string, finish_reason string, response_text string, usage struct<completion_tokens: bigint>"


def slot_states(spark: SparkSession, folder: str) -> DataFrame:
    """Every problem's attempt slots, relative to its earliest pass: requested, unused, not requested or pending."""
    problems = read_table(spark, folder, "tasks").filter("problem_id is not null")
    slots = joins.slots(problems, "problem_id", MOST_ATTEMPTS).withColumn("id", X.attempt_id("problem_id", "attempt_number"))
    there = rank_deliveries(read_table(spark, folder, "raw_deliveries")).select(F.col("delivery_key").alias("id")).distinct()
    passed = F.when(F.col("failure_category") == "passed", F.col("attempt_number"))
    first = _attempts(spark, folder).groupBy("problem_id").agg(F.min(passed).alias("first_pass"))
    rows = slots.join(there.withColumn("there", F.lit(True)), "id", "left").join(first, "problem_id", "left")
    late = F.coalesce(F.col("attempt_number") > F.col("first_pass"), F.lit(False))
    state = (
        F.when(F.col("there") & late, "unused_after_pass").when(F.col("there"), "requested")
        .when(late, "not_requested_after_pass").otherwise("pending")
    )
    return rows.groupBy("attempt_number", state.alias("state")).agg(F.count("*").alias("slots"))


def wave_plan(spark: SparkSession, folder: str) -> DataFrame:
    """Per wave: problems without a pass in any earlier attempt, and those of them that lack an earlier attempt."""
    problems = read_table(spark, folder, "tasks").select("problem_id").filter("problem_id is not null").distinct()
    seen = _attempts(spark, folder).groupBy("problem_id").agg(
        F.min(F.when(F.col("failure_category") == "passed", F.col("attempt_number"))).alias("first_pass"),
        F.collect_set("attempt_number").alias("numbers"),
    )
    waves = joins.slots(problems, "problem_id", MOST_ATTEMPTS).join(seen, "problem_id", "left")
    wave = F.col("attempt_number")
    planned = waves.filter(F.col("first_pass").isNull() | (F.col("first_pass") >= wave))
    earlier = F.size(F.filter(F.coalesce("numbers", F.array().cast("array<int>")), lambda n: n < wave))
    return planned.groupBy(wave.alias("wave")).agg(
        F.count("*").alias("problems"), F.count(F.when(earlier < wave - 1, 1)).alias("lack_earlier_attempt")
    )


def combined_accepted(spark: SparkSession, folder: str) -> DataFrame:
    """Per problem the frozen record, or else the first attempt that passed."""
    frozen = read_table(spark, folder, "training_records").groupBy("problem_id").agg(F.min("train_id").alias("frozen_id"))
    passed = _attempts(spark, folder).filter("failure_category = 'passed'")
    fresh = passed.groupBy("problem_id").agg(F.min(F.struct("attempt_number", "id"))["id"].alias("fresh_id"))
    order = read_table(spark, folder, "tasks").groupBy("problem_id").agg(F.min("selection_index").alias("selection_index"))
    both = order.join(frozen, "problem_id", "left").join(fresh, "problem_id", "left")
    return both.select(
        "selection_index", "problem_id", F.coalesce("frozen_id", "fresh_id").alias("accepted_id"), F.col("frozen_id").isNull().alias("fresh")
    ).filter("accepted_id is not null")


#: Rates of an example: a million tokens of prompt and of completion.
RATES = (0.5, 2.0)


def usage_cost(spark: SparkSession, folder: str) -> DataFrame:
    """Cost of the usage of each dataset; usage that is null or negative is none."""
    rows = read_table(spark, folder, "normalized_attempts").dropDuplicates(["id"])
    amount = lambda c: F.greatest(F.coalesce(F.col(f"token_usage.{c}"), F.lit(0)), F.lit(0))
    cost = aggregates.weighted_cost([(F.sum(amount("prompt_tokens")), RATES[0]), (F.sum(amount("completion_tokens")), RATES[1])])
    return rows.groupBy(F.col("task.source.dataset").alias("dataset")).agg(F.count("*").alias("answers"), F.round(cost, 6).alias("cost"))


def resume_flags(spark: SparkSession, folder: str) -> DataFrame:
    """One row: ids that are there, deliveries and tasks beyond the first, and whether a resumed run repeats nothing."""
    ids = rank_deliveries(read_table(spark, folder, "raw_deliveries")).filter("delivery_key is not null")
    counts = ids.groupBy("delivery_key").agg(F.count("*").alias("n"))
    originals = read_table(spark, folder, "tasks").filter("source.original_id is not null").groupBy("source.original_id").agg(F.count("*").alias("n"))
    repeats = originals.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_original_tasks"))
    return counts.agg(
        F.count("*").alias("completed_ids"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_record_ids"),
        F.coalesce(F.max("n") <= 1, F.lit(True)).alias("resume_safe"),
    ).join(F.broadcast(repeats))


def verdict_ranking(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "verifier_results").select("id", "failure_category").distinct()
    return aggregates.most_common(rows, "failure_category", "id").select("failure_category", F.col("n").alias("attempts"), "place")


def score_subsets(spark: SparkSession, folder: str) -> DataFrame:
    """First attempts that passed, and that passed without a fence being taken off, in frozen and other problems."""
    verdicts = read_table(spark, folder, "verifier_results").select("id", "failure_category", "removed_markdown_fence").distinct()
    first = read_table(spark, folder, "normalized_attempts").filter("task.attempt_number = 1").select("id", F.col("task.problem_id").alias("problem_id")).distinct()
    frozen = read_table(spark, folder, "training_records").select("problem_id").distinct().withColumn("frozen", F.lit(True))
    rows = first.join(verdicts, "id").join(frozen, "problem_id", "left")
    passed = F.coalesce(F.col("failure_category") == "passed", F.lit(False))
    strict = passed & ~F.coalesce("removed_markdown_fence", F.lit(True))
    return rows.groupBy(F.coalesce("frozen", F.lit(False)).alias("frozen")).agg(
        F.count("*").alias("problems"), F.count(F.when(passed, 1)).alias("passed"), F.count(F.when(strict, 1)).alias("strict"),
        F.round(F.avg(passed.cast("int")), 6).alias("pass_rate"), F.round(F.avg(strict.cast("int")), 6).alias("strict_rate"),
    )


def comparison_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Datasets to compare: the first with each other, then neighbours."""
    names = read_table(spark, folder, "source_catalog").filter("source_name is not null").select("source_name").distinct()
    return joins.compared_pairs(names, ["source_name"], "source_name")


def quota_shortfall(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks of each dataset against a quota: whether it is met, and what is missing."""
    rows = read_table(spark, folder, "tasks").groupBy(F.col("source.dataset").alias("dataset")).agg(F.count("*").alias("tasks"))
    target = 100
    return rows.select("dataset", "tasks", (F.col("tasks") >= target).alias("target_met"), F.greatest(F.lit(0), target - F.col("tasks")).cast("long").alias("shortfall"))


def top_answer_likeness(spark: SparkSession, folder: str) -> DataFrame:
    """The 20 records whose answer is most like their statement; of equal ones those with the smallest id."""
    from recordloom.plans.texts import answer_likeness

    return answer_likeness(spark, folder).orderBy(F.desc("likeness"), "train_id").limit(20)


def training_gates(spark: SparkSession, folder: str) -> DataFrame:
    """One row of conditions that a training table must meet, each over all records."""
    rows = read_table(spark, folder, "training_records")
    attempts = read_table(spark, folder, "normalized_attempts").select("id", F.lit(True).alias("known")).distinct()
    joined = rows.join(attempts, rows.train_id == attempts.id, "left")
    every = lambda c: F.bool_and(F.coalesce(c, F.lit(False)))
    return aggregates.gates(joined, {
        "ids_unique": F.countDistinct("train_id") == F.count("*"),
        "ids_known": every(F.col("known")),
        "one_record_a_problem": F.countDistinct("problem_id") == F.count("*"),
        "numbers_contiguous": (F.min("record_no") == 0) & (F.max("record_no") == F.count("*") - 1),
        "texts_there": every(F.length(F.trim("task.problem_text")) > 0),
        "answers_there": every(F.length("response_text") > 0),
        "no_fences": every(~F.contains("response_text", F.lit(X.FENCE))),
        "all_stopped": every(F.col("finish_reason") == "stop"),
    })


def attempt_seconds(spark: SparkSession, folder: str) -> DataFrame:
    """Seconds from the collection of an attempt to its last verdict."""
    done = read_table(spark, folder, "verifier_results").groupBy("id").agg(F.max("verified_at").alias("done"))
    begun = read_table(spark, folder, "normalized_attempts").groupBy("id").agg(F.min("collected_at").alias("begun"))
    return begun.join(done, "id").select("id", F.timestamp_diff("MICROSECOND", "begun", "done").alias("micros"))


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of labels: the place of a positive value, -100 elsewhere."""
    v = read_table(spark, folder, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    return v.select("vec_id", F.transform("v", lambda x, i: F.when(x > 0, i).otherwise(F.lit(-100))).alias("labels"))


def trainable(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences that are not too long and have a label."""
    rows = _labels(spark, folder)
    kept = rows.filter((F.size("labels") <= 1024) & F.exists("labels", lambda x: x != -100))
    return kept.select("vec_id", F.size(F.filter("labels", lambda x: x != -100)).alias("labelled"))


def shifted_logprobs(spark: SparkSession, folder: str) -> DataFrame:
    """Sum of the log-probabilities of tokens that have one before them, each seen from that one: the first has none."""
    v = read_table(spark, folder, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: -F.abs(x)).alias("v"))
    shifted = F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))
    return v.select("vec_id", F.size(shifted).alias("tokens"), F.round(F.aggregate(shifted, F.lit(0.0), lambda a, x: a + x), 6).alias("logprob"))


def window_losses(spark: SparkSession, folder: str) -> DataFrame:
    """Mean of two losses and of their weighted sum per window of 100 steps."""
    rows = read_table(spark, folder, "events").select(F.floor(F.col("event_id") / 100).alias("window"), F.abs("value").alias("hard"), F.sqrt(F.abs("value")).alias("soft"))
    means = rows.groupBy("window").agg(F.avg("hard").alias("hard"), F.avg("soft").alias("soft"), F.avg(F.col("hard") + 10 * F.col("soft")).alias("total"))
    return means.select("window", *[F.round(c, 6).alias(c) for c in ("hard", "soft", "total")])


def rare_batches(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries that are the only one of their batch."""
    rows = read_table(spark, folder, "raw_deliveries").select("delivery_no", "batch_id")
    return alignment.single_occurrence(rows, ["batch_id"])


def clipped_texts(spark: SparkSession, folder: str) -> DataFrame:
    """The part of each text between two places, as its source declared its size."""
    touches, first, last = alignment.clipped(F.lit(0), F.col("n_chars"), F.lit(100), F.lit(2000))
    rows = read_table(spark, folder, "documents").filter("n_chars is not null").withColumns({"touches": touches, "part": last - first})
    return rows.groupBy("doc_kind").agg(F.count(F.when(F.col("touches"), 1)).alias("texts"), F.sum(F.when(F.col("touches"), F.col("part"))).alias("chars"))


def parsed_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Problem and number in the ids of deliveries, and the ids made of them anew."""
    problem, number = X.parse_attempt("delivery_key")
    rows = rank_deliveries(read_table(spark, folder, "raw_deliveries")).select("delivery_key", problem.alias("p"), number.alias("n"))
    again = X.attempt_id("p", "n") == F.col("delivery_key")
    return rows.groupBy(F.col("n").alias("attempt_number")).agg(
        F.count("*").alias("deliveries"), F.countDistinct("p").alias("problems"), F.count(F.when(again, 1)).alias("same"),
        F.countDistinct(X.short_id("delivery_key")).alias("short_ids"),
    )


def _landed(spark: SparkSession, folder: str) -> str:
    """The normal records as files of one JSON object a line, published once."""
    rows = read_table(spark, folder, "normalized_attempts").select(
        "id", "lang", "finish_reason", "response_text", F.struct(F.col("token_usage.completion_tokens")).alias("usage")
    )
    path = new_table_path(spark, "landed")
    sinks.publish_once(rows, path)
    return path


def landed_records(spark: SparkSession, folder: str) -> DataFrame:
    """Records written as JSON lines and scanned back, per end."""
    rows = jsonl.scan(spark, _landed(spark, folder), RECORD)
    return rows.groupBy("finish_reason").agg(
        F.count("*").alias("records"), F.count("lang").alias("with_lang"), F.sum(F.length("response_text")).alias("chars"), F.sum("usage.completion_tokens").alias("tokens")
    )


def landed_columns(spark: SparkSession, folder: str) -> DataFrame:
    """Two columns of landed records; the others are not parsed. A path that is not there adds nothing."""
    path = _landed(spark, folder)
    rows = jsonl.scan(spark, path, "id string, lang string").unionByName(jsonl.optional_scan(spark, path + "-none", "id string, lang string"))
    return rows.groupBy("lang").agg(F.count("*").alias("records"), F.countDistinct("id").alias("ids"))


def landed_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of landed files, and what publishing the same rows again says."""
    path = _landed(spark, folder)
    again = sinks.publish_once(jsonl.scan(spark, path, RECORD), path)
    return spark.range(1).select(F.lit(jsonl.count(spark, path)).cast("long").alias("lines"), F.lit(again).alias("again"))


def broken_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that are no objects, where texts without a language stand bare among the others."""
    rows = read_table(spark, folder, "documents").filter("text is not null")
    bare = F.concat(F.lit("text "), F.col("doc_id").cast("string"))
    path = new_table_path(spark, "lines")
    rows.select(F.when(F.col("lang").isNull(), bare).otherwise(F.to_json(F.struct("doc_id", "source"))).alias("value")).write.text(path)
    scanned = jsonl.scan(spark, path, "doc_id bigint, source string", strict=False).select("doc_id", "source", "_corrupt_record")
    return scanned.groupBy("source").agg(F.count("doc_id").alias("objects"), F.count("_corrupt_record").alias("broken"))


def versioned_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks as JSON lines, read by their version: those of the known one, and the others."""
    rows = read_table(spark, folder, "tasks").select("schema_version", "problem_id", "interface_type")
    path = new_table_path(spark, "tasks")
    sinks.publish_once(rows, path)
    version = "coding.task.multisource.v1"
    found = jsonl.dispatched(spark, path, {version: "problem_id string, interface_type string"})
    known = found[version].groupBy("interface_type").agg(F.count("problem_id").alias("tasks"))
    other = found[None].agg(F.lit("other versions").alias("interface_type"), F.count("*").alias("tasks"))
    return known.unionByName(other)


def split_publication(spark: SparkSession, folder: str) -> DataFrame:
    """Verdicts published in two tables at once, and the rows of each."""
    rows = read_table(spark, folder, "verifier_results").select("id", "failure_category").distinct()
    parts = {"passed": "failure_category = 'passed'", "failed": "NOT coalesce(failure_category = 'passed', false)"}
    counts = sinks.publish_split(rows, parts, new_table_path(spark, "split"))
    return spark.createDataFrame(list(counts.items()), "part string, records long")


def shard_names(spark: SparkSession, folder: str) -> DataFrame:
    """Statements in gzip shards of 100 records in order: name and rows of each file."""
    rows = read_table(spark, folder, "training_records").select("record_no", "train_id", F.col("task.problem_text").alias("problem_text"))
    shards = sinks.gzip_shards(rows, ["record_no"], new_table_path(spark, "shards").removeprefix("file://").removeprefix("file:"), 100)
    return shards.select("name", F.col("rows").cast("long").alias("records"))


def imported_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks brought into three foreign shapes and imported from them: tests that come through."""
    rows = read_table(spark, folder, "tasks").select("problem_id", "problem_text", "tests")
    ins, outs = F.transform("tests", lambda t: t["test_input"]), F.transform("tests", lambda t: t["test_output"])
    columns = rows.withColumn("input_output", F.to_json(F.struct(ins.alias("inputs"), outs.alias("outputs"))))
    groups = rows.withColumn("public", F.struct(ins.alias("input"), outs.alias("output")))
    pairs = F.transform("tests", lambda t: F.struct(t["test_input"].alias("input"), F.to_json(F.array(t["test_output"])).alias("output")))
    dictionary = rows.filter(F.size("tests") > 0).select("problem_id", pairs.alias("tests"))
    parts = [
        ("columns", tasks.from_json_columns(columns, "problem_id", "problem_text").select("problem_text", "tests")),
        ("groups", tasks.from_test_groups(groups, "problem_id", "problem_text", ["public"]).select("problem_text", "tests")),
        ("dictionary", tasks.with_dictionary(rows.drop("tests"), "problem_id", "problem_text", dictionary, "problem_id").select("problem_text", "tests")),
    ]
    united = tasks.union_in_order(parts)
    outputs = F.aggregate(F.transform("tests", lambda t: F.length(t["test_output"])), F.lit(0), lambda a, x: a + x)
    return united.groupBy("source_name").agg(
        F.count("*").alias("tasks"), F.count(F.when(tasks.usable(united), 1)).alias("usable"), F.sum(F.size("tests")).alias("tests"), F.sum(outputs).alias("output_chars")
    )


def rejected_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Why tasks cannot be used, counted."""
    rows = read_table(spark, folder, "tasks").select(F.col("problem_id").alias("source_row"), "problem_text", "tests")
    return tasks.rejected(rows).groupBy("reason").agg(F.count("*").alias("tasks"))


def prompt_sizes(spark: SparkSession, folder: str) -> DataFrame:
    """Characters of the prompts of tasks, by interface; a task without text has none."""
    rows = read_table(spark, folder, "tasks").filter("problem_text is not null and interface_type is not null")
    rows = rows.withColumn("m", tasks.messages("Solve the task.", F.col("problem_text"), F.col("interface_type")))
    size = F.aggregate("m", F.lit(0), lambda a, x: a + F.length(x["content"]))
    return rows.groupBy("interface_type").agg(F.count("*").alias("tasks"), F.sum(F.size("m")).alias("messages"), F.sum(size).alias("chars"))


def unique_tasks(spark: SparkSession, folder: str) -> DataFrame:
    """Tasks after a check that no problem occurs twice."""
    rows = joins.require_unique(read_table(spark, folder, "tasks").select("problem_id", "lang"), ["problem_id"])
    return rows.groupBy("lang").agg(F.count("*").alias("tasks"))


def dense_order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of orders numbered from 0 without gaps, after those sent back were dropped."""
    rows = read_table(spark, folder, "lineitem").filter("l_returnflag <> 'R'").select("l_orderkey", "l_linenumber")
    dense = alignment.dense_chunks(rows, "l_orderkey", "l_linenumber")
    return dense.groupBy("dense_chunk").agg(F.count("*").alias("lines"), F.sum("l_linenumber").alias("numbers"))


def spelled_bytes(spark: SparkSession, folder: str) -> DataFrame:
    """Texts spelled as bytes: whether the bytes are valid and spell the text again."""
    rows = read_table(spark, folder, "heldout_tasks").filter("entry_point is not null").select("heldout_id", "entry_point")
    codes = F.transform(F.split("entry_point", ""), lambda c: F.array(F.ascii(c)))
    return rows.select("heldout_id", F.forall(codes, bytes_valid).alias("valid"), bytes_match(codes, "entry_point").alias("spelled"))


QUERIES = {f.__name__: f for f in (
    slot_states, wave_plan, combined_accepted, usage_cost, resume_flags, verdict_ranking, score_subsets, comparison_pairs,
    quota_shortfall, top_answer_likeness, training_gates, attempt_seconds, trainable, shifted_logprobs, window_losses,
    rare_batches, clipped_texts, parsed_ids, landed_records, landed_columns, landed_lines, broken_lines, versioned_tasks,
    split_publication, shard_names, imported_shapes, rejected_tasks, prompt_sizes, unique_tasks, dense_order_lines, spelled_bytes,
)}

_FIRST = f"""{_ATTEMPTS}, firsts AS (
  SELECT problem_id, min(CASE WHEN failure_category = 'passed' THEN attempt_number END) AS first_pass, list(DISTINCT attempt_number) AS numbers
  FROM attempts GROUP BY 1)"""
_SLOTS = f"""slots AS (
  SELECT problem_id, n AS attempt_number FROM (SELECT DISTINCT problem_id FROM tasks WHERE problem_id IS NOT NULL), unnest(range(1, {MOST_ATTEMPTS + 1})) AS u(n))"""
_SUMS = "CAST(sum({}) AS BIGINT)"

ORACLES = {
    "slot_states": f"""WITH {_RANKED}, {_FIRST}, {_SLOTS}, there AS (SELECT DISTINCT delivery_key FROM ranked),
s AS (SELECT s.attempt_number, t.delivery_key IS NOT NULL AS there, coalesce(s.attempt_number > f.first_pass, false) AS late
  FROM slots s LEFT JOIN there t ON t.delivery_key = s.problem_id || '__attempt_' || s.attempt_number LEFT JOIN firsts f ON f.problem_id = s.problem_id)
SELECT CAST(attempt_number AS INTEGER) AS attempt_number, CASE WHEN there AND late THEN 'unused_after_pass' WHEN there THEN 'requested' WHEN late THEN 'not_requested_after_pass' ELSE 'pending' END AS state, count(*) AS slots
FROM s GROUP BY 1, 2""",
    "wave_plan": f"""WITH {_FIRST}, {_SLOTS},
w AS (SELECT s.attempt_number AS wave, f.first_pass, len(list_filter(coalesce(f.numbers, []), lambda n: n < s.attempt_number)) AS earlier FROM slots s LEFT JOIN firsts f ON f.problem_id = s.problem_id)
SELECT CAST(wave AS INTEGER) AS wave, count(*) AS problems, count(CASE WHEN earlier < wave - 1 THEN 1 END) AS lack_earlier_attempt FROM w WHERE first_pass IS NULL OR first_pass >= wave GROUP BY 1""",
    "combined_accepted": f"""WITH {_ATTEMPTS}, frozen AS (SELECT problem_id, min(train_id) AS frozen_id FROM training_records GROUP BY 1),
fresh AS (SELECT problem_id, min(struct_pack(n := attempt_number, id := id)).id AS fresh_id FROM attempts WHERE failure_category = 'passed' GROUP BY 1),
o AS (SELECT problem_id, min(selection_index) AS selection_index FROM tasks GROUP BY 1)
SELECT selection_index, o.problem_id, coalesce(frozen_id, fresh_id) AS accepted_id, frozen_id IS NULL AS fresh
FROM o LEFT JOIN frozen USING (problem_id) LEFT JOIN fresh USING (problem_id) WHERE coalesce(frozen_id, fresh_id) IS NOT NULL""",
    "usage_cost": f"""WITH r AS (SELECT id, any_value(task.source.dataset) AS dataset, any_value(token_usage) AS u FROM normalized_attempts GROUP BY id)
SELECT dataset, count(*) AS answers, round((sum(greatest(coalesce(u.prompt_tokens, 0), 0))::DOUBLE * {RATES[0]} + sum(greatest(coalesce(u.completion_tokens, 0), 0))::DOUBLE * {RATES[1]}) / 1e6, 6) AS cost FROM r GROUP BY 1""",
    "resume_flags": f"""WITH {_RANKED}, c AS (SELECT delivery_key, count(*) AS n FROM ranked GROUP BY 1), o AS (SELECT count(*) AS n FROM tasks WHERE source.original_id IS NOT NULL GROUP BY source.original_id)
SELECT count(*) AS completed_ids, CAST(sum(n - 1) AS BIGINT) AS duplicate_record_ids, max(n) <= 1 AS resume_safe, (SELECT CAST(sum(n - 1) AS BIGINT) FROM o) AS duplicate_original_tasks FROM c""",
    "verdict_ranking": """WITH v AS (SELECT DISTINCT id, failure_category FROM verifier_results), c AS (SELECT failure_category, count(*) AS attempts, min(id) AS seen FROM v GROUP BY 1)
SELECT failure_category, attempts, row_number() OVER (ORDER BY attempts DESC, seen, failure_category) AS place FROM c""",
    "score_subsets": """WITH v AS (SELECT DISTINCT id, failure_category, removed_markdown_fence FROM verifier_results),
f AS (SELECT DISTINCT id, task.problem_id AS problem_id FROM normalized_attempts WHERE task.attempt_number = 1), z AS (SELECT DISTINCT problem_id FROM training_records),
r AS (SELECT z.problem_id IS NOT NULL AS frozen, coalesce(failure_category = 'passed', false) AS p, coalesce(failure_category = 'passed', false) AND NOT coalesce(removed_markdown_fence, true) AS s
  FROM f JOIN v USING (id) LEFT JOIN z ON z.problem_id = f.problem_id)
SELECT frozen, count(*) AS problems, count(CASE WHEN p THEN 1 END) AS passed, count(CASE WHEN s THEN 1 END) AS strict, round(avg(p::INT), 6) AS pass_rate, round(avg(s::INT), 6) AS strict_rate FROM r GROUP BY 1""",
    "comparison_pairs": """WITH n AS (SELECT source_name, row_number() OVER (ORDER BY source_name) - 1 AS place FROM (SELECT DISTINCT source_name FROM source_catalog WHERE source_name IS NOT NULL))
SELECT a.source_name AS base, b.source_name AS candidate, 'first' AS comparison FROM n a JOIN n b ON a.place = 0 AND b.place > 0
UNION ALL SELECT a.source_name, b.source_name, 'adjacent' FROM n a JOIN n b ON b.place = a.place + 1 AND b.place > 1""",
    "quota_shortfall": "SELECT source.dataset AS dataset, count(*) AS tasks, count(*) >= 100 AS target_met, CAST(greatest(0, 100 - count(*)) AS BIGINT) AS shortfall FROM tasks GROUP BY 1",
    "training_gates": """WITH a AS (SELECT DISTINCT id FROM normalized_attempts), g AS (
SELECT count(DISTINCT train_id) = count(*) AS ids_unique, bool_and(a.id IS NOT NULL) AS ids_known, count(DISTINCT problem_id) = count(*) AS one_record_a_problem,
  min(record_no) = 0 AND max(record_no) = count(*) - 1 AS numbers_contiguous, bool_and(coalesce(length(trim(task.problem_text)) > 0, false)) AS texts_there,
  bool_and(coalesce(length(response_text) > 0, false)) AS answers_there, bool_and(coalesce(NOT contains(response_text, '```'), false)) AS no_fences,
  bool_and(coalesce(finish_reason = 'stop', false)) AS all_stopped FROM training_records t LEFT JOIN a ON a.id = t.train_id)
SELECT *, ids_unique AND ids_known AND one_record_a_problem AND numbers_contiguous AND texts_there AND answers_there AND no_fences AND all_stopped AS all_hold FROM g""",
    "attempt_seconds": """SELECT id, epoch_us(done) - epoch_us(begun) AS micros FROM (SELECT id, min(collected_at) AS begun FROM normalized_attempts GROUP BY 1) JOIN (SELECT id, max(verified_at) AS done FROM verifier_results GROUP BY 1) USING (id)""",
    "trainable": """SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x > 0)) AS INTEGER) AS labelled FROM embeddings WHERE len(embedding) <= 1024 AND len(list_filter(embedding, lambda x: x > 0)) > 0""",
    "shifted_logprobs": """SELECT vec_id, CAST(greatest(len(embedding) - 1, 0) AS INTEGER) AS tokens, round(coalesce(list_sum(list_transform(embedding[2:], lambda x: -abs(x::DOUBLE))), 0), 6) AS logprob FROM embeddings""",
    "window_losses": """SELECT CAST(event_id // 100 AS BIGINT) AS "window", round(avg(abs(value)), 6) AS hard, round(avg(sqrt(abs(value))), 6) AS soft, round(avg(abs(value) + 10 * sqrt(abs(value))), 6) AS total FROM events GROUP BY 1""",
    "rare_batches": "SELECT delivery_no, batch_id FROM raw_deliveries WHERE batch_id IN (SELECT batch_id FROM raw_deliveries GROUP BY 1 HAVING count(*) = 1)",
    "clipped_texts": """SELECT doc_kind, count(CASE WHEN n_chars > 100 THEN 1 END) AS texts, CAST(sum(CASE WHEN n_chars > 100 THEN least(n_chars, 2000) - 100 END) AS BIGINT) AS chars FROM documents WHERE n_chars IS NOT NULL GROUP BY 1""",
    "parsed_ids": rf"""WITH {_RANKED}, p AS (SELECT delivery_key, nullif(regexp_extract(delivery_key, '{X.ATTEMPT}', 1), '') AS p, try_cast(nullif(regexp_extract(delivery_key, '{X.ATTEMPT}', 2), '') AS INTEGER) AS n FROM ranked)
SELECT n AS attempt_number, count(*) AS deliveries, count(DISTINCT p) AS problems, count(CASE WHEN p || '__attempt_' || n = delivery_key THEN 1 END) AS same, count(DISTINCT left(sha256(delivery_key), 20)) AS short_ids FROM (
  SELECT * FROM p UNION ALL SELECT NULL, NULL, NULL FROM raw_deliveries WHERE id IS NULL) GROUP BY 1""",
    "landed_records": "SELECT finish_reason, count(*) AS records, count(lang) AS with_lang, CAST(sum(length(response_text)) AS BIGINT) AS chars, CAST(sum(token_usage.completion_tokens) AS BIGINT) AS tokens FROM normalized_attempts GROUP BY 1",
    "landed_columns": "SELECT lang, count(*) AS records, count(DISTINCT id) AS ids FROM normalized_attempts GROUP BY 1",
    "landed_lines": "SELECT count(*) AS lines, 'unchanged' AS again FROM normalized_attempts",
    "broken_lines": "SELECT CASE WHEN lang IS NOT NULL THEN source END AS source, count(CASE WHEN lang IS NOT NULL THEN doc_id END) AS objects, count(CASE WHEN lang IS NULL THEN 1 END) AS broken FROM documents WHERE text IS NOT NULL GROUP BY 1",
    "versioned_tasks": """SELECT interface_type, count(*) AS tasks FROM tasks WHERE schema_version = 'coding.task.multisource.v1' GROUP BY 1
UNION ALL SELECT 'other versions', count(CASE WHEN schema_version IS DISTINCT FROM 'coding.task.multisource.v1' THEN 1 END) FROM tasks""",
    "split_publication": """WITH v AS (SELECT DISTINCT id, failure_category FROM verifier_results)
SELECT 'passed' AS part, count(CASE WHEN failure_category = 'passed' THEN 1 END) AS records FROM v UNION ALL SELECT 'failed', count(CASE WHEN NOT coalesce(failure_category = 'passed', false) THEN 1 END) FROM v""",
    "shard_names": """WITH n AS (SELECT (row_number() OVER (ORDER BY record_no) - 1) // 100 AS k, ceil(count(*) OVER () / 100)::BIGINT AS shards FROM training_records)
SELECT 'train-' || lpad(k::VARCHAR, 5, '0') || '-of-' || lpad(shards::VARCHAR, 5, '0') || '.jsonl.gz' AS name, count(*) AS records FROM n GROUP BY k, shards""",
    "imported_shapes": """WITH t AS (SELECT problem_text, tests, coalesce(length(trim(problem_text, ' ')) > 0 AND len(tests) > 0, false) AS ok,
    list_sum(list_transform(tests, lambda x: length(x.test_output))) AS chars FROM tasks),
s AS (SELECT 'columns' AS source_name, * FROM t UNION ALL SELECT 'groups', * FROM t UNION ALL SELECT 'dictionary', * FROM t WHERE len(tests) > 0)
SELECT source_name, count(*) AS tasks, count(CASE WHEN ok THEN 1 END) AS usable, CAST(sum(len(tests)) AS BIGINT) AS tests, CAST(sum(chars) AS BIGINT) AS output_chars FROM s GROUP BY 1""",
    "rejected_tasks": """WITH r AS (SELECT CASE WHEN coalesce(length(trim(problem_text, ' ')), 0) = 0 THEN 'no text' WHEN tests IS NULL THEN 'tests do not pair' WHEN len(tests) = 0 THEN 'no tests' END AS reason FROM tasks)
SELECT reason, count(*) AS tasks FROM r WHERE reason IS NOT NULL GROUP BY 1""",
    "prompt_sizes": """SELECT interface_type, count(*) AS tasks, 2 * count(*) AS messages, CAST(sum(length('Solve the task.') + length(problem_text || chr(10) || chr(10) || 'Interface: ' || interface_type)) AS BIGINT) AS chars
FROM tasks WHERE problem_text IS NOT NULL AND interface_type IS NOT NULL GROUP BY 1""",
    "unique_tasks": "SELECT lang, count(*) AS tasks FROM tasks GROUP BY 1",
    "dense_order_lines": """SELECT CAST(d AS INTEGER) AS dense_chunk, count(*) AS lines, CAST(sum(l_linenumber) AS BIGINT) AS numbers FROM (
  SELECT l_linenumber, dense_rank() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1 AS d FROM lineitem WHERE l_returnflag <> 'R') GROUP BY 1""",
    "spelled_bytes": "SELECT heldout_id, true AS valid, true AS spelled FROM heldout_tasks WHERE entry_point IS NOT NULL",
}
_TOP = "SELECT * FROM ({}) ORDER BY likeness DESC, train_id LIMIT 20"
