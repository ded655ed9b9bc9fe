"""Queries on text and program text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.functions import text as X
from recordloom.functions.code import assertion_structures, comment_counts, first_function, normalised_assertions, source_facts
from recordloom.operators import aggregates, records, similarity
from recordloom.plans.selection import HELDOUT, _words
from recordloom.operators import joins
from recordloom.session import read_table


def heldout_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "heldout_tasks")
    return rows.select("heldout_id", X.fingerprint(X.prompt_body("prompt")).alias("words"), X.numeric_id("heldout_id").alias("number"))


def statement_containment(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold all words of a held-out statement in a row."""
    return similarity.containment(
        read_table(spark, folder, "documents"), read_table(spark, folder, "heldout_tasks"), "doc_id", "text", "heldout_id", X.prompt_body("prompt")
    )


def common_openings(spark: SparkSession, folder: str) -> DataFrame:
    """First five words that training and held-out statements share, with how many of each."""
    count = lambda rows, text, name: rows.select(X.first_words(text).alias("opening")).filter(F.length("opening") > 0).groupBy("opening").agg(F.count("*").alias(name))
    a = count(read_table(spark, folder, "training_records"), F.col("task.problem_text"), "training")
    b = count(read_table(spark, folder, "heldout_tasks"), X.prompt_body("prompt"), "heldout")
    return a.join(b, "opening")


def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    parts = {
        "tasks": read_table(spark, folder, "tasks").select(F.col("problem_text").alias("t")),
        "heldout": read_table(spark, folder, "heldout_tasks").select(F.col("prompt").alias("t")),
        "documents": read_table(spark, folder, "documents").select(F.col("text").alias("t")),
    }
    rows = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("source"), F.size(X.words("t")).alias("words")).filter("t is not null")
        rows = part if rows is None else rows.unionByName(part)
    return aggregates.interpolated(rows, ["source"], "words")


def response_style(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "normalized_attempts").filter("response_text is not null").select("finish_reason", X.style("response_text").alias("s"))
    return rows.groupBy("finish_reason").agg(
        F.count("*").alias("answers"), *[F.sum(f"s.{c}").alias(c) for c in ("chars", "bytes", "lines", "nonempty_lines", "comment_lines", "fences")]
    )


def response_endings(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "normalized_attempts").filter(F.length("response_text") > 0)
    e = X.ending("response_text")
    return rows.groupBy(e["last_char"].alias("last_char"), e["newline"].alias("newline"), e["white_space"].alias("white_space")).agg(F.count("*").alias("answers"))


def unwrapped_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Answers that are one fenced block, and their characters without the fence."""
    rows = read_table(spark, folder, "normalized_attempts").filter("response_text is not null")
    inner = X.unwrap_fence("response_text")
    return rows.groupBy("finish_reason").agg(
        F.count("*").alias("answers"), F.count(F.when(inner != F.col("response_text"), 1)).alias("unwrapped"), F.sum(F.length(inner)).alias("chars")
    )


def byte_lengths(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "documents").filter("text is not null")
    return rows.groupBy("lang").agg(
        F.count("*").alias("texts"), F.sum(F.length("text")).alias("chars"), F.sum(F.octet_length("text")).alias("bytes"),
        F.count(F.when(F.col("n_chars") != F.length("text"), 1)).alias("wrong_n_chars"),
    )


def private_strings(spark: SparkSession, folder: str) -> DataFrame:
    """Local paths and access keys in documents, per source."""
    clean, found = X.redact_paths("text")
    rows = read_table(spark, folder, "documents").filter("text is not null")
    return rows.groupBy("source").agg(
        F.count("*").alias("texts"), F.sum(found).cast("long").alias("paths"),
        F.count(F.when(X.has_access_key("text"), 1)).alias("with_keys"), F.sum(F.length(clean)).alias("clean_chars"),
    )


def answer_likeness(spark: SparkSession, folder: str) -> DataFrame:
    """How alike statement and answer of a record are, in character 5-grams."""
    rows = read_table(spark, folder, "training_records").filter("task.problem_text is not null and response_text is not null")
    return rows.select("train_id", F.round(X.gram_likeness("task.problem_text", "response_text"), 6).alias("likeness"))


def nearest_training_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Most alike training statement of each held-out one, by three measures."""
    return similarity.nearest_texts(
        read_table(spark, folder, "training_records"), read_table(spark, folder, "heldout_tasks"),
        "train_id", F.col("task.problem_text"), "heldout_id", X.prompt_body("prompt"),
    )


def likeness_histogram(spark: SparkSession, folder: str) -> DataFrame:
    best = nearest_training_texts(spark, folder)
    step = F.floor(F.col("gram_jaccard") * 10) / 10
    return best.groupBy(step.alias("at_least")).agg(F.count("*").alias("items"), F.sum((F.col("same_texts") > 0).cast("long")).alias("same"))


def difficulty_names(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "tasks").groupBy(X.name_key("difficulty").alias("difficulty")).agg(F.count("*").alias("tasks"))


def test_outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Expected outputs with one kind of line end."""
    rows = read_table(spark, folder, "tasks").select("problem_id", F.explode("tests").alias("t"))
    out = X.unix_lines("t.test_output")
    return rows.groupBy("problem_id").agg(
        F.count("*").alias("tests"), F.count(F.when(F.contains("t.test_output", F.lit("\r")), 1)).alias("with_returns"),
        F.sum(F.length(out)).alias("chars"), F.countDistinct(out).alias("different"),
    )


def bounded_texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "documents").filter("text is not null")
    cut = X.bounded("text", 1000)
    return rows.groupBy("doc_kind").agg(F.count("*").alias("texts"), F.count(F.when(cut != F.col("text"), 1)).alias("cut"), F.sum(F.length(cut)).alias("chars"))


def text_issues(spark: SparkSession, folder: str) -> DataFrame:
    """Broken rules of normal records, counted."""
    rows = read_table(spark, folder, "normalized_attempts")
    found = records.issues(rows, "id", {
        "no text": F.coalesce(F.length(F.trim("response_text")), F.lit(0)) == 0,
        "no end": F.col("finish_reason").isNull(),
        "no usage": F.coalesce(F.col("token_usage.completion_tokens"), F.lit(0)) <= 0,
        "no dataset": F.col("task.source.dataset").isNull(),
        "bytes differ": ~F.col("validation.content_bytes_match"),
        "total differs": F.col("token_usage.prompt_tokens") + F.col("token_usage.completion_tokens") != F.col("token_usage.total_tokens"),
    })
    return found.groupBy("issue").agg(F.count("*").alias("records"))


def released_records(spark: SparkSession, folder: str) -> DataFrame:
    """Allowed columns of training records, with paths replaced."""
    return records.released(read_table(spark, folder, "training_records"), ["train_id", "problem_id", "task.lang", "response_text"], ["response_text"])


def program_facts(spark: SparkSession, folder: str) -> DataFrame:
    """What the answers' programs hold, counted over all answers."""
    rows = read_table(spark, folder, "normalized_attempts").filter("response_text is not null")
    code = X.unwrap_fence("response_text")
    found = rows.select(source_facts(code).alias("f"), comment_counts(code).alias("c"), first_function(code).alias("d"))
    return found.groupBy("f.parses").agg(
        F.count("*").alias("answers"), *[F.sum(F.col(f"f.{c}").cast("long")).alias(c) for c in ("docstring", "loose_string", "top_assert", "forbidden_call", "forbidden_import")],
        F.sum("c.comment_tokens").alias("comment_tokens"), F.count("d.name").alias("with_function"),
    )


def assertion_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Forms of the held-out assertions, and how many different assertions have each."""
    rows = read_table(spark, folder, "heldout_tasks")
    pairs = F.arrays_zip(assertion_structures("assertion_text", "entry_point").alias("form"), normalised_assertions("assertion_text", "entry_point").alias("text"))
    listed = rows.select(F.explode(pairs).alias("p"))
    return listed.groupBy(F.col("p.form").alias("form")).agg(F.count("*").alias("assertions"), F.countDistinct("p.text").alias("different"))


def assertion_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Assertions of test items that stand, in one layout, among those of validation items: the first such item."""
    rows = read_table(spark, folder, "heldout_tasks").filter("assertion_text is not null")
    asserted = rows.select("split", "heldout_id", normalised_assertions("assertion_text", "entry_point").alias("a"))
    side = lambda s: asserted.filter(F.col("split") == s).select("heldout_id", F.posexplode("a").alias("n", "assertion"))
    return joins.first_matches(side("validation"), side("test"), "heldout_id", "assertion")


def assertion_likeness(spark: SparkSession, folder: str) -> DataFrame:
    """Likeness of the assertion structures of validation and test items, by class of equal structures."""
    rows = read_table(spark, folder, "heldout_tasks").filter("assertion_text is not null")
    shaped = rows.select("split", "heldout_id", assertion_structures("assertion_text", "entry_point").alias("s"))
    side = lambda s: shaped.filter(F.col("split") == s)
    return joins.set_likeness(side("validation"), side("test"), "heldout_id", "s")


def exact_fingerprint_check(spark: SparkSession, folder: str) -> DataFrame:
    """Texts for which the native fingerprint is not the exact one, per language."""
    rows = read_table(spark, folder, "documents").filter("text is not null")
    same = X.fingerprint("text") == X.exact_fingerprint("text")
    return rows.groupBy("lang").agg(F.count("*").alias("texts"), F.sum((~same).cast("long")).alias("differ"))


def parsed_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Numbers in a JSON column, per kind of event; rows that do not parse are counted."""
    rows = read_table(spark, folder, "events").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint").alias("k"))
    return rows.groupBy("event_type").agg(F.count("*").alias("events"), F.count("k").alias("parsed"), F.sum("k").alias("total"))


QUERIES = {f.__name__: f for f in (
    heldout_fingerprints, statement_containment, common_openings, word_counts, response_style, response_endings,
    unwrapped_answers, byte_lengths, private_strings, answer_likeness, nearest_training_texts, likeness_histogram,
    difficulty_names, test_outputs, bounded_texts, text_issues, released_records, program_facts, assertion_forms,
    assertion_matches, assertion_likeness,
    exact_fingerprint_check, parsed_properties,
)}

_GRAMS = "list_distinct(list_transform(range(1, greatest(1, length({t}) - 4) + 1), lambda i: substring({t}, i, 5)))"
_PATH = r"(^|[^A-Za-z0-9/])/(?:[rR][oO][oO][tT]|[hH][oO][mM][eE])/[^\s\"'']+"
_USERS = r"[A-Za-z]:\\[uU][sS][eE][rR][sS]\\[^\s\"'']+"
_KEY = r"(?i)(?:\bsk[-_][a-z0-9_-]{12,}|\bhf_[a-z0-9]{12,}|bearer\s+[a-z0-9._~+/-]{12,})"
#: Without a look-behind the character before a path is taken along and put back.
_CLEAN = f"regexp_replace(regexp_replace({{t}}, '{_PATH}', '\\1<path>', 'g'), '{_USERS}', '<path>', 'g')"
_PATHS = f"len(regexp_extract_all({{t}}, '{_PATH}')) + len(regexp_extract_all({{t}}, '{_USERS}'))"

ORACLES = {
    "heldout_fingerprints": rf"WITH {HELDOUT} SELECT heldout_id, {_words('body')} AS words, try_cast(nullif(regexp_extract(heldout_id, '(\d+)', 1), '') AS BIGINT) AS number FROM held",
    "statement_containment": f"""WITH {HELDOUT}, h AS (SELECT heldout_id, ' ' || {_words('body')} || ' ' AS needle FROM held),
d AS (SELECT doc_id, ' ' || {_words('text')} || ' ' AS hay FROM documents WHERE text IS NOT NULL)
SELECT doc_id AS row_id, heldout_id AS item_id FROM d, h WHERE length(needle) > 2 AND contains(hay, needle)""",
    "common_openings": f"""WITH {HELDOUT}, a AS (SELECT array_to_string((string_split({_words('task.problem_text')}, ' '))[1:5], ' ') AS opening FROM training_records WHERE task.problem_text IS NOT NULL),
b AS (SELECT array_to_string((string_split({_words('body')}, ' '))[1:5], ' ') AS opening FROM held)
SELECT x.opening, training, heldout FROM (SELECT opening, count(*) AS training FROM a WHERE opening <> '' GROUP BY 1) x
JOIN (SELECT opening, count(*) AS heldout FROM b WHERE opening <> '' GROUP BY 1) y ON x.opening = y.opening""",
    "word_counts": r"""WITH t AS (SELECT 'tasks' AS source, problem_text AS t FROM tasks UNION ALL SELECT 'heldout', prompt FROM heldout_tasks UNION ALL SELECT 'documents', text FROM documents),
w AS (SELECT source, CAST(len(regexp_extract_all(regexp_replace(lower(t), 'ß', 'ss', 'g'), '[\p{L}\p{N}_]+')) AS INTEGER) AS words FROM t WHERE t IS NOT NULL)
SELECT source, count(*) AS n, min(words) AS min, max(words) AS max, round(median(words), 6) AS median, round(quantile_cont(words, 0.95), 6) AS p95 FROM w GROUP BY 1""",
    "response_style": r"""WITH t AS (SELECT finish_reason, response_text AS t, string_split(response_text, chr(10)) AS l FROM normalized_attempts WHERE response_text IS NOT NULL)
SELECT finish_reason, count(*) AS answers, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(sum(octet_length(encode(t))) AS BIGINT) AS bytes, CAST(sum(len(l)) AS BIGINT) AS lines,
  CAST(sum(len(list_filter(l, lambda x: trim(x) <> ''))) AS BIGINT) AS nonempty_lines, CAST(sum(len(list_filter(l, lambda x: regexp_matches(x, '^\s*#')))) AS BIGINT) AS comment_lines,
  CAST(sum(len(regexp_extract_all(t, '```'))) AS BIGINT) AS fences FROM t GROUP BY 1""",
    "response_endings": r"""SELECT right(response_text, 1) AS last_char, ends_with(response_text, chr(10)) AS newline, regexp_matches(right(response_text, 1), '\s') AS white_space, count(*) AS answers
FROM normalized_attempts WHERE length(response_text) > 0 GROUP BY 1, 2, 3""",
    "unwrapped_answers": r"""WITH t AS (SELECT finish_reason, response_text AS t, trim(response_text, ' ') AS c FROM normalized_attempts WHERE response_text IS NOT NULL),
u AS (SELECT finish_reason, t, CASE WHEN len(regexp_extract_all(c, '```')) = 2 AND regexp_matches(c, '(?s)^```[A-Za-z0-9_+-]*[ \t]*\n.*```$')
  THEN regexp_extract(c, '(?s)^```[A-Za-z0-9_+-]*[ \t]*\n(.*?)\n?```$', 1) ELSE t END AS i FROM t)
SELECT finish_reason, count(*) AS answers, count(CASE WHEN i <> t THEN 1 END) AS unwrapped, CAST(sum(length(i)) AS BIGINT) AS chars FROM u GROUP BY 1""",
    "byte_lengths": """SELECT lang, count(*) AS texts, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes,
  count(CASE WHEN n_chars <> length(text) THEN 1 END) AS wrong_n_chars FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "private_strings": f"""SELECT source, count(*) AS texts, CAST(sum({_PATHS.format(t='text')}) AS BIGINT) AS paths,
  count(CASE WHEN regexp_matches(text, '{_KEY}') THEN 1 END) AS with_keys, CAST(sum(length({_CLEAN.format(t='text')})) AS BIGINT) AS clean_chars
FROM documents WHERE text IS NOT NULL GROUP BY 1""",
    "answer_likeness": f"""WITH g AS (SELECT train_id, {_GRAMS.format(t='p')} AS a, {_GRAMS.format(t='r')} AS b
  FROM (SELECT train_id, task.problem_text AS p, response_text AS r FROM training_records) WHERE p IS NOT NULL AND r IS NOT NULL)
SELECT train_id, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b)))::DOUBLE, 6) AS likeness FROM g""",
    "difficulty_names": "SELECT replace(replace(upper(trim(difficulty)), '-', '_'), ' ', '_') AS difficulty, count(*) AS tasks FROM tasks GROUP BY 1",
    "test_outputs": r"""WITH t AS (SELECT problem_id, unnest(tests).test_output AS o FROM tasks),
n AS (SELECT problem_id, o, regexp_replace(regexp_replace(o, '\r\n?', chr(10), 'g'), '^\s+|\s+$', '', 'g') AS out FROM t)
SELECT problem_id, count(*) AS tests, count(CASE WHEN contains(o, chr(13)) THEN 1 END) AS with_returns, CAST(sum(length(out)) AS BIGINT) AS chars, count(DISTINCT out) AS different FROM n GROUP BY 1""",
    "bounded_texts": r"""WITH t AS (SELECT doc_kind, text, CASE WHEN length(text) > 1000 THEN left(text, 1000) || chr(10) || '[cut]' ELSE text END AS c FROM documents WHERE text IS NOT NULL)
SELECT doc_kind, count(*) AS texts, count(CASE WHEN c <> text THEN 1 END) AS cut, CAST(sum(length(c)) AS BIGINT) AS chars FROM t GROUP BY 1""",
    "text_issues": """WITH i AS (SELECT unnest(list_filter([
  CASE WHEN coalesce(length(trim(response_text)), 0) = 0 THEN 'no text' END, CASE WHEN finish_reason IS NULL THEN 'no end' END,
  CASE WHEN coalesce(token_usage.completion_tokens, 0) <= 0 THEN 'no usage' END, CASE WHEN task.source.dataset IS NULL THEN 'no dataset' END,
  CASE WHEN NOT validation.content_bytes_match THEN 'bytes differ' END,
  CASE WHEN token_usage.prompt_tokens + token_usage.completion_tokens <> token_usage.total_tokens THEN 'total differs' END], lambda x: x IS NOT NULL)) AS issue FROM normalized_attempts)
SELECT issue, count(*) AS records FROM i GROUP BY 1""",
    "released_records": f"""SELECT train_id, problem_id, task.lang AS lang, {_CLEAN.format(t='response_text')} AS response_text,
  CAST(coalesce({_PATHS.format(t='response_text')}, 0) AS INTEGER) AS redactions FROM training_records""",
    "parsed_properties": """WITH t AS (SELECT event_type, try_cast(CASE WHEN json_valid(props) THEN json_extract_string(props, '$.k') END AS BIGINT) AS k FROM events)
SELECT event_type, count(*) AS events, count(k) AS parsed, CAST(sum(k) AS BIGINT) AS total FROM t GROUP BY 1""",
}
