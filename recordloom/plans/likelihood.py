"""Queries on sequences of numbers: chunks, divergences, alignment of two tokenisations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from recordloom.functions import numeric as N
from recordloom.operators import aggregates, alignment, records
from recordloom.session import read_table

CHUNK, CANDIDATES = 8, 5


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))


def chunk_logprobs(spark: SparkSession, folder: str) -> DataFrame:
    """Sums of log-probabilities over chunks of a sequence."""
    tokens = _vectors(spark, folder).select("vec_id", F.posexplode("v").alias("position", "x"))
    tokens = tokens.select("vec_id", F.floor(F.col("position") / CHUNK).cast("int").alias("chunk"), (-F.abs("x")).alias("logprob"))
    sums = alignment.chunk_sums(tokens, "vec_id", "chunk", "logprob")
    return sums.select("vec_id", "chunk", F.round("chunk_logprob", 6).alias("chunk_logprob"), "tokens")


def chunk_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Mean divergence of the chunks of a sequence from those of the next one of its label."""
    sums = chunk_logprobs(spark, folder)
    order = Window.partitionBy("label").orderBy("vec_id")
    pairs = _vectors(spark, folder).select("vec_id", "label", F.lead("vec_id").over(order).alias("next_id")).filter("next_id is not null")
    a = sums.select("vec_id", "chunk", F.col("chunk_logprob").alias("p"))
    b = sums.select(F.col("vec_id").alias("next_id"), "chunk", F.col("chunk_logprob").alias("q"))
    kl = N.bernoulli_kl(F.col("p"), F.col("q"), temperature=10.0)
    return pairs.join(a, "vec_id").join(b, ["next_id", "chunk"]).groupBy("vec_id").agg(
        F.round(F.sum(kl) / F.greatest(F.count("*"), F.lit(1)), 8).alias("divergence"), F.count("*").alias("chunks")
    )


def sparse_divergence(spark: SparkSession, folder: str) -> DataFrame:
    """Divergence of the first candidates of a sequence from the next one's, with one bucket for the rest."""
    order = Window.partitionBy("label").orderBy("vec_id")
    rows = _vectors(spark, folder).withColumn("next", F.lead("v").over(order)).filter("next is not null")
    log_p, log_q = N.log_softmax(F.col("v")), N.log_softmax(F.col("next"))
    kl = N.sparse_kl(F.slice(log_p, 1, CANDIDATES), F.slice(log_q, 1, CANDIDATES))
    return rows.select("vec_id", F.round(kl, 8).alias("divergence"))


def candidate_mass(spark: SparkSession, folder: str) -> DataFrame:
    """Mass of the most likely candidates."""
    logs = records.sorted_candidates(N.log_softmax(F.col("v")), CANDIDATES)
    return _vectors(spark, folder).select("vec_id", F.round(N.mass(logs), 8).alias("mass"), F.round(F.element_at(logs, 1), 8).alias("best"))


def padded_widths(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of positive values filled up to the width of their label's batch, a multiple of 8."""
    rows = _vectors(spark, folder).withColumn("v", F.filter("v", lambda x: x > 0))
    widths = rows.groupBy("label").agg(N.round_up(F.max(F.size("v")), 8).alias("width"))
    filled = rows.join(widths, "label").withColumn("filled", N.padded("v", F.col("width"), F.lit(0.0)))
    return filled.groupBy("label").agg(
        F.count("*").alias("rows"), F.max("width").alias("width"), F.sum(F.size("filled")).alias("cells"), F.sum(F.size("v")).alias("values")
    )


def _tokens(rows: DataFrame, lengths) -> DataFrame:
    """``id, position, start_byte, end_byte`` of the pieces of a text; ends are summed per record."""
    listed = rows.select("id", F.posexplode(lengths).alias("position", "n"))
    running = Window.partitionBy("id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    return listed.select("id", "position", F.sum("n").over(running).alias("end_byte"), "n").select(
        "id", "position", (F.col("end_byte") - F.col("n")).alias("start_byte"), "end_byte"
    )


def _answers(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "normalized_attempts").filter("length(response_text) > 0").select("id", "response_text").dropDuplicates(["id"])


def alignment_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """Shapes of the chunks that words and pieces of four bytes have in common, over all answers."""
    rows = read_table(spark, folder, "normalized_attempts").filter("id is not null and length(response_text) > 0")
    # Counted before repeated ids are dropped, so the exchange has numbers and no texts.
    return alignment.shape_totals(alignment.shape_counts(rows, "id", "response_text", 4).dropDuplicates(["id"]))


def token_contiguity(spark: SparkSession, folder: str) -> DataFrame:
    """Whether the words of an answer cover it byte by byte."""
    rows = _answers(spark, folder)
    cover = alignment.contiguous(_tokens(rows, alignment.word_lengths(F.col("response_text"))), "id")
    return cover.join(rows.select("id", F.octet_length("response_text").alias("size")), "id").groupBy("contiguous").agg(
        F.count("*").alias("answers"), F.sum((F.col("bytes") == F.col("size")).cast("long")).alias("whole")
    )


def label_ends(spark: SparkSession, folder: str) -> DataFrame:
    """Audit of label sequences: values above zero are labelled, and the last position is the end token 1."""
    ints = F.transform("v", lambda x: F.round(x * 100).cast("int"))
    rows = _vectors(spark, folder).select("vec_id", ints.alias("t"))
    positions = F.transform("t", lambda x, i: F.when(i == F.size("t") - 1, F.lit(1)).otherwise(x))
    keep, ends = F.transform("t", lambda x: x > 1), F.transform("t", lambda x, i: i == F.size("t") - 1)
    audit = alignment.end_audit(alignment.end_labels(positions, keep, ends), F.lit(1))
    return rows.select("vec_id", audit.alias("a")).select("vec_id", "a.labelled", "a.ends", "a.ends_last")


def user_epochs(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user as steps of a run: epochs of 10 steps, with the run's first and last steps."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = read_table(spark, folder, "events").select("user_id", F.row_number().over(by).alias("step"), F.round("value", 2).cast("double").alias("value"))
    return aggregates.steps_report(rows, "user_id", "step", F.col("step") / 10, "value")


QUERIES = {f.__name__: f for f in (
    chunk_logprobs, chunk_divergence, sparse_divergence, candidate_mass, padded_widths, alignment_shapes, token_contiguity,
    label_ends, user_epochs,
)}

_CHUNKS = f"""chunks AS (SELECT vec_id, CAST(floor(position / {CHUNK}) AS INTEGER) AS chunk, round(sum(-abs(x)), 6) AS chunk_logprob, count(*) AS tokens FROM (
  SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS position FROM embeddings) GROUP BY 1, 2)"""
_LSM = """list_transform({v}, lambda x: x::DOUBLE - {m} - ln(list_sum(list_transform({v}, lambda y: exp(y::DOUBLE - {m})))))"""
_TOKENS = r"""a AS (SELECT id, any_value(response_text) AS t FROM normalized_attempts WHERE length(response_text) > 0 GROUP BY id),
l0 AS (SELECT id, unnest(regexp_extract_all(t, '(\s*\S+|\s+$)')) AS w, generate_subscripts(regexp_extract_all(t, '(\s*\S+|\s+$)'), 1) AS position FROM a),
l AS (SELECT id, position, sum(octet_length(encode(w))) OVER (PARTITION BY id ORDER BY position) AS e FROM l0)"""

ORACLES = {
    "chunk_logprobs": f"WITH {_CHUNKS} SELECT * FROM chunks",
    "chunk_divergence": f"""WITH {_CHUNKS}, pairs AS (SELECT vec_id, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS next_id FROM embeddings),
x AS (SELECT p.vec_id, least(a.chunk_logprob / 10, -1e-6) AS p, least(b.chunk_logprob / 10, -1e-6) AS q FROM pairs p JOIN chunks a ON a.vec_id = p.vec_id JOIN chunks b ON b.vec_id = p.next_id AND b.chunk = a.chunk)
SELECT vec_id, round(sum(exp(p) * (p - q) + (1 - exp(p)) * (ln(1 - exp(p)) - ln(1 - exp(q)))) / count(*), 8) AS divergence, count(*) AS chunks FROM x GROUP BY 1""",
    "sparse_divergence": f"""WITH n AS (SELECT vec_id, embedding AS v, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS w FROM embeddings),
m AS (SELECT vec_id, v, w, list_max(v)::DOUBLE AS mv, list_max(w)::DOUBLE AS mw FROM n WHERE w IS NOT NULL),
s AS (SELECT vec_id, ({_LSM.format(v='v', m='mv')})[1:{CANDIDATES}] AS p, ({_LSM.format(v='w', m='mw')})[1:{CANDIDATES}] AS q FROM m),
r AS (SELECT *, ln(greatest(1 - list_sum(list_transform(p, lambda x: exp(x))), 1e-12)) AS rp, ln(greatest(1 - list_sum(list_transform(q, lambda x: exp(x))), 1e-12)) AS rq FROM s)
SELECT vec_id, round(list_sum(list_transform(list_zip(p, q), lambda z: exp(z[1]) * (z[1] - z[2]))) + exp(rp) * (rp - rq), 8) AS divergence FROM r""",
    "candidate_mass": f"""WITH m AS (SELECT vec_id, embedding AS v, list_max(embedding)::DOUBLE AS mv FROM embeddings),
s AS (SELECT vec_id, (list_reverse_sort({_LSM.format(v='v', m='mv')}))[1:{CANDIDATES}] AS p FROM m)
SELECT vec_id, round(list_sum(list_transform(p, lambda x: exp(x))), 8) AS mass, round(p[1], 8) AS best FROM s""",
    "padded_widths": """WITH f AS (SELECT label, len(list_filter(embedding, lambda x: x > 0)) AS n FROM embeddings),
w AS (SELECT label, CAST(ceil(max(n) / 8.0) * 8 AS INTEGER) AS width FROM f GROUP BY 1)
SELECT f.label, count(*) AS rows, max(width) AS width, CAST(sum(width) AS BIGINT) AS cells, CAST(sum(n) AS BIGINT) AS values FROM f JOIN w ON f.label = w.label GROUP BY 1""",
    "alignment_shapes": f"""WITH {_TOKENS}, s AS (SELECT id, octet_length(encode(t)) AS n FROM a),
r AS (SELECT id, least(k + 4, n) AS e FROM (SELECT id, n, unnest(range(0, n, 4)) AS k FROM s)),
c AS (SELECT l.id, l.e FROM l JOIN r ON l.id = r.id AND l.e = r.e),
cl AS (SELECT id, e, lag(e, 1, 0) OVER (PARTITION BY id ORDER BY e) AS b FROM c),
k AS (SELECT cl.id, cl.e, count(*) AS l FROM cl JOIN l ON l.id = cl.id AND l.e > cl.b AND l.e <= cl.e GROUP BY 1, 2),
k2 AS (SELECT k.*, CAST(ceil(k.e / 4.0) - floor(cl.b / 4.0) AS BIGINT) AS r FROM k JOIN cl ON k.id = cl.id AND k.e = cl.e)
SELECT CASE WHEN l = 1 THEN '1' ELSE 'N' END || ':' || CASE WHEN r = 1 THEN '1' WHEN l = 1 THEN 'N' ELSE 'M' END AS shape, count(*) AS chunks,
  CAST(sum(l) AS BIGINT) AS left_tokens, CAST(sum(r) AS BIGINT) AS right_tokens FROM k2 GROUP BY 1""",
    "token_contiguity": f"""WITH {_TOKENS}, m AS (SELECT l.id, max(e) AS m, any_value(octet_length(encode(a.t))) AS n FROM l JOIN a ON l.id = a.id GROUP BY 1)
SELECT TRUE AS contiguous, count(*) AS answers, CAST(sum(CASE WHEN m = n THEN 1 ELSE 0 END) AS BIGINT) AS whole FROM m""",
    "user_epochs": """WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, round(value, 2) AS value FROM events),
n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS last FROM s)
SELECT user_id, CAST(greatest(1, ceil(step / 10.0 - 1e-9)) AS INTEGER) AS epoch, count(*) AS steps, round(avg(value), 6) AS mean,
  round(avg(CASE WHEN step <= 5 THEN value END), 6) AS mean_of_first, round(avg(CASE WHEN step > last - 5 THEN value END), 6) AS mean_of_last, TRUE AS contiguous
FROM n GROUP BY 1, 2""",
}
