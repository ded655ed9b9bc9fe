"""The queries of the operators on text, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordloom.llm.leakage import leak_report, leaked_passages
from recordloom.llm.near_duplicates import near_duplicate_groups, near_duplicate_pairs
from recordloom.llm.packing import pack
from recordloom.llm.shared_spans import records_with_shared_spans, shared_span_shares
from recordloom.llm.split_overlap import split_overlap
from recordloom.llm.tokens import slice_name, token_budget, with_token_counts
from recordloom.llm.truncation import truncation_scores
from recordloom.session import read_table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = split_overlap(read_table(spark, folder, "training_records"), read_table(spark, folder, "heldout_tasks"))
    return pairs.select(F.col("heldout_key").alias("heldout_id"), F.col("train_key").alias("train_id"))


def p1_overlap_by_split(spark: SparkSession, folder: str) -> DataFrame:
    """Overlapping pairs, training records and held-out items per split of the item and dataset of the record."""
    training, heldout = read_table(spark, folder, "training_records"), read_table(spark, folder, "heldout_tasks")
    pairs = split_overlap(training, heldout)
    splits = heldout.select(
        F.col("heldout_id").alias("heldout_key"), F.coalesce("split", F.lit("unknown")).alias("heldout_split")
    ).distinct()
    sources = training.select(
        F.col("train_id").alias("train_key"),
        F.coalesce(F.lower(F.trim("task.source.dataset")), F.lit("unknown")).alias("dataset"),
    ).distinct()
    return (
        pairs.join(splits, "heldout_key")
        .join(sources, "train_key")
        .groupBy("heldout_split", "dataset")
        .agg(
            F.count("*").alias("pairs"),
            F.countDistinct("train_key").alias("training_records"),
            F.countDistinct("heldout_key").alias("heldout_items"),
            F.sum(F.col("same_words").cast("long")).alias("same_words"),
            F.round(F.avg("likeness"), 6).alias("mean_likeness"),
            F.sum(F.col("matched_words").cast("long")).alias("matched_words"),
        )
    )


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    found = records_with_shared_spans(read_table(spark, folder, "normalized_attempts"))
    return found.select(F.col("record_id").alias("id"))


def p2_shared_share(spark: SparkSession, folder: str) -> DataFrame:
    """Of each answer that shares a stretch with another: how much of it."""
    return shared_span_shares(read_table(spark, folder, "normalized_attempts")).withColumnRenamed("record_id", "id")


#: TESTDATA.md sets the likeness and the length of word runs of this table's queries.
TRAINING_LIKENESS, TRAINING_RUN = 0.6, 3


def _training_text():
    return F.concat(F.coalesce("task.problem_text", F.lit("")), F.lit(" "), F.coalesce("response_text", F.lit("")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    records = read_table(spark, folder, "training_records")
    pairs = near_duplicate_pairs(records, "train_id", _training_text(), TRAINING_LIKENESS, TRAINING_RUN)
    return pairs.select(F.col("id_a").alias("train_id_a"), F.col("id_b").alias("train_id_b"))


def p4_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Group, copies and links of each training record."""
    records = read_table(spark, folder, "training_records")
    groups = near_duplicate_groups(records, "train_id", _training_text(), TRAINING_LIKENESS, TRAINING_RUN)
    return groups.withColumnRenamed("record_id", "train_id")


def p5_token_budget(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens per source, language and domain; a domain that the text does not name is that of its source."""
    documents = read_table(spark, folder, "documents").select(
        F.lit("documents").alias("origin"),
        F.col("doc_id").alias("key"),
        "source",
        "lang",
        "subject_domain",
        F.lit(None).cast("long").alias("stated_tokens"),
        "text",
    )
    attempts = read_table(spark, folder, "normalized_attempts").select(
        F.lit("normalized_attempts").alias("origin"),
        F.col("id").alias("key"),
        F.col("task.source.dataset").alias("source"),
        "lang",
        F.lit(None).cast("string").alias("subject_domain"),
        F.col("token_usage.completion_tokens").alias("stated_tokens"),
        F.col("response_text").alias("text"),
    )
    slices = token_budget(documents).unionByName(token_budget(attempts, unique=True))
    catalog = read_table(spark, folder, "source_catalog").select(
        slice_name("source_name").alias("source"), slice_name("subject_domain").alias("catalog_domain")
    )
    catalog = catalog.groupBy("source").agg(F.min("catalog_domain").alias("catalog_domain"))
    known = F.when(F.col("subject_domain") != "unknown", F.col("subject_domain"))
    return (
        slices.join(catalog, "source", "left")
        .withColumn("subject_domain", F.coalesce(known, "catalog_domain", F.lit("unknown")))
        .groupBy("origin", "source", "lang", "subject_domain")
        .agg(*[F.sum(c).alias(c) for c in ("texts", "chars", "tokens", "stated_tokens")])
    )


CONTAINER_TOKENS = 2048


def _containers(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents").select("doc_id", "text")
    return pack(with_token_counts(documents, "text", "doc_tokens"), "doc_id", "doc_tokens", CONTAINER_TOKENS)


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Container of each document; several rows only for a document larger than a container."""
    return _containers(spark, folder)


def p6_fill(spark: SparkSession, folder: str) -> DataFrame:
    """How full the containers are: one row."""
    filled = _containers(spark, folder).groupBy("container").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    return filled.agg(
        F.count("*").alias("containers"),
        F.sum("pieces").alias("pieces"),
        F.sum("tokens").alias("tokens"),
        F.max("tokens").alias("fullest"),
        F.round(F.sum("tokens") / (F.count("*") * CONTAINER_TOKENS), 6).alias("fill"),
    )


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    pairs = leaked_passages(read_table(spark, folder, "documents"), read_table(spark, folder, "heldout_tasks"))
    return pairs.select(F.col("doc_key").cast("long").alias("doc_id"), F.col("heldout_key").alias("heldout_id"))


def p7_leak_report(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with a passage of an item, verbatim or reworded, and how they match."""
    report = leak_report(read_table(spark, folder, "documents"), read_table(spark, folder, "heldout_tasks"))
    return report.withColumn("doc_id", F.col("doc_key").cast("long")).drop("doc_key").withColumnRenamed("heldout_key", "heldout_id")


def _end_scores(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "documents")
    return truncation_scores(documents.select(F.col("doc_id").alias("text_id"), "text", "lang", "source"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _end_scores(spark, folder).filter("truncated").select(F.col("text_id").cast("long").alias("doc_id"))


def p8_truncation_by_source(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of each source, how many are cut, how many of these carry a mark, and their share."""
    scores = _end_scores(spark, folder)
    cut = F.col("truncated").cast("long")
    return scores.groupBy("source").agg(
        F.count("*").alias("texts"),
        F.sum(cut).alias("truncated"),
        F.sum(F.when(F.col("lost_mark"), cut).otherwise(0)).alias("with_mark"),
        F.round(F.avg(cut), 6).alias("truncated_share"),
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_overlap_by_split": p1_overlap_by_split,
    "p2_found": p2_found,
    "p2_shared_share": p2_shared_share,
    "p4_found": p4_found,
    "p4_groups": p4_groups,
    "p5_token_budget": p5_token_budget,
    "p6_containers": p6_containers,
    "p6_fill": p6_fill,
    "p7_found": p7_found,
    "p7_leak_report": p7_leak_report,
    "p8_found": p8_found,
    "p8_truncation_by_source": p8_truncation_by_source,
}
ORACLES: dict[str, str] = {}
