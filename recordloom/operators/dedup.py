"""Which of several rows with one key is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.session import materialize


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key, by an order that is total; keys compare with nulls equal.

    The order values are compared in a partial aggregate before the exchange, so a hot key leaves each task once.
    """
    columns = [c for c in rows.columns if c not in key]
    lead = [c for c in order if c not in key]
    packed = F.struct(*lead, *[F.col(c) for c in columns if c not in lead])
    kept = rows.groupBy(*key).agg(F.min_by(packed, F.struct(*lead)).alias("_row"))
    return kept.select(*[F.col(c) if c in key else F.col(f"_row.{c}").alias(c) for c in rows.columns])


def duplicates_of(rows: DataFrame, row_id: str, key: str, order: list[str]) -> DataFrame:
    """Rows that are not the first of their key: ``row_id, duplicate_of``; rows with a null key are nobody's copies."""
    lead = F.struct(*order)
    first = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(row_id, lead).alias("duplicate_of"), F.count("*").alias("_n"))
    many = first.filter("_n > 1").drop("_n")
    return rows.join(many, key).filter(F.col(row_id) != F.col("duplicate_of")).select(row_id, "duplicate_of")


def alias_key(own: str, aliases: str):
    """One key for rows that name each other: the smallest of the row's own name and its aliases."""
    return F.array_min(F.array_append(F.coalesce(F.col(aliases), F.array().cast("array<string>")), F.col(own)))


def greedy_distinct(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Walks the rows in order of ``seq`` and keeps a row when none of its keys was taken by a kept row.

    Returns ``seq, kept, reason, duplicate_of``: the reason is the first of ``keys`` that a kept, earlier row has.
    Dropped rows take no keys, so the outcome depends on the order; it is found by rounds: among the undecided rows, one
    that comes first for each of its keys is kept, then rows that share a key with a kept, earlier row are dropped. Each
    round is joins and aggregates, written to the shared folder, and decides the first undecided row at least. Null keys are nobody's. ``seq`` must be unique.
    """
    state = rows.select(seq, *keys).withColumns({"kept": F.lit(None).cast("boolean"), "reason": F.lit(None).cast("string"), "duplicate_of": F.lit(None).cast(rows.schema[seq].dataType)})
    state = materialize(state, "greedy")
    while True:
        open_rows = state.filter(F.col("kept").isNull()).select(seq, *keys)
        leads = open_rows
        for k in keys:
            first = open_rows.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(seq).alias(f"_first_{k}"))
            leads = leads.join(first, k, "left")
        first_of_all = F.lit(True)
        for k in keys:
            first_of_all = first_of_all & F.coalesce(F.col(f"_first_{k}") == F.col(seq), F.lit(True))
        fresh = leads.filter(first_of_all).select(seq)
        marked = state.join(fresh.withColumn("_new", F.lit(True)), seq, "left")
        marked = marked.withColumn("kept", F.coalesce("kept", "_new")).drop("_new")
        marked = materialize(marked, "greedy")
        kept = marked.filter("kept")
        out = marked
        for k in keys:
            owner = kept.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(seq).alias(f"_owner_{k}"))
            out = out.join(owner, k, "left")
        reason = F.coalesce(*[F.when(F.col(f"_owner_{k}") < F.col(seq), F.lit(k)) for k in keys])
        owner = F.coalesce(*[F.when(F.col(f"_owner_{k}") < F.col(seq), F.col(f"_owner_{k}")) for k in keys])
        undecided = F.col("kept").isNull() & reason.isNotNull()
        out = out.select(
            seq, *keys,
            F.when(undecided, F.lit(False)).otherwise(F.col("kept")).alias("kept"),
            F.when(undecided, reason).otherwise(F.col("reason")).alias("reason"),
            F.when(undecided, owner).otherwise(F.col("duplicate_of")).alias("duplicate_of"),
        )
        state = materialize(out, "greedy")
        if not state.filter(F.col("kept").isNull()).limit(1).count():
            return _final_reasons(state, keys, seq)


def _final_reasons(state: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Reasons against all kept rows: a row may have been dropped before the owner of an earlier key was known."""
    kept = state.filter("kept")
    out = state
    for k in keys:
        owner = kept.filter(F.col(k).isNotNull()).groupBy(k).agg(F.min(seq).alias(f"_owner_{k}"))
        out = out.join(owner, k, "left")
    dropped = ~F.col("kept")
    reason = F.coalesce(*[F.when(F.col(f"_owner_{k}") < F.col(seq), F.lit(k)) for k in keys])
    owner = F.coalesce(*[F.when(F.col(f"_owner_{k}") < F.col(seq), F.col(f"_owner_{k}")) for k in keys])
    return out.select(seq, "kept", F.when(dropped, reason).alias("reason"), F.when(dropped, owner).alias("duplicate_of"))
