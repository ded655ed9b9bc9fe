"""Joins of the attempt tables, and checks of keys and references."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.operators.ordering import with_position


def attempt_join(raw: DataFrame, normalised: DataFrame, verdicts: DataFrame, key: str = "id") -> DataFrame:
    """Raw attempts with what became of them; each side must hold a key once.

    The sides are narrowed to the key and a struct of their other columns, so that equal column names do not clash.
    """
    side = lambda df, name: df.select(F.col(key), F.struct(*[c for c in df.columns if c != key]).alias(name))
    return side(raw, "raw").join(side(normalised, "normalised"), key, "left").join(side(verdicts, "verdict"), key, "left")


def repeated_keys(rows: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return rows.groupBy(*key).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique(rows: DataFrame, key: list[str]) -> DataFrame:
    """``rows``, after a check that no key repeats."""
    sample = repeated_keys(rows, key).limit(5).collect()
    if sample:
        raise ValueError(f"keys that repeat: {[tuple(r)[:-1] for r in sample]}")
    return rows


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key by an order."""
    rest = [c for c in rows.columns if c != key]
    last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
    return last.select(key, *[F.col(f"_row.{c}").alias(c) for c in rest])


def pending(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs that were not done; rows with a null key were not."""
    return inputs.join(done.select(key).distinct(), key, "left_anti")


def without(rows: DataFrame, excluded: list[DataFrame], key: str) -> DataFrame:
    """Rows whose key is in none of several lists."""
    every = reduce(DataFrame.union, [x.select(key) for x in excluded]).distinct()
    return rows.join(every, key, "left_anti")


def reference_violations(named: dict[str, DataFrame], key: str, inside: list[tuple[str, str]], apart: list[tuple[str, str]] = ()) -> DataFrame:
    """``rule, key`` of each key that breaks a rule: ``inside`` pairs (a in b), ``apart`` pairs (a and b share none)."""
    parts = []
    keys = {n: df.select(F.col(key).cast("string").alias("key")).distinct() for n, df in named.items()}
    for a, b in inside:
        parts.append(keys[a].join(keys[b], "key", "left_anti").select(F.lit(f"{a} in {b}").alias("rule"), "key"))
    for a, b in apart:
        parts.append(keys[a].join(keys[b], "key", "left_semi").select(F.lit(f"{a} apart from {b}").alias("rule"), "key"))
    return reduce(DataFrame.union, parts)


def coverage(candidates: DataFrame, done: DataFrame, failed: DataFrame, key: str) -> DataFrame:
    """Per key what it is: done, failed, both, neither, or unknown to the candidates."""
    mark = lambda df, name: df.select(key).distinct().withColumn(name, F.lit(True))
    joined = mark(candidates, "_c").join(mark(done, "_d"), key, "full").join(mark(failed, "_f"), key, "full")
    state = (
        F.when(F.col("_c").isNull(), "unknown")
        .when(F.col("_d").isNotNull() & F.col("_f").isNotNull(), "both")
        .when(F.col("_d").isNotNull(), "done")
        .when(F.col("_f").isNotNull(), "failed")
        .otherwise("neither")
    )
    return joined.select(key, state.alias("state"))


def slots(problems: DataFrame, problem: str, most: int) -> DataFrame:
    """Every problem with every attempt number up to ``most``."""
    numbers = F.explode(F.sequence(F.lit(1), F.lit(most)))
    return problems.select(problem).distinct().select(problem, numbers.alias("attempt_number"))


def exact_overlap(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_text: Column, right_text: Column) -> DataFrame:
    """Pairs of rows with the same key text; empty texts match nothing."""
    a = left.select(F.col(left_id).alias("left_id"), left_text.alias("_text")).filter(F.length("_text") > 0)
    b = right.select(F.col(right_id).alias("right_id"), right_text.alias("_text")).filter(F.length("_text") > 0)
    return a.join(b, "_text").select("left_id", "right_id")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeated as often."""
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def drift(a: DataFrame, b: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys on one side only, and keys whose values differ, with the columns that do."""
    left = a.select(key, *[F.col(c).alias(f"_a_{c}") for c in columns]).withColumn("_a", F.lit(1))
    right = b.select(key, *[F.col(c).alias(f"_b_{c}") for c in columns]).withColumn("_b", F.lit(1))
    joined = left.join(right, key, "full")
    differ = F.array_compact(F.array(*[F.when(~F.col(f"_a_{c}").eqNullSafe(F.col(f"_b_{c}")), F.lit(c)) for c in columns]))
    where = F.when(F.col("_a").isNull(), "right only").when(F.col("_b").isNull(), "left only").otherwise("both")
    out = joined.select(key, where.alias("side"), F.when(where == "both", differ).alias("differ"))
    return out.filter((F.col("side") != "both") | (F.size("differ") > 0))


def first_matches(known: DataFrame, wanted: DataFrame, row: str, value: str) -> DataFrame:
    """``wanted_row, n, value, known_row, matches`` of the wanted values that are known: the first known row, and how many.

    Both sides have ``row, n, value``. The known side is folded to one row a value before the join.
    """
    folded = known.groupBy(value).agg(F.min(row).alias("known_row"), F.count("*").alias("matches"))
    return wanted.join(folded, value).select(F.col(row).alias("wanted_row"), "n", value, "known_row", "matches")


def set_likeness(left: DataFrame, right: DataFrame, row: str, values: str) -> DataFrame:
    """``left_row, left_rows, right_row, right_rows, shared, likeness`` of classes of rows with equal sets that share a value.

    Rows with one set of values are one class, named by its first row, so a frequent set meets the others once.
    """
    def classes(rows: DataFrame, side: str) -> DataFrame:
        sets = rows.select(row, F.array_sort(F.array_distinct(values)).alias("set"))
        return sets.groupBy("set").agg(F.min(row).alias(f"{side}_row"), F.count("*").alias(f"{side}_rows")).withColumn("value", F.explode("set")).withColumnRenamed("set", f"{side}_set")

    met = classes(left, "left").join(classes(right, "right"), "value")
    union = F.size(F.array_union("left_set", "right_set"))
    pairs = met.groupBy("left_row", "left_rows", "right_row", "right_rows", union.alias("_union")).agg(F.count("*").alias("shared"))
    return pairs.select("left_row", "left_rows", "right_row", "right_rows", "shared", F.round(F.col("shared") / F.col("_union"), 6).alias("likeness"))


def compared_pairs(candidates: DataFrame, order: list[str], name: str) -> DataFrame:
    """``base, candidate, comparison`` of candidates in an order: the first with each other, then neighbours after it."""
    placed = with_position(candidates, order).select("position", F.col(name).alias("candidate"))
    base = placed.select((F.col("position") + 1).alias("position"), F.col("candidate").alias("base"))
    adjacent = placed.filter("position > 1").join(base, "position").select("base", "candidate", F.lit("adjacent").alias("comparison"))
    first = placed.filter("position = 0").select(F.col("candidate").alias("base"))
    from_first = placed.filter("position > 0").join(F.broadcast(first)).select("base", "candidate", F.lit("first").alias("comparison"))
    return from_first.unionByName(adjacent)
