"""Task rows of differing shapes in one common form.

Every importer gives ``source_row, problem_text, interface_type, tests, extra``; rows that do not hold what the form
needs come out of ``rejected`` instead of raising. Which tasks are wanted is left to the caller.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TESTS = "array<struct<test_input:string,test_output:string>>"
_IO = "inputs array<string>, outputs array<string>, fn_name string"


def zipped(inputs: Column, outputs: Column) -> Column:
    """Tests of two arrays of equal size, else null."""
    pairs = F.zip_with(inputs, outputs, lambda a, b: F.struct(a.alias("test_input"), b.alias("test_output")))
    return F.when(F.size(inputs) == F.size(outputs), pairs).cast(TESTS)


def as_list(value: Column) -> Column:
    """A JSON text that is a string or a list of strings, as a list."""
    listed = F.from_json(value, "array<string>")
    plain = F.array(F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v"))
    return F.when(F.ltrim(value).startswith("["), listed).when(value.isNotNull(), plain)


def from_json_columns(rows: DataFrame, row_id: str, text: str = "question", io: str = "input_output") -> DataFrame:
    """Rows with a JSON text column of inputs, outputs and perhaps a function name."""
    parsed = F.from_json(F.col(io), _IO)
    return rows.select(
        F.col(row_id).cast("string").alias("source_row"), F.col(text).alias("problem_text"),
        F.when(parsed["fn_name"].isNull(), "stdin_stdout").otherwise("function").alias("interface_type"),
        zipped(parsed["inputs"], parsed["outputs"]).alias("tests"), parsed["fn_name"].alias("extra"),
    )


def from_test_groups(rows: DataFrame, row_id: str, text: str, groups: list[str]) -> DataFrame:
    """Rows with several structs of input and output arrays; ``extra`` counts the tests of each group."""
    tests = [zipped(F.col(f"{g}.input"), F.col(f"{g}.output")) for g in groups]
    return rows.select(
        F.col(row_id).cast("string").alias("source_row"), F.col(text).alias("problem_text"), F.lit("stdin_stdout").alias("interface_type"),
        F.concat(*tests).alias("tests"), F.to_json(F.struct(*[F.size(t).alias(g) for t, g in zip(tests, groups)])).alias("extra"),
    )


def sections(parts: dict[str, Column], examples: Column) -> Column:
    """Text of titled sections that are there, then the examples numbered from 1."""
    titled = [F.when(F.length(F.trim(c)) > 0, F.concat(F.lit(f"{t}\n") if t else F.lit(""), F.trim(c))) for t, c in parts.items()]
    shown = F.transform(examples, lambda e, i: F.format_string("Example %d\nInput:\n%s\nOutput:\n%s", i + 1, e["input"], e["output"]))
    return F.concat_ws("\n\n", F.array_compact(F.array(*titled)), shown)


def from_statements(rows: DataFrame, row_id: str, parts: dict[str, str], examples: str, tests: str) -> DataFrame:
    """Rows whose statement comes in parts, with examples and tests as arrays of structs."""
    text = sections({t: F.col(c) for t, c in parts.items()}, F.col(examples))
    return rows.select(
        F.col(row_id).cast("string").alias("source_row"), text.alias("problem_text"), F.lit("stdin_stdout").alias("interface_type"),
        F.transform(F.col(tests), lambda t: F.struct(t["input"].alias("test_input"), t["output"].alias("test_output"))).cast(TESTS).alias("tests"),
        F.lit(None).cast("string").alias("extra"),
    )


def from_functions(rows: DataFrame, row_id: str, text: str, tests: str, entry: str) -> DataFrame:
    """Function tasks with tests as program lines."""
    lines = F.transform(F.col(tests), lambda t: F.struct(t.alias("test_input"), F.lit(None).cast("string").alias("test_output")))
    return rows.select(
        F.col(row_id).cast("string").alias("source_row"), F.col(text).alias("problem_text"), F.lit("function").alias("interface_type"),
        lines.cast(TESTS).alias("tests"), F.col(entry).alias("extra"),
    )


def with_dictionary(rows: DataFrame, row_id: str, text: str, dictionary: DataFrame, key: str) -> DataFrame:
    """Rows whose tests stand in a table ``key, tests array<struct<input, output: JSON string or list>>``.

    A plain equi-join: the planner sends the dictionary whole only where its size allows.
    """
    unfolded = dictionary.select(F.col(key), F.posexplode("tests").alias("n", "t")).select(
        key, "n", F.explode(as_list(F.col("t.output"))).alias("o"), F.col("t.input").alias("i")
    )
    folded = unfolded.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("n", "i", "o"))), lambda x: F.struct(x["i"].alias("test_input"), x["o"].alias("test_output"))).alias("tests")
    )
    return rows.join(folded, key).select(
        F.col(row_id).cast("string").alias("source_row"), F.col(text).alias("problem_text"), F.lit("stdin_stdout").alias("interface_type"),
        F.col("tests").cast(TESTS).alias("tests"), F.lit(None).cast("string").alias("extra"),
    )


def usable(tasks: DataFrame) -> Column:
    return (F.length(F.trim("problem_text")) > 0) & (F.size("tests") > 0)


def rejected(tasks: DataFrame) -> DataFrame:
    """``source_row, reason`` of tasks without text or tests."""
    reason = F.when(F.coalesce(F.length(F.trim("problem_text")), F.lit(0)) == 0, "no text").when(F.col("tests").isNull(), "tests do not pair").when(F.size("tests") == 0, "no tests")
    return tasks.select("source_row", reason.alias("reason")).filter("reason is not null")


def messages(system: str, text: Column, interface: Column) -> Column:
    """Prompt of a task: a system and a user message."""
    return F.array(
        F.struct(F.lit("system").alias("role"), F.lit(system).alias("content")),
        F.struct(F.lit("user").alias("role"), F.format_string("%s\n\nInterface: %s", text, interface).alias("content")),
    )


def union_in_order(parts: list[tuple[str, DataFrame]], expected: dict[str, int] | None = None) -> DataFrame:
    """All rows of declared sources, with name and rank of the source; a source with another count than expected raises."""
    for name, df in parts:
        if expected and name in expected and (n := df.count()) != expected[name]:
            raise ValueError(f"{name}: {n} rows, {expected[name]} expected")
    out = None
    for k, (name, df) in enumerate(parts):
        part = df.withColumns({"source_name": F.lit(name), "source_rank": F.lit(k)})
        out = part if out is None else out.unionByName(part)
    return out
