"""From raw responses to normal records, with errors as data; checks of records; projections for release."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordloom.functions.numeric import bytes_match, bytes_valid, mass
from recordloom.functions.text import has_access_key, redact_paths

TOP = "array<struct<token:string,bytes:array<int>,logprob:double>>"
TOKEN = f"struct<token:string,bytes:array<int>,logprob:double,top_logprobs:{TOP}>"
#: Columns of a raw record.
RAW = (
    "schema_version string, id string, status string, collected_at string, "
    "request struct<model:string,messages:array<struct<role:string,content:string>>,top_logprobs:int>, "
    "response struct<id:string,model:string,choices:array<struct<finish_reason:string,"
    f"message:struct<role:string,content:string>,logprobs:struct<content:array<{TOKEN}>>>>,usage:map<string,bigint>>, "
    "error struct<type:string,message:string>, task struct<problem_id:string,attempt_number:int>"
)
#: Numeric tolerances of log-probabilities and of their sums.
LOGPROB_MAX, MASS_MAX = 1e-7, 1 + 1e-6


def token_rows(content: Column) -> Column:
    """Tokens with the mass of their candidates."""
    return F.transform(content, lambda t: F.struct(
        t["token"].alias("token"), t["bytes"].alias("bytes"), t["logprob"].alias("logprob"), t["top_logprobs"].alias("top_logprobs"),
        mass(F.transform(F.coalesce(t["top_logprobs"], F.array().cast(TOP)), lambda c: c["logprob"])).alias("top_probability_mass"),
    ))


def normalise(raw: DataFrame) -> DataFrame:
    """Normal form of raw records of status ok, with column ``problem``: null, or what is wrong with the record.

    Nothing raises: a row with a problem goes to the error queue, and the others go on.
    """
    ok = raw.filter(F.lower(F.trim("status")) == "ok")
    choice = F.try_element_at("response.choices", F.lit(1))
    content = choice["logprobs"]["content"]
    tokens = token_rows(content)
    text = choice["message"]["content"]
    bad_number = F.exists(content, lambda t: t["logprob"].isNull() | F.isnan(t["logprob"]) | (t["logprob"] > LOGPROB_MAX))
    bad_bytes = F.exists(content, lambda t: t["bytes"].isNotNull() & ~bytes_valid(t["bytes"]))
    bad_mass = F.exists(tokens, lambda t: t["top_probability_mass"] > MASS_MAX)
    problem = (
        F.when(F.col("id").isNull() | (F.trim("id") == ""), "no id")
        .when(F.coalesce(F.size("response.choices"), F.lit(0)) != 1, "not one choice")
        .when(text.isNull(), "no text")
        .when(content.isNull(), "no tokens")
        .when(F.coalesce(bad_number, F.lit(False)), "bad log-probability")
        .when(F.coalesce(bad_bytes, F.lit(False)), "bad bytes")
        .when(F.coalesce(bad_mass, F.lit(False)), "mass above one")
    )
    match = F.when(problem.isNull(), bytes_match(F.transform(content, lambda t: t["bytes"]), text))
    return ok.select(
        "id", F.col("schema_version").alias("source_raw_schema_version"), F.to_timestamp("collected_at").alias("collected_at"),
        F.col("response.model").alias("teacher_model"), choice["finish_reason"].alias("finish_reason"), text.alias("response_text"),
        tokens.alias("content_tokens"), F.col("response.usage").alias("usage"),
        F.struct(match.alias("content_bytes_match"), F.array_compact(F.array(F.when(match.isNull(), "bytes missing"))).alias("warnings")).alias("validation"),
        "task", problem.alias("problem"),
    )


def split_errors(normal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records without a problem, and ``id, failure_category, message`` of the others."""
    errors = normal.filter("problem is not null").select("id", F.lit("malformed_trace").alias("failure_category"), F.col("problem").alias("message"))
    return normal.filter("problem is null").drop("problem"), errors


def exact_trace(tokens: Column, text: Column) -> Column:
    """Whether every token has bytes and a finite log-probability, and the bytes spell the text."""
    sound = F.forall(tokens, lambda t: (F.size(t["bytes"]) > 0) & bytes_valid(t["bytes"]) & t["logprob"].isNotNull() & ~F.isnan(t["logprob"]) & (F.abs(t["logprob"]) < float("inf")))
    return F.coalesce(sound & bytes_match(F.transform(tokens, lambda t: t["bytes"]), text), F.lit(False))


def complete_candidates(tokens: Column, k: int) -> Column:
    """Whether every token has at least k candidates, each with a token and a log-probability."""
    return F.forall(tokens, lambda t: (F.size(t["top_logprobs"]) >= k) & F.forall(t["top_logprobs"], lambda c: c["token"].isNotNull() & c["logprob"].isNotNull()))


def trace_counts(tokens: Column, k: int) -> Column:
    """Struct of counts over the tokens of one record, without unfolding them."""
    return F.struct(
        F.size(tokens).alias("positions"),
        F.size(F.filter(tokens, lambda t: t["logprob"].isNotNull())).alias("with_logprob"),
        F.size(F.filter(tokens, lambda t: F.size(t["top_logprobs"]) == k)).alias("with_k_candidates"),
        F.size(F.filter(tokens, lambda t: ~F.coalesce(bytes_valid(t["bytes"]), F.lit(False)))).alias("bad_bytes"),
    )


def sorted_candidates(logprobs: Column, k: int) -> Column:
    """Candidates' log-probabilities, largest first, filled up with minus infinity."""
    ordered = F.sort_array(logprobs, asc=False)
    return F.slice(F.concat(ordered, F.array_repeat(F.lit(float("-inf")), k)), 1, k)


def issues(rows: DataFrame, row_id: str, rules: dict[str, Column]) -> DataFrame:
    """``row_id, issue`` of every rule that a row breaks; a rule that is null on a row is not broken."""
    codes = F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()]))
    return rows.select(row_id, F.explode(codes).alias("issue"))


def with_reasons(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``rows`` with the rules that each breaks, in the order given, and whether it breaks none."""
    reasons = F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()]))
    return rows.withColumn("reasons", reasons).withColumn("clean", F.size("reasons") == 0)


def released(rows: DataFrame, keep: list[str], redact: list[str]) -> DataFrame:
    """Only listed columns (nested ones by path), local paths replaced in some, and how many were: ``redactions``."""
    counts = [F.coalesce(redact_paths(c)[1], F.lit(0)) for c in redact]
    columns = [redact_paths(c)[0].alias(c.split(".")[-1]) if c in redact else F.col(c).alias(c.split(".")[-1]) for c in keep]
    return rows.select(*columns, sum(counts, F.lit(0)).alias("redactions"))


def secrets(rows: DataFrame, row_id: str) -> DataFrame:
    """Rows any of whose string values (nested ones too) has the shape of an access key."""
    whole = F.to_json(F.struct(*[c for c in rows.columns if c != row_id]))
    return rows.filter(has_access_key(whole)).select(row_id)


def forbidden_fields(schema: T.StructType, names: set[str], allowed_paths: set[str] = frozenset()) -> list[str]:
    """Paths of fields with a forbidden name, at any depth. The schema is typed, so no row is read."""
    found = []

    def walk(kind: T.DataType, path: str) -> None:
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                here = f"{path}.{f.name}" if path else f.name
                if f.name in names and here not in allowed_paths:
                    found.append(here)
                walk(f.dataType, here)
        elif isinstance(kind, T.ArrayType):
            walk(kind.elementType, path)
        elif isinstance(kind, T.MapType):
            walk(kind.valueType, path)

    walk(schema, "")
    return found
