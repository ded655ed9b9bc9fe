"""Column functions on text. All are expressions of the JVM unless the docstring says otherwise."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Joins the two words of a bigram.
BIGRAM_MARK = "␟"
#: Local paths, and the shapes of credentials, both in any case.
LOCAL_PATH = r"(?i)(?:[a-z]:\\users\\[^\s\"']+|(?<![a-z0-9/])/(?:root|home)/[^\s\"']+)"
ACCESS_KEY = r"(?i)(?:\bsk[-_][a-z0-9_-]{12,}|\bhf_[a-z0-9]{12,}|bearer\s+[a-z0-9._~+/-]{12,})"
FENCE = "```"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def words(text: Column | str) -> Column:
    """Lower-case runs of letters, digits and underscores; null for null.

    Exact for text whose compatibility form and case folding differ from plain lower case only in the German sharp s;
    ``exact_fingerprint`` covers all text.
    """
    folded = F.regexp_replace(F.lower(_col(text)), "ß", "ss")
    return F.regexp_extract_all(folded, F.lit(r"([\p{L}\p{N}_]+)"), 1)


def fingerprint(text: Column | str) -> Column:
    """The words joined by blanks: equal for texts that differ in layout, case and punctuation only."""
    return F.array_join(words(text), " ")


@F.pandas_udf(StringType())
def exact_fingerprint(text: pd.Series) -> pd.Series:
    """As ``fingerprint`` for any text: NFKC form and full case folding (Arrow batches in Python)."""
    word = re.compile(r"\w+")
    return text.map(lambda t: None if not isinstance(t, str) else " ".join(word.findall(unicodedata.normalize("NFKC", t).casefold())))


def whole_fingerprint(text: Column | str) -> Column:
    """The exact fingerprint; only text that is not plain ASCII goes through Python."""
    c = _col(text)
    plain = F.octet_length(c) == F.length(c)
    return F.when(plain, fingerprint(c)).otherwise(exact_fingerprint(F.when(~plain, c)))


def whole_words(text: Column | str) -> Column:
    """The words of ``whole_fingerprint``; null for null."""
    return F.filter(F.split(whole_fingerprint(text), " "), lambda w: w != "")


def first_words(text: Column | str, n: int = 5) -> Column:
    return F.array_join(F.slice(whole_words(text), 1, n), " ")


def terms(text: Column | str) -> Column:
    """Single words, then pairs of neighbouring words."""
    w = words(text)
    pairs = F.when(
        F.size(w) > 1,
        F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.concat(a, F.lit(BIGRAM_MARK), b)),
    ).otherwise(F.array().cast("array<string>"))
    return F.concat(w, pairs)


def char_grams(text: Column | str, n: int = 5) -> Column:
    """Distinct character n-grams; a shorter text is its only gram. For short texts: each gram is cut from the start."""
    c = _col(text)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - (n - 1)))
    return F.when(c.isNotNull(), F.array_distinct(F.transform(starts, lambda i: F.substring(c, i, F.lit(n)))))


def numeric_id(text: Column | str) -> Column:
    """The first run of digits as a number, or null."""
    return F.regexp_extract(_col(text), r"(\d+)", 1).try_cast("bigint")


def prompt_body(prompt: Column | str) -> Column:
    """What stands in the first pair of triple quotes (all when there is none), without lines of assertions."""
    c = _col(prompt)
    quoted = F.regexp_extract(c, r"(?s)(\"\"\"|''')(.*?)\1", 2)
    has = c.rlike(r"(?s)(\"\"\"|''').*?\1")
    lines = F.split(F.when(has, quoted).otherwise(c), "\n")
    return F.array_join(F.filter(lines, lambda x: ~x.startswith("assert ")), "\n")


def unwrap_fence(text: Column | str) -> Column:
    """The inside of a text that is exactly one fenced block; other texts as they are."""
    c = F.trim(_col(text))
    inner = F.regexp_extract(c, r"(?s)^```[A-Za-z0-9_+-]*[ \t]*\n(.*?)\n?```$", 1)
    once = F.regexp_count(c, F.lit(FENCE)) == 2
    return F.when(once & c.rlike(r"(?s)^```[A-Za-z0-9_+-]*[ \t]*\n.*```$"), inner).otherwise(_col(text))


def redact_paths(text: Column | str, with_: str = "<path>") -> tuple[Column, Column]:
    """The text with local paths replaced, and how many were."""
    return F.regexp_replace(_col(text), LOCAL_PATH, with_), F.regexp_count(_col(text), F.lit(LOCAL_PATH))


def has_access_key(text: Column | str) -> Column:
    return _col(text).rlike(ACCESS_KEY)


def unix_lines(text: Column | str) -> Column:
    """Line ends as line feeds, without white space around the text."""
    return F.regexp_replace(F.regexp_replace(_col(text), "\r\n?", "\n"), r"^\s+|\s+$", "")


def bounded(text: Column | str, n: int, marker: str = "\n[cut]") -> Column:
    c = _col(text)
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(marker))).otherwise(c)


def name_key(text: Column | str) -> Column:
    """Names in one spelling: upper case, blanks and dashes as underscores."""
    return F.translate(F.upper(F.trim(_col(text))), "- ", "__")


def style(text: Column | str) -> Column:
    """Struct of characters, bytes, lines, non-empty lines, comment lines and fences."""
    c = _col(text)
    lines = F.split(c, "\n")
    return F.struct(
        F.length(c).alias("chars"),
        F.octet_length(c).alias("bytes"),
        F.size(lines).alias("lines"),
        F.size(F.filter(lines, lambda x: F.trim(x) != "")).alias("nonempty_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^\s*#"))).alias("comment_lines"),
        F.regexp_count(c, F.lit(FENCE)).alias("fences"),
    )


def ending(text: Column | str) -> Column:
    """Struct: ends in a line feed, ends in white space, last character."""
    c = _col(text)
    return F.struct(
        c.endswith("\n").alias("newline"),
        c.rlike(r"\s$").alias("white_space"),
        F.right(c, F.lit(1)).alias("last_char"),
    )


def jaccard(a: Column | str, b: Column | str) -> Column:
    """Likeness of two sets; two empty sets are equal."""
    union = F.size(F.array_union(_col(a), _col(b)))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(_col(a), _col(b))) / union)


@F.pandas_udf(DoubleType())
def gram_likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """``jaccard`` of the character 5-grams of two texts, in linear time (Arrow batches in Python); null for null."""

    def grams(t: str) -> set[str]:
        return {t[i : i + 5] for i in range(max(1, len(t) - 4))}

    out = []
    for x, y in zip(a, b):
        if x is None or y is None:
            out.append(None)
            continue
        p, q = grams(x), grams(y)
        shared = len(p & q)
        out.append(shared / (len(p) + len(q) - shared))
    return pd.Series(out, dtype="float64")


def short_id(text: Column | str, n: int = 20) -> Column:
    return F.substring(F.sha2(_col(text), 256), 1, n)


def attempt_id(problem: Column | str, number: Column | str) -> Column:
    return F.concat(_col(problem), F.lit("__attempt_"), _col(number).cast("string"))


#: The form of an attempt id.
ATTEMPT = r"^([A-Za-z0-9][A-Za-z0-9._:-]{0,191})__attempt_([1-3])$"


def parse_attempt(attempt: Column | str) -> tuple[Column, Column]:
    """Problem and number of an attempt id, null when it has not the form of one."""
    c = _col(attempt)
    problem = F.when(c.rlike(ATTEMPT), F.regexp_extract(c, ATTEMPT, 1))
    return problem, F.regexp_extract(c, ATTEMPT, 2).try_cast("int")
