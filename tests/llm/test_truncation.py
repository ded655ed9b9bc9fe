import random

import numpy as np
from pyspark.sql import functions as F

from recordloom.llm import truncation as S

SCHEMA = "text_id string, text string, lang string, source string, log_odds string"


def corpus(seed, n, share=0.1):
    """Texts in sentences, some with lists or code, some of them cut: rows and the ids of the cut ones."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(3, 9))) for _ in range(300)]
    rows, cut = [], set()
    for k in range(n):
        parts = [" ".join(" ".join(rng.choices(vocabulary, k=rng.randrange(5, 12))).capitalize() + "." for _ in range(rng.randrange(3, 9)))]
        if rng.random() < 0.3:
            parts.append("```python\n" + "\n".join(f"{rng.choice(vocabulary)} = {rng.randrange(99)}" for _ in range(5)) + "\n```")
        kind = rng.random()
        if kind < 0.2:
            parts.append("\n".join(f"- take the {rng.choice(vocabulary)}" for _ in range(4)))
        elif kind < 0.3:
            parts.append("Tags: " + ", ".join(rng.choices(vocabulary, k=3)))
        text = "\n\n".join(parts)
        if rng.random() < share:
            end = rng.randrange(20, len(parts[0]) - 1)
            while text[end - 1] in ".\n" or text[:end].rstrip()[-1] in ".\n":
                end -= 1
            text = text[:end] + rng.choice(["", "", "…", " [...]", "�"])
            cut.add(str(k))
        rows.append((str(k), text, rng.choice(["en", "de", None]), rng.choice(["s1", "s2"]), "clash"))
    return rows, cut


def test_cut_texts_are_told_from_whole_ones(spark):
    rows, cut = corpus(1, 1500)
    scores = S.truncation_scores(spark.createDataFrame(rows, SCHEMA)).collect()
    got = {r.text_id for r in scores if r.truncated}
    assert len(got & cut) >= 0.95 * len(cut)
    assert len(got & cut) >= 0.95 * len(got)
    fences = spark.createDataFrame([(r[0], r[1] + "\n\n```python\nx = 1", *r[2:]) if r[0] not in cut and int(r[0]) % 20 == 0 else r for r in rows], SCHEMA)
    opened = {r[0] for r in rows if r[0] not in cut and int(r[0]) % 20 == 0}
    got = {r.text_id for r in S.truncation_scores(fences).collect() if r.truncated}
    assert len(got & opened) >= 0.95 * len(opened)


def test_cases(spark):
    rows, _ = corpus(2, 300)
    extra = [("null", None), ("empty", ""), ("blank", " \n\t "), ("marks", "…"), ("long", "Some words here. " * 20_000), ("twice", "A b c."), ("twice", "A b c.")]
    df = spark.createDataFrame(rows + [(i, t, None, None, "c") for i, t in extra], SCHEMA)
    got = [r for r in S.truncation_scores(df).collect() if not r.text_id.isdigit()]
    assert sorted((r.text_id, r.truncated) for r in got) == [("long", False), ("marks", False), ("twice", False), ("twice", False)]
    assert {(r.lang, r.source) for r in got} == {("und", "unknown")}
    assert S.truncation_scores(df.limit(0)).count() == 0


def test_lines():
    assert S.fences("text\n```python\ncode\n```\nend\n```".split("\n")) == [False, True, True, False, False, True]
    assert S.opening("- item")[0] == S.opening("- other")[0] != S.opening("Word")[0]
    assert S.opening("- item")[1] == S.opening("- other")[1] != S.opening("Tags: a")[1]
    assert S.opening("12 13") == S.opening("145") and S.opening("") == (0, 0)
    assert S.body("abc … [...]\n") == ("abc", True)
    assert S.body("abc.\n") == ("abc.", False)


def test_counts_are_those_of_a_plain_walk():
    rng = random.Random(3)
    texts = ["".join(rng.choices("ab. \n-é", k=rng.randrange(1, 40))).strip() or "x" for _ in range(60)]
    counts = np.zeros(3 * S.COUNTERS, np.int64)
    chunk = S._Chunk([(t, 3, False) for t in texts])
    chunk.add_to(counts)
    every, lines, ends = counts.reshape(3, -1).sum(axis=1) // len(chunk.numbers)
    assert every == sum(len(t) - t.count("\n") for t in texts) and ends == len(texts)
    assert lines == sum(1 for t in texts for line in t.split("\n") if line)


def test_thresholds_are_those_of_a_column_and_language(spark):
    rows, cut = corpus(4, 1200)
    df = spark.createDataFrame(rows, SCHEMA)
    both = df.withColumn("column", F.lit("a")).unionByName(df.withColumn("column", F.lit("b")))
    scores = S.truncation_scores(both).collect()
    assert {(r.column, r.lang) for r in scores} == {(c, x) for c in "ab" for x in ("en", "de", "und")}
    for c in "ab":
        got = {r.text_id for r in scores if r.truncated and r.column == c}
        assert len(got & cut) >= 0.95 * len(cut) and len(got & cut) >= 0.95 * len(got)


def test_valley():
    h = np.zeros(S.BINS)
    low, high = int((-12 - S.LOWEST) * 4), int((-5 - S.LOWEST) * 4)
    h[low - 3 : low + 3], h[high - 3 : high + 3] = 50, 900
    assert -12 < S.valley(h) < -5
