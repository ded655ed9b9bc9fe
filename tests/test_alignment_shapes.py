import random
import re
from collections import Counter

import numpy as np
import pytest

from recordloom.operators import alignment
from recordloom.plans import likelihood


def two_sided(text):
    """Ends of the words (white space as in the SQL) and of the pieces of four bytes."""
    words, at = [], 0
    for w in re.findall(r"[\t\n\f\r ]*[^\t\n\f\r ]+|[\t\n\f\r ]+$", text):
        at += len(w.encode())
        words.append(at)
    return words, [min(k + 4, at) for k in range(0, at, 4)]


def model(texts):
    out = Counter()
    for text in texts:
        left, right = two_sided(text)
        before = 0
        for e in [e for e in left if e in right]:
            l, r = (sum(before < x <= e for x in side) for side in (left, right))
            shape = ("1" if l == 1 else "N") + ":" + ("1" if r == 1 else "N" if l == 1 else "M")
            out.update({(shape, "chunks"): 1, (shape, "left"): l, (shape, "right"): r})
            before = e
    return {(s, out[s, "chunks"], out[s, "left"], out[s, "right"]) for s, what in out if what == "chunks"}


@pytest.mark.parametrize("part", [1, 64, 4 << 20])
def test_shapes_of_odd_answers(spark, tmp_path, monkeypatch, part):
    monkeypatch.setattr(alignment, "PART_BYTES", part)
    rng = random.Random(part)
    bits = ["a", "bc", "é", "漢字", "😀", " ", "\n", "\t", "\x0b", "\x0c", "\x1c", "word", "    ", "\x00"]
    texts = {f"i{k}": "".join(rng.choices(bits, k=rng.randrange(1, 40))) for k in range(60)} | {"blank": " " * 9, "whole": "abcd" * 3}
    rows = [*texts.items(), *list(texts.items())[:20], (None, "a b c d"), ("null", None), ("empty", "")]
    spark.createDataFrame(rows, "id string, response_text string").repartition(3).write.parquet(f"{tmp_path}/normalized_attempts.parquet")
    got = likelihood.alignment_shapes(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == model(texts.values())
    assert got.columns == ["shape", "chunks", "left_tokens", "right_tokens"]


def test_no_answer_no_shape(spark, tmp_path):
    spark.createDataFrame([("a", ""), ("b", None)], "id string, response_text string").write.parquet(f"{tmp_path}/normalized_attempts.parquet")
    assert likelihood.alignment_shapes(spark, str(tmp_path)).collect() == []


def test_shapes_exchange_one_row_an_answer_and_no_tokens(spark, tmp_path):
    """Tokens as rows took 448 MB of shuffle and more than the disk allowed over 0.05 GB."""
    rows = [(f"i{k}", "some words of an answer " * 50) for k in range(40)]
    spark.createDataFrame(rows, "id string, response_text string").write.parquet(f"{tmp_path}/normalized_attempts.parquet")
    plan = likelihood.alignment_shapes(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and not re.search("Window|Join|explode", plan), plan
    exchanged = plan.split("Exchange hashpartitioning")[1].split("MapInArrow")[0]
    assert "text" not in exchanged


def test_chunks_end_with_their_text():
    offsets = np.array([0, 10, 10, 20])
    # Pieces after the last common end of the first text are in no chunk, and not in one of the text after it.
    text, left, right = alignment.shared_chunks(np.array([2, 4, 9, 13, 20]), np.array([4, 8, 12, 13, 20]), offsets)
    assert (text.tolist(), left.tolist(), right.tolist()) == ([0, 2, 2], [2, 1, 1], [1, 2, 1])
