import pytest
from pyspark.sql import functions as F

from recordloom.functions import code, text
from recordloom.operators import aggregates, alignment, joins


def test_fixed_patterns(spark):
    df = spark.createDataFrame([
        ("see /root/a and x/root/b, C:\\Users\\me\\f",), ("https://x.y/home/z",), ("SK_abcdefghijkl",), ("Bearer abcdefghijkl0",), ("sk-short",), (None,), ("",),
    ], "t string")
    got = [tuple(r) for r in df.select(text.redact_paths("t")[0], text.redact_paths("t")[1], text.has_access_key("t")).collect()]
    assert got[0] == ("see <path> and x/root/b, <path>", 2, False)
    assert got[1] == ("https://x.y/home/z", 0, False)
    assert [r[2] for r in got[2:]] == [True, True, False, None, False]


def test_program_facts():
    facts = lambda s: dict(zip(code.FACTS, code._facts(s)))
    assert facts("open('x')")["forbidden_call"] and not facts("f.open('x')")["forbidden_call"]
    assert facts("import os.path")["forbidden_import"] and facts("from . import a")["forbidden_import"] and facts("import numpy")["forbidden_import"]
    assert not facts("import math\nfrom collections import deque")["forbidden_import"]
    # Only loose text of the module itself counts.
    assert facts("x = 1\n'prose'")["loose_string"]
    assert not facts("'doc'\ndef f():\n    x = 1\n    'inner'")["loose_string"]
    assert not any(facts(None).values()) and not any(facts("def (").values())


def test_assertion_forms():
    t = "assert f(a.b) == 1\nnot python (\nprint(2)\n\nassert f(x.y) == 'z'"
    shapes = code.assertion_shapes(t, "f")
    assert len(shapes) == len(code.normal_assertions(t, "f")) == 4
    assert shapes[1] == "SYNTAX_ERROR" and shapes[0].replace("int", "str") == shapes[3]
    assert code.normal_assertions(t, "f")[0] == "assert target(a.b) == 1"
    assert code.assertion_shapes(None, "f") is None and code.assertion_shapes("", None) == []


def test_first_matches_and_set_likeness_against_brute_force(spark):
    known = [("k2", 0, "a"), ("k1", 1, "a"), ("k1", 0, "b"), ("k3", 0, None)]
    wanted = [("w1", 0, "a"), ("w1", 1, "c"), ("w2", 0, "b"), ("w3", 0, None)]
    frames = [spark.createDataFrame(x, "id string, n int, v string") for x in (known, wanted)]
    got = sorted(tuple(r) for r in joins.first_matches(*frames, "id", "v").collect())
    assert got == [("w1", 0, "a", "k1", 2), ("w2", 0, "b", "k1", 1)]
    sets = {"l": [("a", ["x", "y"]), ("b", ["y", "x", "x"]), ("c", ["z"]), ("d", []), ("e", None)], "r": [("p", ["x", "z"]), ("q", ["w"])]}
    left, right = (spark.createDataFrame(sets[k], "id string, s array<string>") for k in "lr")
    got = sorted(tuple(r) for r in joins.set_likeness(left, right, "id", "s").collect())
    assert got == [("a", 2, "p", 1, 1, pytest.approx(1 / 3, abs=1e-6)), ("c", 1, "p", 1, 1, 0.5)]
    assert joins.set_likeness(left.limit(0), right, "id", "s").count() == 0


def test_gates_costs_and_order(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, "c")], "n int, v string")
    r = aggregates.gates(df, {"some": F.count("*") == 5, "none": F.max("n") < 0, "unknown": F.lit(None).cast("boolean")}).first()
    assert (r.some, r.none, r.unknown, r.all_hold) == (True, False, False, False)
    got = [(r.v, r.n, r.place) for r in aggregates.most_common(df, "v", "n").orderBy("place").collect()]
    assert got == [("b", 2, 1), ("a", 2, 2), ("c", 1, 3)]
    cost = aggregates.weighted_cost([(F.sum("n"), 2.0), (F.count("*"), 1.0)], per=10)
    assert df.agg(cost.alias("c")).first().c == pytest.approx(3.5)


def test_pairs_to_compare_and_single_rows(spark):
    df = spark.createDataFrame([("c",), ("a",), ("b",), ("d",)], "name string")
    got = sorted(tuple(r) for r in joins.compared_pairs(df, ["name"], "name").collect())
    assert got == [("a", "b", "first"), ("a", "c", "first"), ("a", "d", "first"), ("b", "c", "adjacent"), ("c", "d", "adjacent")]
    assert joins.compared_pairs(df.limit(0), ["name"], "name").count() == 0
    once = alignment.single_occurrence(spark.createDataFrame([("x", 1), ("x", 2), ("y", 3), (None, 4)], "k string, n int"), ["k"])
    assert sorted(r.n for r in once.collect()) == [3, 4]


def test_ordered_hash_is_that_of_a_plain_walk(spark):
    import hashlib

    values = [(k, None if k % 7 == 0 else "" if k % 5 == 0 else f"v{k}") for k in range(500)]
    r = aggregates.ordered_hash(spark.createDataFrame(values, "k long, v string").repartition(6), ["k"], "v").first()
    joined = "\n".join("<null>" if v is None else v for _, v in values)
    assert (r.n, r.sha256) == (500, hashlib.sha256(joined.encode()).hexdigest())
