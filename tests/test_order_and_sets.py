import hashlib
import random

import pytest
from pyspark.sql import functions as F

from recordloom.operators import aggregates, dedup, joins, ordering


def test_position_is_the_place_in_the_order(spark):
    values = random.Random(1).sample(range(10_000), 500)
    df = spark.createDataFrame([(v,) for v in values], "v int")
    got = {r.v: r.position for r in ordering.with_position(df, ["v"]).collect()}
    assert got == {v: i for i, v in enumerate(sorted(values))}
    assert ordering.with_position(df.filter("v < 0"), ["v"]).count() == 0


def test_interleave_is_the_sequential_round_robin(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "a", "a", "b", "c", None])) for i in range(80)]
    df = spark.createDataFrame(rows, "seq int, source string")
    queues, order = {}, []
    for seq, s in rows:
        if s not in queues:
            queues[s] = []
            order.append(s)
        queues[s].append(seq)
    want = []
    while any(queues.values()):
        want += [queues[s].pop(0) for s in order if queues[s]]
    got = [r.seq for r in ordering.interleaved(df, "source", ["seq"]).orderBy("position").collect()]
    assert got == want


def test_seeded_sample_is_pythons(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(57)], "seq int, name string")
    got = [r.name for r in ordering.seeded_sample(df, ["seq"], 9, 5).orderBy("draw").collect()]
    assert got == random.Random(5).sample([f"t{i}" for i in range(57)], 9)
    with pytest.raises(ValueError):
        ordering.seeded_sample(df, ["seq"], 58, 5)


def test_hash_sample_is_stable_and_by_integer_rank(spark):
    names = [f"n{i}" for i in range(200)]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    rank = lambda n: int.from_bytes(hashlib.sha256(f"7\0{n}".encode()).digest(), "big")
    got = [r.name for r in ordering.hash_sample(df, "name", 12, 7).collect()]
    assert got == sorted(names, key=rank)[:12]


def test_batches_and_shards(spark):
    df = spark.range(10).select(F.col("id").alias("p"))
    got = [r.b for r in df.select("p", ordering.batches(F.col("p"), 2, 3).alias("b")).orderBy("p").collect()]
    assert got == [1, 1, 2, 2, 2, 3, 3, 3, 4, 4]


def greedy(rows):
    taken, out = [{}, {}, {}], {}
    for seq, *keys in rows:
        owner = next(((name, taken[i][k]) for i, (name, k) in enumerate(zip("abc", keys)) if k is not None and k in taken[i]), None)
        if owner is None:
            for i, k in enumerate(keys):
                if k is not None:
                    taken[i][k] = seq
            out[seq] = (True, None, None)
        else:
            out[seq] = (False, *owner)
    return out


@pytest.mark.parametrize("seed", range(4))
def test_greedy_distinct_is_the_sequential_walk(spark, seed):
    rng = random.Random(seed)
    pick = lambda p, n: None if rng.random() < 0.1 else f"{p}{rng.randrange(n)}"
    rows = [(i, pick("a", 25), pick("b", 12), pick("c", 18)) for i in range(40)]
    df = spark.createDataFrame(rows, "seq int, a string, b string, c string")
    got = {r.seq: (r.kept, r.reason, r.duplicate_of) for r in dedup.greedy_distinct(df, ["a", "b", "c"], "seq").collect()}
    assert got == greedy(rows)


def test_greedy_distinct_of_a_chain_keeps_what_an_excluded_row_would_block(spark):
    df = spark.createDataFrame([(1, "p1", "t1"), (2, "p1", "t2"), (3, "p3", "t2")], "seq int, p string, t string")
    got = {r.seq: r.kept for r in dedup.greedy_distinct(df, ["p", "t"], "seq").collect()}
    assert got == {1: True, 2: False, 3: True}


def test_keep_first_and_copies(spark):
    df = spark.createDataFrame([(3, "x", "c"), (1, "x", "a"), (2, None, "b"), (4, None, "d")], "seq int, k string, v string")
    assert sorted((r.seq, r.v) for r in dedup.keep_first(df, ["k"], ["seq"]).collect()) == [(1, "a"), (2, "b")]
    assert [(r.seq, r.duplicate_of) for r in dedup.duplicates_of(df, "seq", "k", ["seq"]).collect()] == [(3, 1)]


def test_alias_groups(spark):
    df = spark.createDataFrame([("b", ["a", "c"]), ("a", None), ("z", [])], "id string, aliases array<string>")
    assert [r[0] for r in df.select(dedup.alias_key("id", "aliases")).collect()] == ["a", "a", "z"]


@pytest.mark.parametrize("n", [1, 19, 20, 21, 40])
def test_two_percentile_rules(spark, n):
    values = [float(x * x) for x in range(n)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    near = aggregates.nearest_rank(df, ["g"], "v").first()
    between = aggregates.interpolated(df, ["g"], "v").first()
    assert near.p95 == values[max(0, -(-95 * n // 100) - 1)]
    at = 0.95 * (n - 1)
    low = int(at)
    assert between.p95 == pytest.approx(values[low] + (at - low) * (values[min(low + 1, n - 1)] - values[low]))


def test_ordered_hash(spark):
    ids = [f"i{n}" for n in range(300)]
    df = spark.createDataFrame([(n, i) for n, i in enumerate(ids)], "n int, id string").repartition(4)
    row = aggregates.ordered_hash(df, ["n"], "id").first()
    assert (row.n, row.sha256) == (300, hashlib.sha256("\n".join(ids).encode()).hexdigest())


def test_pass_at(spark):
    df = spark.createDataFrame([("p", 1, False), ("p", 2, True), ("q", 1, True), ("r", 1, False)], "p string, n int, ok boolean")
    got = [(r.k, r.problems, r.passed) for r in aggregates.pass_at(df, "p", "n", F.col("ok"), 3).orderBy("k").collect()]
    assert got == [(1, 3, 1), (2, 3, 2), (3, 3, 2)]


def test_joins(spark):
    a = spark.createDataFrame([("1", "x"), ("2", "y"), (None, "z")], "id string, v string")
    b = spark.createDataFrame([("2", "y"), ("3", "w")], "id string, v string")
    assert [(r.id, r.raw.v, r.normalised and r.normalised.v, r.verdict) for r in joins.attempt_join(a, b, b.filter("false")).orderBy("raw.v").collect()] == [
        ("1", "x", None, None), ("2", "y", "y", None), (None, "z", None, None)]
    assert {r.v for r in joins.pending(a, b, "id").collect()} == {"x", "z"}
    assert {(r.id, r.side) for r in joins.drift(a.filter("id is not null"), b, "id", ["v"]).collect()} == {("1", "left only"), ("3", "right only")}
    assert {(r.rule, r.key) for r in joins.reference_violations({"a": a, "b": b}, "id", [("b", "a")], [("a", "b")]).collect()} == {
        ("b in a", "3"), ("a apart from b", "2")}
    assert {(r.id, r.state) for r in joins.coverage(a.filter("id is not null"), b, a.filter("id = '2'"), "id").collect()} == {
        ("1", "neither"), ("2", "both"), ("3", "unknown")}
    assert joins.same_rows(a, a.select("*")) and not joins.same_rows(a, b)
    with pytest.raises(ValueError):
        joins.require_unique(a.union(a), ["id"])
    assert joins.require_unique(b, ["id"]) is b
