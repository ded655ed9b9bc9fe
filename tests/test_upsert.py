import datetime as dt
import random

import pytest

from recordloom.operators.upsert import BucketedStore, kept_deliveries, surplus_deliveries
from recordloom.session import new_table_path

SCHEMA = "delivery_no long, id string, status string, received_at timestamp, _bucket string, run string"


def at(minute):
    return dt.datetime(2031, 1, 1) + dt.timedelta(minutes=minute)


def surplus(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    return sorted(r.delivery_no for r in surplus_deliveries(df).collect())


def model(rows):
    groups = {}
    for n, key, status, when in rows:
        if key is not None:
            rank = ((status or "").strip().lower() != "ok", when, n)
            groups.setdefault(key.strip(), []).append(rank)
    return sorted({r[2] for g in groups.values() for r in g} - {min(g)[2] for g in groups.values()})


def test_cases(spark):
    rows = [
        (1, "a", "error", at(1)), (2, " a\t", "OK ", at(5)), (3, "a", "ok", at(5)), (4, "a ", None, at(0)),
        (5, None, "ok", at(1)), (6, None, "ok", at(1)), (7, "  ", "ok", at(2)), (8, "", "ok", at(1)), (9, "b", None, at(9)),
    ]
    assert surplus(spark, rows) == model(rows) == [1, 3, 4, 7]


def test_empty_and_repeated_rows(spark):
    assert surplus(spark, []) == []
    assert surplus(spark, [(1, "a", "ok", at(1)), (1, "a", "ok", at(1))]) == []
    assert surplus(spark, [(1, "a", "ok", at(1)), (2, "a", "ok", at(1)), (2, "a", "ok", at(1))]) == [2]


def test_random_against_model(spark):
    rng = random.Random(3)
    rows = [(n, rng.choice(["hot", "hot ", " x", "x", "y", None]) if rng.random() < 0.6 else f"k{rng.randrange(40)}",
             rng.choice(["ok", "OK", " ok", "error", None]), at(rng.randrange(8))) for n in range(400)]
    assert surplus(spark, rows) == model(rows)


def test_kept_rows_carry_payload(spark):
    df = spark.createDataFrame([(1, "a", "ok", at(2), "p", "q"), (2, "a", "ok", at(1), "r", "s")], SCHEMA)
    assert [(r.delivery_key, r.delivery_no, r.run) for r in kept_deliveries(df, ["run"]).collect()] == [("a", 2, "s")]


def test_upserts_are_idempotent_and_any_split_gives_one_result(spark):
    rows = [(f"k{n % 7}", n * 37 % 11, n) for n in range(60)]
    df = spark.createDataFrame(rows, "k string, o long, n long")
    want = sorted(min((o, n) for k2, o, n in rows if k2 == k) for k in {r[0] for r in rows})
    store = BucketedStore(spark, new_table_path(spark, "t"), "k", ["o", "n"], [], 3)
    store.upsert(df.filter("n < 20"), "a")
    store.upsert(df.filter("n >= 15"), "b")
    store.upsert(df.filter("n >= 15"), "b")
    assert sorted((r.o, r.n) for r in store.rows().collect()) == want
    store.compact()
    assert sorted((r.o, r.n) for r in store.rows().collect()) == want
    store.upsert(df, "c")
    assert sorted((r.o, r.n) for r in store.rows().collect()) == want
    with pytest.raises(ValueError):
        store.compact()
    store.compact("second")
    assert sorted((r.o, r.n) for r in store.rows().collect()) == want
    assert store.runs == ["second"]


def test_a_store_is_opened_again_and_compaction_needs_no_exchange(spark):
    rows = [(f"k{n % 5}", n * 7 % 13, n) for n in range(40)]
    df = spark.createDataFrame(rows, "k string, o long, n long")
    winners = sorted(min((o, n) for k2, o, n in rows if k2 == k) for k in {r[0] for r in rows})
    path = new_table_path(spark, "t")
    BucketedStore(spark, path, "k", ["o", "n"], [], 3).upsert(df, (df.n % 4).cast("string"))
    store = BucketedStore(spark, path, "k", ["o", "n"], [], 3)  # as after a restart
    assert store.runs == ["0", "1", "2", "3"]
    plan = store._merged()._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and "Exchange" not in plan
    store.compact()
    assert store.runs == ["merged"]
    assert sorted((r.o, r.n) for r in store.rows().collect()) == winners
    lost = {(r.o, r.n) for r in store.collapsed().collect()}
    assert lost == {(o, n) for _, o, n in rows} - set(winners)
    store.upsert(df, "again")
    store.compact("later")
    assert sorted((r.o, r.n) for r in store.rows().collect()) == winners
    assert {(r.o, r.n) for r in store.collapsed().collect()} == lost


def test_files_are_one_for_each_bucket_and_run(spark):
    df = spark.range(200).selectExpr("cast(id % 50 as string) AS k", "id AS o")
    store = BucketedStore(spark, new_table_path(spark, "t"), "k", ["o"], [], 3)
    store.upsert(df, "a")
    files = spark.read.parquet(f"{store.path}/runs").selectExpr("input_file_name() AS f", "k", "c0 AS o")
    assert files.select("f").distinct().count() == 3
    for f in {r.f for r in files.collect()}:
        ks = [(r.k, r.o) for r in spark.read.parquet(f).selectExpr("k", "c0 AS o").collect()]
        assert ks == sorted(ks)
