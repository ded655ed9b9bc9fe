import random

import pytest

from recordloom.llm import shared_spans as S

SCHEMA = "id string, response_text string, row_key string, anchor string, text string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "c", "c", "c") for i, t in rows], SCHEMA)


def model(rows, n=200):
    own = {}
    for i, t in rows:
        if i is not None:
            for a in range(len(t or "") - n + 1):
                own.setdefault(t[a : a + n], set()).add(i)
    share = {}
    for i, t in set(rows):
        if i is None or not t:
            continue
        covered = set()
        for a in range(len(t) - n + 1):
            if len(own[t[a : a + n]]) > 1:
                covered.update(range(a, a + n))
        if covered:
            share[(i, len(t))] = len(covered)
    return share


def check(spark, rows):
    want = model(rows)
    got = S.records_with_shared_spans(frame(spark, rows)).collect()
    assert len(got) == len({r.record_id for r in got})
    assert {r.record_id for r in got} == {i for i, _ in want}
    shares = S.shared_span_shares(frame(spark, rows)).collect()
    assert {(r.record_id, r.chars): r.shared_chars for r in shares} == want
    return shares


def noise(rng, n):
    return "".join(rng.choices("abcdefgh \n", k=n))


@pytest.mark.parametrize("seed", range(3))
def test_random_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    shared = [noise(rng, n) for n in (199, 200, 201, 230, 260, 400, 900)]
    rows = []
    for k in range(60):
        parts = [noise(rng, rng.randrange(0, 300))]
        for _ in range(rng.randrange(0, 3)):
            s = rng.choice(shared)
            a = rng.randrange(0, 40)
            parts += [s[a:] if rng.random() < 0.3 else s, noise(rng, rng.randrange(0, 120))]
        rows.append((f"r{k}", "".join(parts)))
    rows += rng.sample(rows, 6)
    if seed == 2:
        monkeypatch.setattr(S, "SHARD_WINDOWS", 2)
    check(spark, rows)


def test_boundary_of_the_length(spark):
    rng = random.Random(9)
    s = noise(rng, 200)
    for cut, found in ((0, True), (1, False)):
        rows = [("a", noise(rng, 90) + "X" + s[cut:] + "Y" + noise(rng, 80)), ("b", noise(rng, 30) + "Z" + s[cut:] + "W")]
        assert bool(check(spark, rows)) == found


def test_cases(spark):
    rng = random.Random(5)
    s, t = noise(rng, 250), "é漢😀" * 90
    rows = [("a", s), ("a", s), (None, s), ("b", None), ("c", ""), ("d", t), ("e", "x" + t), ("f", "z" * 5000), ("g", "z" * 7000 + "q"),
            ("h", "=" * 199), ("i", "=" * 199), ("two", s[:100] + noise(rng, 300)), ("two", noise(rng, 220) + s[20:240])]
    shares = check(spark, rows)
    assert {r.record_id for r in shares} == {"a", "d", "e", "f", "g", "two"}
    assert next(r for r in shares if r.record_id == "f").shared_share == 1.0


def test_empty_table_and_long_text(spark):
    assert S.records_with_shared_spans(frame(spark, [])).count() == 0
    rng = random.Random(1)
    long = noise(rng, 400_000)
    rows = [("a", long), ("b", noise(rng, 500) + long[123_000:123_300] + noise(rng, 500)), ("c", noise(rng, 3000))]
    got = {r.record_id: (r.shared_chars, r.longest_span) for r in S.shared_span_shares(frame(spark, rows)).collect()}
    assert got == {"a": (300, 300), "b": (300, 300)} or all(300 <= v[0] <= 303 for v in got.values()) and set(got) == {"a", "b"}


def test_many_copies_of_one_text_and_one_head(spark):
    rng = random.Random(4)
    head, copy = noise(rng, 180), noise(rng, 300)
    rows = [(f"c{k}", copy) for k in range(60)] + [(f"h{k}", head + noise(rng, 150)) for k in range(90)]
    assert {r.record_id for r in check(spark, rows)} == {f"c{k}" for k in range(60)}


def test_automaton_spans():
    a = S.SuffixAutomaton()
    for k, text in enumerate(("abcabcx", "zabcabc", "abc")):
        a.add(text, k, k)
    a.finish()
    assert a.spans("abcabcx", 0, 0, 4) == [(0, 6)]
    assert a.spans("qqabcq", 9, 9, 3) == [(2, 5)]
    assert a.spans("abcabcx", 0, 0, 7) == []


def test_plans_that_change_at_run_time_lose_nothing(spark):
    """Joins planned as sorted that turn out small run without their exchange: shards must not be torn apart."""
    rng = random.Random(11)
    shared = [noise(rng, 205) for _ in range(40)]
    rows = []
    for k, s in enumerate(shared):
        rows += [(f"a{k}", noise(rng, 40) + s + noise(rng, 300)), (f"b{k}", noise(rng, 150) + s + noise(rng, 30))]
    rows += [(f"c{k}", shared[0][:190] + noise(rng, 100)) for k in range(100)]
    names = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m"}
    before = {n: spark.conf.get(n, None) for n in names}
    try:
        for n, v in names.items():
            spark.conf.set(n, v)
        want = {i for i, _ in model(rows)}
        got = S.records_with_shared_spans(frame(spark, rows).repartition(8)).collect()
        assert len(want) == 80 and {r.record_id for r in got} == want
    finally:
        for n, v in before.items():
            spark.conf.unset(n) if v is None else spark.conf.set(n, v)
