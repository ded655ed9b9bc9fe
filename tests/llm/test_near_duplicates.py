import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.llm import near_duplicates as S
from recordloom.llm.gray_index import GrayIndex, gray_rank
from recordloom.llm.text import words

SCHEMA = "i string, t string, class_key string, record_id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "c", "c") for i, t in rows], SCHEMA)


def model(rows, threshold, run):
    sets = {i: {tuple(w[k : k + run]) for k in range(len(w) - run + 1)} for i, t in rows if i is not None and t is not None for w in [words(t)]}
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= threshold}


def family(rng, n):
    vocabulary = [f"w{k}" for k in range(400)]
    rows = []
    for f in range(n):
        base = rng.choices(vocabulary, k=rng.randrange(20, 90))
        for m in range(rng.randrange(1, 5)):
            w = list(base)
            for _ in range(rng.randrange(0, 5)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(0, 2)] = rng.choices(vocabulary, k=rng.randrange(0, 3))
            rows.append((f"f{f}m{m}", " ".join(w)))
    return rows


@pytest.mark.parametrize("threshold,run", [(0.6, 3), (0.8, 5)])
def test_pairs_and_groups_against_brute_force(spark, threshold, run):
    rows = family(random.Random(run), 40)
    want = model(rows, threshold, run)
    df = frame(spark, rows)
    got = {(r.id_a, r.id_b) for r in S.near_duplicate_pairs(df, "i", F.col("t"), threshold, run).collect()}
    assert want and got == want
    groups = {r.record_id: r for r in S.near_duplicate_groups(df, "i", F.col("t"), threshold, run).collect()}
    for i, g in groups.items():
        assert g.group_id == min(c for c in groups if groups[c].group_id == g.group_id)
    for a, b in want:
        assert groups[a].group_id == groups[b].group_id


def test_cases(spark):
    same = "one two three four five six seven"
    rows = [("a", same), ("b", same.upper()), ("a", same), (None, same), ("n", None), ("e", ""), ("s", "one two"), ("long", "x y z " * 30_000), ("long2", "x y z " * 20_000)]
    df = frame(spark, rows)
    got = {(r.id_a, r.id_b) for r in S.near_duplicate_pairs(df, "i", F.col("t"), 0.6, 3).collect()}
    assert got == {("a", "b"), ("long", "long2")}
    rows = S.near_duplicate_groups(df, "i", F.col("t"), 0.6, 3).collect()
    groups = {r.record_id: (r.group_id, r.class_id, r.text_id, r.copies, r.links) for r in rows}
    assert groups == {
        "a": ("a", "a", "a", 2, 0), "b": ("a", "a", "b", 2, 0), "long": ("long", "long", "long", 2, 0), "long2": ("long", "long", "long2", 2, 0),
    }


def test_empty_table(spark):
    assert S.near_duplicate_pairs(frame(spark, []), "i", F.col("t"), 0.6, 3).count() == 0
    assert S.near_duplicate_groups(frame(spark, []), "i", F.col("t"), 0.6, 3).count() == 0


def test_large_class_is_a_star_and_hot_runs_are_split(spark, monkeypatch):
    monkeypatch.setattr(S, "EXPANDED", 5)
    rows = [(f"c{k:02d}", "alpha beta gamma delta epsilon") for k in range(9)] + [("d", "alpha beta gamma delta epsilon zeta")]
    got = {(r.id_a, r.id_b) for r in S.near_duplicate_pairs(frame(spark, rows), "i", F.col("t"), 0.6, 3).collect()}
    assert got == {("c00", f"c{k:02d}") for k in range(1, 9)} | {("c00", "d")}


def test_different_texts_of_a_large_class_are_all_paired(spark, monkeypatch):
    monkeypatch.setattr(S, "EXPANDED", 2)
    texts = ["alpha beta gamma delta epsilon", "Alpha beta gamma delta epsilon", "alpha, beta, gamma, delta, epsilon", "ALPHA beta gamma delta epsilon"]
    near = ["alpha beta gamma delta epsilon zeta", "alpha beta gamma delta epsilon Zeta", "alpha beta gamma delta epsilon - zeta"]
    rows = [(f"c{k}", t) for k, t in enumerate(texts)] + [(f"d{k}", t) for k, t in enumerate(near)]
    # Further copies of one text are links to its first record only.
    copies = [(f"x{k}", texts[0]) for k in range(3)]
    got = {(r.id_a, r.id_b) for r in S.near_duplicate_pairs(frame(spark, rows + copies), "i", F.col("t"), 0.6, 3).collect()}
    assert got == model(rows, 0.6, 3) | {("c0", i) for i, _ in copies} and len(model(rows, 0.6, 3)) == 21


def test_splitting_hot_parts_loses_no_pair(spark, monkeypatch):
    monkeypatch.setattr(S, "PART", 3)
    rows = family(random.Random(8), 25)
    got = {(r.id_a, r.id_b) for r in S.near_duplicate_pairs(frame(spark, rows), "i", F.col("t"), 0.6, 3).collect()}
    assert got == model(rows, 0.6, 3)


def test_no_pair_of_small_sets_is_lost():
    rng = np.random.default_rng(6)
    sets, want = [], set()
    for k in range(3000):
        # Five runs, three of them in the other set: a likeness of exactly 0.6.
        base = rng.integers(0, 1 << 63, 5, dtype=np.uint64)
        sets += [np.sort(base), np.sort(base[:3])]
        want.add((2 * k, 2 * k + 1))
    begin = np.cumsum([0] + [len(x) for x in sets])
    high, low = S.fingerprints(np.concatenate(sets), begin)
    map_high, map_low = S.bitmaps(np.concatenate(sets), begin)
    columns = [np.repeat(np.arange(3000), 2) * 77, np.arange(6000), np.diff(begin).astype(np.int32), high, low, map_high, map_low]
    columns = [c if c.dtype == np.int32 else c.view(np.int64) for c in columns]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=list(S.CODE_COLUMNS))
    got = {(r["key_a"], r["key_b"]) for out in S._close_pairs(0.6)(iter([batch])) for r in out.to_pylist()}
    assert got == want


def test_maps_of_small_sets_against_brute_force():
    rng = np.random.default_rng(9)
    sets = [np.unique(rng.choice(np.arange(1, 90, dtype=np.uint64), rng.integers(1, 80))) for _ in range(200)]
    begin = np.cumsum([0] + [len(x) for x in sets])
    run = np.sort(rng.integers(0, 4, 200))
    high, low = S.fingerprints(np.concatenate(sets), begin)
    map_high, map_low = S.bitmaps(np.concatenate(sets), begin)
    codes = {"run": run, "size": np.diff(begin), "high": high, "low": low, "map_high": map_high, "map_low": map_low}
    a, b, _ = S.index_pairs(codes, 0.6)
    got = [(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())]
    likeness = lambda x, y: len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    alike = {(x, y) for y in range(200) for x in range(y) if run[x] == run[y] and likeness(sets[x], sets[y]) >= 0.6 and min(len(sets[x]), len(sets[y])) < S.SMALL}
    assert alike <= set(got) and len(got) == len(set(got)) and all(run[x] == run[y] for x, y in got)


def test_the_index_prunes_groups():
    rng = np.random.default_rng(11)
    run = np.repeat(rng.integers(0, 1 << 63, 4000, dtype=np.uint64), 3)
    prints = rng.integers(0, 1 << 63, (2, 12000), dtype=np.uint64)
    index = GrayIndex(np.stack([run, *prints]), np.full(12000, 24.5))
    a, b = index.pairs()
    assert (run[a] == run[b]).all()
    every = 12000 * 11999 // 2
    # Of all pairs of codes next to none were looked at: their nodes were pruned.
    assert index.spared > 0.99 * every and index.tested < 40 * 12000


def test_chain_is_one_component(spark):
    links = spark.createDataFrame([(f"n{k:03d}", f"n{k + 1:03d}") for k in range(40)] + [("x", "y")], "a string, b string")
    got = {r.node: r.component for r in S.components(links).collect()}
    assert set(got.values()) == {"n000", "x"} and len(got) == 43


def test_gray_rank_orders_neighbours():
    codes = np.array([k ^ (k >> 1) for k in range(64)], np.uint64)
    assert gray_rank(np.stack([np.zeros(64, np.uint64), codes]))[1].tolist() == list(range(64))
    high, low = gray_rank(np.array([[3], [0]], np.uint64))
    assert (int(high[0]) << 64 | int(low[0])) == 2 << 64


def test_ranks_of_spark_and_numpy_agree(spark):
    codes = np.random.default_rng(2).integers(-(1 << 63), 1 << 63, 200)
    got = spark.createDataFrame([(int(c),) for c in codes], "c long").select(S.gray_column(F.col("c")).alias("r")).collect()
    assert [r.r for r in got] == gray_rank(codes.view(np.uint64)[None])[0].view(np.int64).tolist()


@pytest.mark.parametrize("radius", [0, 20, 45, 128])
def test_index_finds_all_pairs_in_the_radius(radius):
    rng = np.random.default_rng(radius)
    centre = rng.integers(0, 1 << 63, (2, 12), dtype=np.uint64)
    which = rng.integers(0, 12, 300)
    flips = np.zeros((2, 300), np.uint64)
    for _ in range(14):
        flips[rng.integers(0, 2, 300), np.arange(300)] ^= np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)
    prints = centre[:, which] ^ flips
    run = rng.integers(0, 5, 300).astype(np.uint64)
    a, b = GrayIndex(np.stack([run, *prints]), np.full(300, radius / 2)).pairs()
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    assert len(got) == len(a)
    distance = lambda x, y: int(np.bitwise_count(prints[:, x] ^ prints[:, y]).sum())
    assert got == {(x, y) for x in range(300) for y in range(x + 1, 300) if run[x] == run[y] and distance(x, y) <= radius}


def test_fingerprints_tell_the_likeness():
    rng = np.random.default_rng(1)
    for shared in (0.6, 0.8):
        common = rng.integers(0, 1 << 63, int(1000 * shared), dtype=np.uint64)
        rest = [rng.integers(0, 1 << 63, (1000 - len(common)) // 2, dtype=np.uint64) for _ in range(2)]
        sets = [np.sort(np.concatenate([common, r])) for r in rest]
        high, low = S.fingerprints(np.concatenate(sets), np.array([0, len(sets[0]), len(sets[0]) + len(sets[1])]))
        differ = int(np.bitwise_count(high[0] ^ high[1]) + np.bitwise_count(low[0] ^ low[1]))
        assert differ <= S.radius(shared)
