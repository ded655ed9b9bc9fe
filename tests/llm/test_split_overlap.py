import random

import numpy as np
import pytest

from recordloom.llm import split_overlap as S
from recordloom.llm.text import statement, words

TRAIN = "train_id string, task struct<problem_text:string>, text string, train_key string"
HELD = "heldout_id string, prompt string, k string"


def runs(w):
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)}


def model(train, held, threshold=0.6):
    out = set()
    for i, t in train:
        for j, p in held:
            a, b = words(t), words(statement(p))
            x, y = runs(a), runs(b)
            if a and (a == b or x | y and len(x & y) / len(x | y) >= threshold):
                out.add((i, j))
    return out


def pairs(spark, train, held, **kw):
    a = spark.createDataFrame([(i, (t,), "clash", "clash") for i, t in train], TRAIN)
    b = spark.createDataFrame([(j, p, "clash") for j, p in held], HELD)
    return S.split_overlap(a, b, **kw)


def test_cases(spark):
    train = [("t1", "Sum of THE  numbers, given"), ("t2", None), ("t3", ""), ("t4", "two words"), ("t5", "sum of the numbers given here"),
             ("t6", "…!?"), ("t7", "sum of the numbers given sum of the numbers given"), ("t1b", "Sum of THE  numbers, given"), (None, "two words")]
    held = [("h1", '"""\nsum of the numbers given\nassert f(1) == 2\n"""'), ("h2", "Two Words"), ("h3", None), ("h4", "..."),
            ("h5", "def f():\n    '''sum of the numbers given'''"), ("h1", '"""\nsum of the numbers given\nassert f(1) == 2\n"""')]
    got = {(r.train_key, r.heldout_key) for r in pairs(spark, train, held).collect()}
    assert got == model(train, held)
    assert ("t4", "h2") in got and ("t1", "h5") in got and (None, "h2") in got


@pytest.mark.parametrize("seed", range(3))
def test_random_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)]
    text = lambda: " ".join(rng.choices(vocabulary, k=rng.randrange(0, 14)))
    held = [(f"h{k}", text()) for k in range(30)]
    train = [(f"t{k}", text()) for k in range(60)]
    for k in range(30):
        w = held[k][1].split()
        if w:
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        train.append((f"c{k}", " ".join(w)))
    monkeypatch.setattr(S, "SHARD_ITEMS", 11)
    found = pairs(spark, train, held, threshold=0.4).collect()
    assert {(r.train_key, r.heldout_key) for r in found} == model(train, held, 0.4)
    for r in found:
        a, b = words(dict(train)[r.train_key]), words(dict(held)[r.heldout_key])
        x, y = runs(a), runs(b)
        assert r.same_words == (a == b)
        assert r.likeness == pytest.approx(len(x & y) / len(x | y) if x | y else 1.0)
        longest = max((n for n in range(len(a) + 1) for i in range(len(a) - n + 1) if any(a[i : i + n] == b[j : j + n] for j in range(len(b) - n + 1))), default=0)
        assert r.longest_match <= longest and (r.matched_words > 0)


def test_empty_tables_and_long_texts(spark):
    long = " ".join(f"w{k % 977}" for k in range(60_000))
    assert pairs(spark, [], [("h", "a b c")]).count() == 0
    assert pairs(spark, [("t", "a b c")], []).count() == 0
    got = pairs(spark, [("t", long), ("u", long + " more words here")], [("h", long)]).orderBy("train_key").collect()
    assert [(r.train_key, r.same_words) for r in got] == [("t", True), ("u", False)]
    assert got[0].longest_match == 60_000


def test_long_matches_follow_their_occurrences(monkeypatch):
    monkeypatch.setattr(S, "SEED", 4)
    rng = random.Random(12)
    held = [[f"{rng.randrange(5)}" for _ in range(rng.randrange(0, 40))] for _ in range(12)]
    texts = [held[k % 12][rng.randrange(5):] + [f"{rng.randrange(5)}" for _ in range(9)] if k % 3 else held[k % 12] for k in range(40)]
    few = S.search(S.WordIndex(held), texts, 0.1)
    monkeypatch.setattr(S, "SEED", 1000)
    many = S.search(S.WordIndex(held), texts, 0.1)
    assert all(few[k].tolist() == many[k].tolist() for k in many) and few["same"].any()


def test_the_index_is_compressed():
    rng = random.Random(13)
    texts = [[f"w{rng.randrange(900)}" for _ in range(50)] for _ in range(200)]
    index = S.WordIndex(texts)
    data = [index.vocabulary[w] for t in texts for w in [*t]]
    rows = np.arange(index.size)
    assert sorted(index.positions(rows).tolist()) == list(range(index.size))
    size = sum(b.words.nbytes + b.before.nbytes for _, b, _ in index.transform.levels) + index.samples.nbytes
    assert size < 4 * len(data)


def test_one_backward_step_counts_a_word():
    index = S.WordIndex([["b", "a", "b"], ["a"], []])
    flat, _ = index.encode([["b"], ["zzz"]])
    low, high = index.step(flat[:1], np.array([0]), np.array([index.size]))
    assert (high - low)[0] == 2 and flat[1] == -1
