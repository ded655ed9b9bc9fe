import random

import pytest
from pyspark.sql import functions as F

from recordloom.llm import leakage as S
from recordloom.llm.text import statement, words

DOCS = "doc_id long, text string, doc_key string, lang string"
HELD = "heldout_id string, prompt string, entry_point string, assertion_text string, k string"


def frames(spark, docs, held):
    return (
        spark.createDataFrame([(i, t, "c", "c") for i, t in docs], DOCS),
        spark.createDataFrame([(*h, *[None] * (4 - len(h)), "c") for h in held], HELD),
    )


def model(docs, held, run):
    out = set()
    for i, t in docs:
        w = words(t)
        have = {tuple(w[k : k + run]) for k in range(len(w) - run + 1)}
        for h in held:
            v = words(statement(h[1]))
            if h[0] is not None and i is not None and any(tuple(v[k : k + run]) in have for k in range(len(v) - run + 1)):
                out.add((str(i), h[0]))
    return out


def found(spark, docs, held, run=12):
    a, b = frames(spark, docs, held)
    return {(r.doc_key, r.heldout_key) for r in S.leaked_passages(a, b, run=run).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_random_against_brute_force(spark, seed, monkeypatch):
    rng = random.Random(seed)
    common = [f"w{k}" for k in range(30)]
    text = lambda n: rng.choices(common, k=n)
    held = [(f"h{k}", " ".join(text(rng.randrange(3, 50)) + [f"name{k}"] + text(9))) for k in range(14)]
    docs = []
    for i in range(80):
        w = text(rng.randrange(0, 60))
        for _ in range(rng.randrange(0, 3)):
            v = words(rng.choice(held)[1])
            a = rng.randrange(len(v))
            w += v[a : a + rng.randrange(3, 16)] + text(rng.randrange(0, 20))
        docs.append((i, " ".join(w)))
    if seed == 1:
        monkeypatch.setattr(S, "BLOCK_CHARS", 900)
    if seed == 2:
        monkeypatch.setattr(S, "CHUNK", 16)
        monkeypatch.setattr(S, "RANK", 4)
    want = model(docs, held, 6)
    assert want and found(spark, docs, held, 6) == want


def test_cases(spark):
    run = " ".join(f"word{k}" for k in range(12))
    docs = [(1, f"before {run.upper()}, after"), (2, None), (3, ""), (4, run.replace("word5", "other")), (5, f"{run} {run}"), (5, f"{run} {run}"),
            (6, "pad " * 40_000 + run), (None, run)]
    held = [("h1", f'"""\n{run}\nassert f(1) == 2\n"""'), ("h2", None), ("h3", "short one"), ("h4", f"x {run} y"), (None, run), ("h1", f'"""\n{run}\nassert f(1) == 2\n"""')]
    got = found(spark, docs, held)
    assert got == model(docs, held, 12) == {(d, h) for d in "156" for h in ("h1", "h4")}


def test_empty_tables(spark):
    assert found(spark, [], [("h", "a b c")]) == set()
    assert found(spark, [(1, "a b c")], []) == set()
    a, b = frames(spark, [(1, "a b c")], [])
    assert S.leak_report(a, b).count() == 0


def test_report_has_reworded_passages_and_answers(spark):
    rng = random.Random(3)
    held = [(f"h{k}", " ".join(f"{rng.choice('abcdef')}{rng.randrange(60)}" for _ in range(40)), f"solve_{k}", f"assert solve_{k}(2) == 4{k}7") for k in range(5)]
    w = words(held[0][1])
    reworded = " ".join(x if k % 6 else "instead" for k, x in enumerate(w))
    docs = [(1, "note " + reworded + " and solve_0 gives 407."), (2, "nothing of this kind " * 12), (3, held[1][1])]
    a, b = frames(spark, docs, held)
    got = {(r.doc_key, r.heldout_key): r for r in S.leak_report(a, b).collect()}
    assert ("1", "h0") in got and got[("1", "h0")].longest_run < 12 and got[("1", "h0")].answer_found
    assert got[("3", "h1")].longest_run == 40 and not got[("3", "h1")].answer_found
    assert not any(d == "2" for d, _ in got)


def test_report_tests_every_candidate_passage(spark):
    rng = random.Random(4)
    held = [(f"h{k}", " ".join(f"k{k}x{n}" for n in rng.sample(range(900), 40))) for k in range(5)]
    item = [words(h[1]) for h in held]
    # Words of the item in reverse score highest and fail the subsequence test; the leak stands far behind them.
    decoy = [" ".join(w[23::-1] + ["pad"] * 300) for w in item]
    reworded = " ".join(x if k % 6 else "instead" for k, x in enumerate(item[0]))
    docs = [(1, f"{decoy[0]} {reworded}"), (2, f"{decoy[1]} {' '.join(item[1][:14])}"), (3, decoy[2]), (4, "pad " * 30_000)]
    a, b = frames(spark, docs, held)
    got = {(r.doc_key, r.heldout_key): r for r in S.leak_report(a, b).collect()}
    assert set(got) == {("1", "h0"), ("2", "h1")}
    assert got["1", "h0"].longest_run == 5 and got["1", "h0"].latent_cosine >= 0.5
    assert got["2", "h1"].longest_run == got["2", "h1"].common_words == 14


def test_longest_common_sequences():
    rng = random.Random(5)
    for _ in range(50):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert S.common_subsequence(a, b) == table[-1][-1]
        runs = max((n for n in range(len(a) + 1) for i in range(len(a) - n + 1) if any(a[i : i + n] == b[j : j + n] for j in range(len(b) - n + 1))), default=0)
        assert S.longest_common_run(a, b, 99) == runs


def test_many_subsequences_at_once():
    import numpy as np

    rng = random.Random(6)
    texts = [[f"{rng.randrange(9)}" for _ in range(rng.choice([0, 3, 63, 64, 65, 150]))] for _ in range(12)]
    voc = S.Vocabulary(texts)
    ix = S.LatentIndex(texts, voc, np.ones(voc.columns), np.eye(voc.columns, dtype=np.float32), 1.0, 4)
    flat = np.array([rng.randrange(voc.size + 1) for _ in range(500)])
    item = np.array([rng.randrange(12) for _ in range(80)])
    begin = np.array([rng.randrange(400) for _ in range(80)])
    end = begin + np.array([rng.randrange(100) for _ in range(80)])
    got = S.common_subsequences(ix, item, flat, begin, end)
    want = [S.common_subsequence([voc.number[w] for w in texts[i]], [x for x in flat[a:b].tolist()]) for i, a, b in zip(item, begin, end)]
    assert got.tolist() == want


def test_singular_vectors(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    # Rows of two kinds of words: two directions hold all but a little of them.
    rows = [np.concatenate([rng.choice(12, 8), [24]]) if k % 2 else 12 + rng.choice(12, 8) for k in range(200)]
    passages = spark.createDataFrame([(bytearray(r.astype(np.int32).tobytes()),) for r in rows], "ids binary")
    idf = np.linspace(1, 2, 25)
    space = S.randomised_svd(passages, idf, 6)
    a = np.zeros((200, 25))
    for k, r in enumerate(rows):
        np.add.at(a[k], r, idf[r])
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    want = np.linalg.svd(a)[2][:2].T
    assert space.shape == (25, 6)
    assert np.allclose(np.abs(space[:, :2].T @ want), np.eye(2), atol=1e-2)


def test_reworded_passages_against_brute_force(spark):
    """Passages of items with a sixth of the words replaced, in texts of other words: nine of ten must come out."""
    rng = random.Random(8)
    common = [f"c{k}" for k in range(150)]
    held = [(f"h{k}", " ".join(rng.choices(common, k=50) + [f"own{k}x{n}" for n in range(6)])) for k in range(20)]
    docs, want = [], set()
    for i in range(120):
        text = rng.choices(common, k=60)
        if i % 2:
            k = rng.randrange(20)
            w = [x if rng.random() > 1 / 6 else f"alias{rng.randrange(50)}" for x in words(held[k][1])]
            text = text[:20] + w + text[20:]
            want.add((str(i), f"h{k}"))
        docs.append((i, " ".join(text)))
    a, b = frames(spark, docs, held)
    got = {(r.doc_key, r.heldout_key) for r in S.leak_report(a, b).collect()}
    assert len(got & want) >= 0.9 * len(want)
