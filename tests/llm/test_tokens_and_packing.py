import itertools
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.llm import packing, tokens

VOCABULARY = tokens.DEFAULT_VOCABULARY
needs_vocabulary = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="the vocabulary is not here")


def test_double_array_finds_all_prefixes():
    rng = random.Random(1)
    keys = sorted({bytes(rng.choices(b"abc\xc3\xa9", k=rng.randrange(1, 6))) for _ in range(200)})
    trie = tokens.DoubleArray(keys)
    for _ in range(200):
        data = bytes(rng.choices(b"abc\xc3\xa9x", k=12))
        at = rng.randrange(12)
        want = {(at + len(k), i) for i, k in enumerate(keys) if data.startswith(k, at)}
        assert set(trie.prefixes(data, at)) == want


def brute(pieces, text, unknown):
    """Best score and its number of pieces over all ways to part the text; runs of unknown characters are one piece."""
    best = (-1e18, 0)
    for cuts in itertools.product([0, 1], repeat=max(0, len(text) - 1)):
        parts, last = [], 0
        for i, c in enumerate([*cuts, 1], 1):
            if c:
                parts.append(text[last:i])
                last = i
        score, count, before = 0.0, 0, False
        for p in parts:
            if p in pieces:
                score, count, before = score + pieces[p], count + 1, False
            elif len(p) == 1:
                score, count, before = score + unknown, count + (not before), True
            else:
                break
        else:
            best = max(best, (score, count))
    return best


@pytest.mark.parametrize("seed", range(4))
def test_unigram_counts_are_those_of_the_best_path(seed):
    rng = random.Random(seed)
    pieces = {"".join(rng.choices("abé", k=rng.randrange(1, 4))): -rng.random() * 9 - 0.01 * k for k in range(9)}
    counter = tokens.UnigramCounter(list(pieces.items()))
    for _ in range(60):
        text = "".join(rng.choices("abéx", k=rng.randrange(1, 9)))
        assert counter.count(text) == brute(pieces, text, counter.unknown)[1]
    assert tokens.UnigramCounter([("a", -1.0)], byte_fallback=True).count("aéa") == 4


@needs_vocabulary
def test_counts_are_the_tokenizers():
    counter = tokens.TokenCounter(VOCABULARY)
    rng = random.Random(2)
    texts = [None, "", " ", "   ", "a", " a ", "▁x ▁", "a\n\n  b\tc", "Straße 中文字 😀 x=1;  y", "word " * 20_000, "\x00<unk></s>"]
    texts += ["".join(rng.choices("ab .é中\n▁ 1", k=rng.randrange(1, 60))) for _ in range(300)]
    want = [len(counter.processor.encode(t)) if t else 0 for t in texts]
    assert counter.counts(texts).tolist() == want
    assert counter.counts(texts).tolist() == want


@needs_vocabulary
def test_budget(spark):
    count = lambda t: len(tokens.TokenCounter(VOCABULARY).processor.encode(t)) if t else 0
    rows = [("d", "1", "Src", "EN-us", "geo", 5, "some text here", "clash"), ("d", "2", None, None, None, None, None, "clash"),
            ("d", "3", "src ", "en", "GEO", -4, "more", "clash"), ("d", "3", "src ", "en", "GEO", -4, "more", "clash"), ("d", None, "src", "en", "geo", 0, "", "clash")]
    df = spark.createDataFrame(rows, "origin string, key string, source string, lang string, subject_domain string, stated_tokens long, text string, tokens string")
    got = {(r.source, r.lang, r.subject_domain): (r.texts, r.tokens, r.chars, r.stated_tokens) for r in tokens.token_budget(df).collect()}
    a, b = count("some text here"), count("more")
    assert got == {("src", "en", "geo"): (4, a + 2 * b, 22, 5), ("unknown", "und", "unknown"): (1, 0, 0, None)}
    got = {r.source: r.texts for r in tokens.token_budget(df, unique=True).collect()}
    assert got == {"src": 3, "unknown": 1}
    assert tokens.token_budget(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_sum_of_squares_follows_the_rule(seed):
    rng = np.random.default_rng(seed)
    capacity, sizes = 20, rng.integers(0, 21, 200)
    got = packing.sum_of_squares(sizes, capacity)
    level, made = {}, 0
    for size, chosen in zip(sizes.tolist(), got.tolist()):
        if size == 0:
            assert chosen == max(0, made - 1)
            if not made:
                level[0], made = capacity, 1
            continue

        def squares(gaps):
            return sum(n * n for n in np.bincount([g for g in gaps if g], minlength=capacity + 1).tolist())

        options = {}
        for c, gap in level.items():
            if gap >= size:
                options[c] = squares([*(g for k, g in level.items() if k != c), gap - size])
        options[made] = squares([*level.values(), capacity - size])
        # An open container is taken where a new one is no better.
        assert chosen in options and options[chosen] == min(options.values())
        level[chosen] = (level.get(chosen, capacity)) - size
        made = max(made, chosen + 1)
    assert min(level.values()) >= 0


def test_packing_places_everything_once(spark):
    rng = random.Random(7)
    sizes = [rng.choice([0, 1, 30, 64, 65, 128, 129, 300, None, -5]) if rng.random() < 0.3 else rng.randrange(1, 64) for _ in range(700)]
    df = spark.createDataFrame([(i, s, "clash", "clash") for i, s in enumerate(sizes)], "doc_id long, n long, container string, size string")
    rows = packing.pack(df, "doc_id", "n", 64, shard_items=200).collect()
    bins, items = {}, {}
    for r in rows:
        bins[r.container] = bins.get(r.container, 0) + r.tokens
        items.setdefault(r.doc_id, []).append(r)
    assert set(items) == set(range(700)) and max(bins.values()) <= 64
    assert set(bins) == set(range(len(bins)))
    for i, s in enumerate(sizes):
        s = max(0, s or 0)
        assert sum(r.tokens for r in items[i]) == s
        assert len(items[i]) == max(1, -(-s // 64)) and sorted(r.piece for r in items[i]) == list(range(len(items[i])))
    assert sum(bins.values()) / (64 * len(bins)) > 0.97
    assert sorted(map(tuple, rows)) == sorted(map(tuple, packing.pack(df.repartition(3), "doc_id", "n", 64, shard_items=200).collect()))


def test_packing_edges(spark):
    df = spark.createDataFrame([(1, 0)], "doc_id long, n long")
    assert [tuple(r) for r in packing.pack(df, "doc_id", "n", 8).collect()] == [(1, 0, 0, 0)]
    assert packing.pack(df.limit(0), "doc_id", "n", 8).count() == 0
    repeated = spark.createDataFrame([(1, 5), (1, 5), (None, 3)], "doc_id long, n long")
    assert sorted(r.tokens for r in packing.pack(repeated, "doc_id", "n", 8).collect()) == [3, 5, 5]
