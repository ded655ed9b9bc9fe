"""Most alike text of a large table for each text of a small one, by three measures.

The small side (held-out items) is bounded by ``BLOCK_ITEMS`` and ``BLOCK_CHARS`` per pass; its inverted index travels to the tasks, and the
large side is streamed once per block without an exchange. Each task keeps its best match per item.
"""

from __future__ import annotations

import difflib
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recordloom.functions.text import terms, whole_words
from recordloom.session import materialize

BLOCK_ITEMS, BLOCK_CHARS = 2048, 4 << 20
_WORD = re.compile(r"\w+")


def normal_words(text: str | None) -> list[str]:
    return _WORD.findall(unicodedata.normalize("NFKC", text or "").casefold())


def _terms(w: list[str]) -> Counter:
    return Counter(w) + Counter(f"{a}␟{b}" for a, b in zip(w, w[1:]))


def _grams(text: str) -> set[str]:
    return {text[i : i + 5] for i in range(max(1, len(text) - 4))} if text else set()


class _Postings:
    """Inverted index of the items: for each feature the items that have it, with a weight."""

    def __init__(self, features: list[dict[str, float]]):
        lists: dict[str, list[tuple[int, float]]] = {}
        for k, f in enumerate(features):
            for x, w in f.items():
                lists.setdefault(x, []).append((k, w))
        self.at = {x: i for i, x in enumerate(lists)}
        sizes = np.array([len(v) for v in lists.values()], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.items = np.array([k for v in lists.values() for k, _ in v], np.int64)
        self.weights = np.array([w for v in lists.values() for _, w in v])
        self.count = len(features)

    def dot(self, features: dict[str, float]) -> np.ndarray:
        hits = [(self.at[x], w) for x, w in features.items() if x in self.at]
        if not hits:
            return np.zeros(self.count)
        at = np.array([i for i, _ in hits])
        size = self.first[at + 1] - self.first[at]
        where = np.repeat(self.first[at] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
        return np.bincount(self.items[where], self.weights[where] * np.repeat([w for _, w in hits], size), self.count)


def document_frequencies(texts: DataFrame, column: Column) -> DataFrame:
    """``term, df`` over all texts."""
    return texts.select(F.explode(F.array_distinct(terms(column))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def nearest_texts(
    training: DataFrame, heldout: DataFrame, train_id: str, train_text: str, heldout_id: str, heldout_text: Column
) -> DataFrame:
    """Per held-out item: the most alike training text by character 5-grams (Jaccard) and by TF-IDF cosine of words and
    pairs of words, whether some text is the same, and the sequence ratio of the best by grams.

    Inverse document frequencies ``ln((1 + N) / (1 + df)) + 1`` count training and held-out texts; only the items' terms
    are sent, so what is broadcast is bounded by the items. Ties go to the higher cosine, then the larger id. Null texts
    are empty; an item is in the result if there is any training text.
    """
    spark = training.sparkSession
    rows = training.select(F.col(train_id).cast("string").alias("id"), F.coalesce(train_text, F.lit("")).alias("text"))
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    items = heldout.select(F.col(heldout_id).cast("string").alias("id"), F.coalesce(heldout_text, F.lit("")).alias("text"))
    total = rows.count() + items.count()
    frequencies = materialize(document_frequencies(rows.select("text").union(items.select("text")), F.col("text")), "term-df")
    smooth = F.log((1 + total) / (1 + F.col("df"))) + 1
    counted = rows.select("text_key", F.explode(terms("text")).alias("term")).groupBy("text_key", "term").agg(F.count("*").alias("tf"))
    # Rows that repeat a text repeat its counts; their number is taken out again.
    copies = rows.groupBy("text_key").agg(F.count("*").alias("copies"))
    norms = counted.join(frequencies, "term").groupBy("text_key").agg(F.sum((F.col("tf") * smooth) ** 2).alias("square"))
    norms = norms.join(copies, "text_key").select("text_key", (F.sqrt("square") / F.col("copies")).alias("norm"))
    rows = materialize(rows.join(norms, "text_key", "left").select("id", "text", F.coalesce("norm", F.lit(0.0)).alias("norm")), "normed")
    size = items.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, -(-size.n // BLOCK_ITEMS), -(-size.chars // BLOCK_CHARS))
    out = None
    for b in range(blocks):
        block = items.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == b).orderBy("id").collect()
        item_words = [normal_words(r.text) for r in block]
        own_terms = [_terms(w) for w in item_words]
        vocabulary = spark.createDataFrame([(t,) for t in {t for x in own_terms for t in x}], "term string")
        wanted = frequencies.join(vocabulary, "term", "left_semi").collect()
        df = {r.term: r.df for r in wanted}
        idf = lambda t: float(np.log((1 + total) / (1 + df.get(t, 0))) + 1)
        weights = [{t: n * idf(t) for t, n in x.items()} for x in own_terms]
        grams = [dict.fromkeys(_grams(" ".join(w)), 1.0) for w in item_words]
        state = spark.sparkContext.broadcast({
            "names": [r.id for r in block],
            "texts": [" ".join(w) for w in item_words],
            "idf": {t: idf(t) for x in own_terms for t in x},
            "tfidf": _Postings(weights),
            "norms": np.array([np.sqrt(sum(v * v for v in x.values())) for x in weights]),
            "grams": _Postings(grams),
            "sizes": np.array([len(g) for g in grams]),
        })

        def work(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            s = state.value
            n = len(s["names"])
            best = [(-1.0, -1.0, "", "")] * n
            cosines, same = [(-1.0, "")] * n, [0] * n
            index = {}
            for k, t in enumerate(s["texts"]):
                index.setdefault(t, []).append(k)
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in ("id", "text", "norm")]
                for key, text, norm in zip(*columns):
                    w = normal_words(text)
                    joined = " ".join(w)
                    tf = {t: c * s["idf"][t] for t, c in _terms(w).items() if t in s["idf"]}
                    cosine = s["tfidf"].dot(tf) / np.maximum(s["norms"] * norm, 1e-12)
                    g = _grams(joined)
                    shared = s["grams"].dot(dict.fromkeys(g, 1.0))
                    union = s["sizes"] + len(g) - shared
                    jaccard = np.where(union > 0, shared / np.maximum(union, 1), 1.0)
                    for k in np.flatnonzero(jaccard >= np.array([x[0] for x in best])).tolist():
                        best[k] = max(best[k], (float(jaccard[k]), float(cosine[k]), key, joined))
                    for k in np.flatnonzero(cosine >= np.array([x[0] for x in cosines])).tolist():
                        cosines[k] = max(cosines[k], (float(cosine[k]), key))
                    for k in index.get(joined, ()):
                        same[k] += bool(joined)
            rows = [
                (s["names"][k], *best[k][:3], difflib.SequenceMatcher(None, s["texts"][k], best[k][3], autojunk=False).ratio(), *cosines[k], same[k])
                for k in range(n) if best[k][0] >= 0
            ]
            columns = list(zip(*rows)) or [()] * 8
            types = [pa.string(), pa.float64(), pa.float64(), pa.string(), pa.float64(), pa.float64(), pa.string(), pa.int64()]
            names = ["id", "jaccard", "cosine_of_best", "best_by_grams", "ratio", "cosine", "best_by_cosine", "same"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        part = rows.mapInArrow(work, "id string, jaccard double, cosine_of_best double, best_by_grams string, ratio double, cosine double, best_by_cosine string, same long")
        out = part if out is None else out.unionByName(part)
    gram = F.struct("jaccard", "cosine_of_best", "best_by_grams", "ratio")
    return out.groupBy("id").agg(F.max(gram).alias("_g"), F.max(F.struct("cosine", "best_by_cosine")).alias("_c"), F.sum("same").alias("same_texts")).select(
        F.col("id").alias(heldout_id),
        F.round("_g.jaccard", 6).alias("gram_jaccard"), F.col("_g.best_by_grams").alias("best_by_grams"),
        F.round("_g.ratio", 6).alias("sequence_ratio"),
        F.round("_c.cosine", 6).alias("tfidf_cosine"), F.col("_c.best_by_cosine").alias("best_by_cosine"), "same_texts",
    )


def containment(rows: DataFrame, items: DataFrame, row_id: str, row_text: str, item_id: str, item_text: Column) -> DataFrame:
    """Pairs where the item's words stand in the row's words, as words; found by the item's longest word first.

    Only row ids and words meet the items' longest words; the texts of the pairs that these leave are compared.
    """
    a = rows.select(F.col(row_id).alias("row_id"), F.col(row_text).alias("text")).filter("text is not null")
    b = items.select(F.col(item_id).alias("item_id"), whole_words(item_text).alias("v")).filter(F.size("v") > 0)
    longest = F.array_max(F.transform("v", lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    spaced = lambda w: F.concat(F.lit(" "), F.array_join(w, " "), F.lit(" "))
    b = b.select("item_id", longest.alias("key"), spaced(F.col("v")).alias("needle"))
    keys = a.select("row_id", F.explode(F.array_distinct(whole_words("text"))).alias("key"))
    near = keys.join(b, "key").select("row_id", "item_id", "needle").distinct()
    hay = a.select("row_id", spaced(whole_words("text")).alias("hay"))
    return near.join(hay, "row_id").filter(F.contains("hay", "needle")).select("row_id", "item_id").distinct()
