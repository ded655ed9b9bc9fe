import difflib
import math

import pytest
from pyspark.sql import functions as F

from recordloom.functions import code, numeric, text
from recordloom.operators import alignment, records, similarity


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column).first()[0]


def test_words_of_any_text(spark):
    rows = [(1, "ＦＩＮＥ １２"), (2, "ﬁne 12"), (3, "Fine, 12!"), (4, "Cafe\u0301 ß"), (5, "CAFÉ SS"), (6, None), (7, ""), (8, "…")]
    df = spark.createDataFrame(rows, "i long, text string")
    got = {r.i: r.w for r in df.select("i", text.whole_fingerprint("text").alias("w")).collect()}
    assert got == {1: "fine 12", 2: "fine 12", 3: "fine 12", 4: "café ss", 5: "café ss", 6: None, 7: "", 8: ""}
    assert {r.w for r in df.filter("i < 4").select(text.first_words("text", 1).alias("w")).collect()} == {"fine"}
    items = spark.createDataFrame([("h", "the ﬁne １２"), ("k", "FINE")], "h string, p string")
    rows = spark.createDataFrame([(1, "see THE fine 12."), (2, "ﬁne")], "i long, text string")
    found = similarity.containment(rows, items, "i", "text", "h", F.col("p")).collect()
    assert {tuple(r)[:2] for r in found} in ({(1, "h"), (1, "k"), (2, "k")}, {("h", 1), ("k", 1), ("k", 2)})


def test_text(spark):
    t = 'def f():\n    """Sum of a_b,  Straße ÉCOLE 12.\nassert f() == 1\nmore"""'
    assert one(spark, t, text.prompt_body("x")) == "Sum of a_b,  Straße ÉCOLE 12.\nmore"
    assert one(spark, "'''inside''' and \"\"\"later\"\"\"", text.prompt_body("x")) == "inside"
    assert one(spark, "no quotes", text.prompt_body("x")) == "no quotes"
    assert one(spark, "a_b,  Straße ÉCOLE 12.", text.fingerprint("x")) == "a_b strasse école 12"
    assert one(spark, "ﬁne Ⅷ ǅ", text.exact_fingerprint("x")) == "fine viii dž"
    assert one(spark, None, text.fingerprint("x")) is None
    assert one(spark, "one", text.terms("x")) == ["one"]
    assert one(spark, "one two two", text.terms("x")) == ["one", "two", "two", "one␟two", "two␟two"]
    assert one(spark, "abc", text.char_grams("x")) == ["abc"]
    assert one(spark, "abcdefabcde", text.char_grams("x")) == ["abcde", "bcdef", "cdefa", "defab", "efabc", "fabcd"]
    assert one(spark, "```python\nx = 1\n```", text.unwrap_fence("x")) == "x = 1"
    assert one(spark, "say ```x``` now", text.unwrap_fence("x")) == "say ```x``` now"
    assert one(spark, "see /root/a/b.txt and /home/me/x, ok", text.redact_paths("x")[0]) == "see <path> and <path> ok"
    assert one(spark, "see /root/a/b.txt and /home/me/x, ok", text.redact_paths("x")[1]) == 2
    assert one(spark, "key sk-abcdefghijklmnop1234", text.has_access_key("x"))
    assert one(spark, " a\r\nb\rc \n", text.unix_lines("x")) == "a\nb\nc"
    assert one(spark, "p1__attempt_2", text.parse_attempt("x")[1]) == 2
    assert one(spark, "p1__attempt_4", text.parse_attempt("x")[0]) is None
    assert one(spark, " very-hard one", text.name_key("x")) == "VERY_HARD_ONE"
    assert one(spark, "x" * 100_000, F.size(text.char_grams("x"))) == 1


def test_jaccard_of_two_empty_sets_is_one(spark):
    df = spark.createDataFrame([([], []), (["a"], ["a", "b"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(text.jaccard("a", "b")).collect()] == [1.0, 0.5]


def test_gram_likeness_is_the_jaccard_of_the_grams(spark):
    df = spark.createDataFrame([("abcdefg", "cdefgh"), ("", "x"), ("", ""), (None, "x"), ("éàü12é", "àü12éà")], "a string, b string")
    both = df.select(text.gram_likeness("a", "b").alias("x"), text.jaccard(text.char_grams("a"), text.char_grams("b")).alias("y"))
    for r in both.collect():
        assert (r.x is None and r.y is None) or r.x == pytest.approx(r.y)


def test_divergences(spark):
    df = spark.createDataFrame([(-5.0, -9.0)], "p double, q double")
    p, q = math.exp(-0.05), math.exp(-0.09)
    want = p * math.log(p / q) + (1 - p) * math.log((1 - p) / (1 - q))
    assert df.select(numeric.bernoulli_kl(F.col("p"), F.col("q"))).first()[0] == pytest.approx(want)
    assert df.select(numeric.bernoulli_kl(F.lit(0.0), F.lit(0.0))).first()[0] == pytest.approx(0.0)
    assert df.select(numeric.probability(F.lit(-9999.0))).first()[0] == 0.0
    two = spark.createDataFrame([([math.log(0.5), math.log(0.2)], [math.log(0.4), math.log(0.4)])], "p array<double>, q array<double>")
    want = 0.5 * math.log(0.5 / 0.4) + 0.2 * math.log(0.2 / 0.4) + 0.3 * math.log(0.3 / 0.2)
    assert two.select(numeric.sparse_kl(F.col("p"), F.col("q"))).first()[0] == pytest.approx(want)


def test_bytes(spark):
    spelled = [[0xC3], [0xA9, 0x61]]
    df = spark.createDataFrame([(spelled, "éa"), ([[0xC3], None], "é"), ([[0x61]], "b"), ([], "")], "b array<array<int>>, t string")
    assert [r[0] for r in df.select(numeric.bytes_match("b", "t")).collect()] == [True, None, False, True]
    assert one(spark, [1, 300], numeric.bytes_valid("x"), "array<int>") is False
    assert one(spark, [1.0], numeric.padded("x", 3, F.lit(0.0)), "array<double>") == [1.0, 0.0, 0.0]


def two_pointer(a, b):
    out, i, j, c = {}, 0, 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out[("left", i)] = out[("right", j)] = c
            i, j, c = i + 1, j + 1, c + 1
        elif a[i] < b[j]:
            out[("left", i)] = c
            i += 1
        else:
            out[("right", j)] = c
            j += 1
    cut = max((e for e in a if e in b), default=0)
    return {k: v for k, v in out.items() if (a if k[0] == "left" else b)[k[1]] <= cut}


@pytest.mark.parametrize("seed", range(3))
def test_alignment_is_the_two_pointer_walk(spark, seed):
    import random

    rng = random.Random(seed)
    ends = lambda: sorted(rng.sample(range(1, 30), 9)) + [30]
    data = {f"r{k}": (ends(), ends()) for k in range(8)}
    table = lambda s: spark.createDataFrame([(r, i, e) for r, v in data.items() for i, e in enumerate(v[s])], "r string, position int, end_byte long")
    got = alignment.align_tokens(table(0), table(1), "r").collect()
    for r, (a, b) in data.items():
        assert {(x.side, x.position): x.chunk for x in got if x.r == r and x.chunk is not None} == two_pointer(a, b)
    arrays = spark.createDataFrame([(r, *v) for r, v in data.items()], "r string, a array<long>, b array<long>")
    for row in arrays.select("r", alignment.chunk_shapes(F.col("a"), F.col("b")).alias("c")).collect():
        walk = two_pointer(*data[row.r])
        sizes = [(c.left, c.right) for c in row.c]
        want = [(sum(k[0] == "left" and v == i for k, v in walk.items()), sum(k[0] == "right" and v == i for k, v in walk.items())) for i in range(len(sizes))]
        assert sizes == want


def test_token_pieces_cover_the_text(spark):
    df = spark.createDataFrame([("a  bé\n",), ("",), (" ",)], "x string")
    for row in df.select("x", alignment.word_lengths(F.col("x")).alias("w"), alignment.fixed_lengths(F.col("x"), 4).alias("f")).collect():
        assert sum(row.w) == sum(row.f) == len(row.x.encode())
    assert one(spark, [2, 3], alignment.with_ends(F.col("x")), "array<long>") == [2, 5]


def test_labels(spark):
    df = spark.createDataFrame([([5, 6, 2], [False, True, False], [False, False, True])], "t array<int>, k array<boolean>, e array<boolean>")
    labels = alignment.end_labels(F.col("t"), F.col("k"), F.col("e"))
    assert df.select(labels).first()[0] == [-100, 6, 2]
    audit = df.select(alignment.end_audit(labels, F.lit(2)).alias("a")).first().a
    assert (audit.labelled, audit.ends, audit.ends_last) == (2, 1, True)


def test_code(spark):
    df = spark.createDataFrame([("def f(a, b=1):\n    'doc'\n    return eval(a)  # x\nassert f",), ("def (",), (None,)], "x string")
    got = [r.f for r in df.select(code.source_facts("x").alias("f")).collect()]
    assert got[0].asDict() == {"parses": True, "docstring": True, "loose_string": False, "top_assert": True, "forbidden_call": True, "forbidden_import": False}
    assert not got[1].parses and not got[2].parses
    assert [tuple(r.f) for r in df.select(code.first_function("x").alias("f")).collect()] == [("f", "def f(a, b=1)", 2), (None, None, None), (None, None, None)]
    assert [tuple(r.f) for r in df.select(code.comment_counts("x").alias("f")).collect()][0] == (1, 1)
    assert code.assertion_shapes("assert f(1) == x.y\nassert (", "f") == ["Compare(Call(TARGET,int),Eq,NAME.ATTR)", "SYNTAX_ERROR"]
    assert code.normal_assertions("assert  f( 1 )==2", "f") == ["assert target(1) == 2"]


def test_normal_records_and_errors_as_data(spark):
    tok = lambda t, b, lp, top=(): {"token": t, "bytes": b, "logprob": lp, "top_logprobs": [dict(token=x, bytes=None, logprob=y) for x, y in top]}

    def raw(i, status="ok", tokens=None, text="ab", choices=1):
        choice = {"finish_reason": "stop", "message": {"role": "assistant", "content": text}, "logprobs": {"content": tokens}}
        return {"schema_version": "v1", "id": i, "status": status, "response": {"id": "r", "model": "m", "choices": [choice] * choices, "usage": {"t": 2}}}

    rows = [
        raw("good", tokens=[tok("a", [97], -0.1, [("a", -0.1), ("b", -2.5)]), tok("b", [98], -9999.0)]),
        raw("no bytes", tokens=[tok("a", None, -0.1)]), raw("differs", tokens=[tok("a", [97], -0.1)]),
        raw("number", tokens=[tok("a", [97], 0.5)]), raw("byte", tokens=[tok("a", [970], -0.5)]),
        raw("mass", tokens=[tok("a", [97], -0.1, [("a", -0.1), ("b", -0.1)])]), raw("none"), raw("two", tokens=[], choices=2),
        raw("", tokens=[]), raw("skipped", status="error"),
    ]
    normal = records.normalise(spark.createDataFrame(rows, records.RAW))
    good, bad = records.split_errors(normal)
    checks = {r.id: (r.validation.content_bytes_match, r.validation.warnings) for r in good.collect()}
    assert checks == {"good": (True, []), "no bytes": (None, ["bytes missing"]), "differs": (False, [])}
    assert {r.id: r.message for r in bad.collect()} == {
        "number": "bad log-probability", "byte": "bad bytes", "mass": "mass above one", "none": "no tokens", "two": "not one choice", "": "no id"}
    exact = good.select("id", records.exact_trace(F.col("content_tokens"), F.col("response_text")).alias("x"))
    assert {r.id: r.x for r in exact.collect()} == {"good": True, "no bytes": False, "differs": False}
    counts = good.filter("id = 'good'").select(records.trace_counts(F.col("content_tokens"), 2).alias("c")).first().c
    assert tuple(counts) == (2, 2, 1, 0)


def test_release(spark):
    df = spark.createDataFrame([("1", "at /root/x", "sk-abcdefghijklmnop1234"), ("2", None, "fine")], "id string, a string, b string")
    assert [(r.id, r.a, r.redactions) for r in records.released(df, ["id", "a"], ["a"]).collect()] == [("1", "at <path>", 1), ("2", None, 0)]
    assert [r.id for r in records.secrets(df, "id").collect()] == ["1"]
    nested = spark.createDataFrame([], "id string, x struct<api_id:string, y:array<struct<api_id:int>>>").schema
    assert records.forbidden_fields(nested, {"api_id"}, {"x.api_id"}) == ["x.y.api_id"]
    assert {(r.id, r.issue) for r in records.issues(df, "id", {"null": F.col("a").isNull(), "x": F.col("a") == "x"}).collect()} == {("2", "null")}
    assert [(r.id, r.reasons, r.clean) for r in records.with_reasons(df, {"null": F.col("a").isNull()}).collect()] == [("1", [], True), ("2", ["null"], False)]


def test_nearest_texts_against_brute_force(spark):
    train = [("t1", "the red fox jumps over the fence"), ("t2", "a blue fox sleeps under the old fence"), ("t3", None), ("t4", "count the ships in the bay")]
    held = [("h1", "the red fox jumps over a fence"), ("h2", "count ships in a bay"), ("h3", "count the ships in the bay")]
    a, b = spark.createDataFrame(train, "i string, t string"), spark.createDataFrame(held, "h string, x string")
    got = {r.h: r for r in similarity.nearest_texts(a, b, "i", F.col("t"), "h", F.col("x")).collect()}
    texts = [t or "" for _, t in train] + [x for _, x in held]
    df = {}
    for t in texts:
        for w in similarity._terms(similarity.normal_words(t)):
            df[w] = df.get(w, 0) + 1
    vec = lambda t: {w: c * (math.log((1 + len(texts)) / (1 + df[w])) + 1) for w, c in similarity._terms(similarity.normal_words(t)).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for h, x in held:
        grams = similarity._grams(" ".join(similarity.normal_words(x)))
        best = max((len(grams & (g := similarity._grams(" ".join(similarity.normal_words(t))))) / len(grams | g), i, t) for i, t in train if t)
        assert got[h].best_by_grams == best[1] and got[h].gram_jaccard == pytest.approx(best[0], abs=1e-6)
        assert got[h].sequence_ratio == pytest.approx(difflib.SequenceMatcher(None, x, best[2], autojunk=False).ratio(), abs=1e-6)
        v = vec(x)
        cosine = max(sum(v.get(w, 0) * y for w, y in vec(t).items()) / norm(v) / norm(vec(t)) for _, t in train if t)
        assert got[h].tfidf_cosine == pytest.approx(cosine, abs=1e-6)
    assert got["h3"].same_texts == 1 and got["h1"].same_texts == 0


def test_containment(spark):
    a = spark.createDataFrame([(1, "so the red fox, jumps!"), (2, "the red foxes jump"), (3, None)], "i int, t string")
    b = spark.createDataFrame([("x", "Red fox"), ("y", ""), ("z", None)], "h string, x string")
    assert [tuple(r) for r in similarity.containment(a, b, "i", "t", "h", F.col("x")).collect()] == [(1, "x")]
