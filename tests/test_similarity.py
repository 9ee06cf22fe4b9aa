import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lapwing.functions import similarity as S
from lapwing.functions import text as X
from lapwing.params import Params


def test_jaro_anchors():
    assert S.jaro("", "") == 0.0 and S.jaro("a", "") == 0.0 and S.jaro("abc", "abc") == 1.0 and S.jaro("abc", "xyz") == 0.0
    assert round(S.jaro("martha", "marhta"), 6) == 0.944444


@settings(max_examples=150, deadline=None)
@given(st.text("abc", max_size=9), st.text("abc", max_size=9))
def test_lcs_against_brute_force(a, b):
    assert S.lcs_length(a, b) == max([0, *(n for i in range(len(a)) for n in range(1, len(a) - i + 1) if a[i : i + n] in b)])


def test_enhanced_orders_titles(spark):
    pairs = [("attention is all you need", "attention is all you need"), ("attention is all you need", "attention is all you nead"), ("attention is all you need", "quantum soup recipes"), ("", "x")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = {(r.a, r.b): r.s for r in df.join(S.pair_scores(df, "a", "b"), ["a", "b"]).select("a", "b", S.enhanced(F.col("jaro"), F.col("lcs"), F.col("a"), F.col("b"), Params()).alias("s")).collect()}
    same, near, other, none = (got[p] for p in pairs)
    assert same == 1.0 and same > near > other and other < 0.7 and none == 0.0


def test_bag_cosine_and_null_text(spark):
    df = spark.createDataFrame([("a b b", "a b b"), ("a", "b"), (None, "x"), ("x y", "y z")], "a string, b string")
    got = [r.c for r in df.select(X.bag_cosine(X.tokens("a"), X.tokens("b")).alias("c")).collect()]
    assert [round(x, 6) for x in got] == [1.0, 0.0, 0.0, 0.5]


def test_sentence_spans_point_into_the_text(spark):
    rng = random.Random(1)
    texts = ["", None, "One. Two! (Three) x", *("".join(rng.choice(["A", "b", ". ", "? (", " ", "é"]) for _ in range(40)) for _ in range(30))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id int, t string")
    for r in df.select("t", F.explode(X.sentences("t")).alias("s")).collect():
        assert r.t[r.s.span_start : r.s.span_end] == r.s.sentence
