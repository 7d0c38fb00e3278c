import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from sievewright.functions import language as lang
from sievewright.functions import vectors as v
from sievewright.operators import relational as r
from sievewright.operators import statistics as st
from sievewright.operators import training as tr


def val(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()[0]


def arr(*xs, kind="array<double>"):
    return F.array(*[F.lit(x) for x in xs]).cast(kind)


def test_cosine_and_softmax(spark):
    assert round(val(spark, v.cosine(arr(1.0, 0.0), arr(1.0, 1.0))), 6) == 0.707107
    assert val(spark, v.cosine(arr(1.0, 0.0, 9.0), arr(1.0, 0.0))) == 1.0
    assert val(spark, v.cosine(arr(), arr(1.0))) == 0.0 and val(spark, v.cosine(arr(0.0, 0.0), arr(1.0, 1.0))) == 0.0
    assert [round(x, 6) for x in val(spark, v.softmax(arr(0.2, 0.8)))] == [0.354344, 0.645656]
    assert round(val(spark, v.pooled_similarity(arr(0.2, 0.8))), 6) == 0.587394 and val(spark, v.pooled_similarity(arr())) == 0.0
    assert round(val(spark, v.adaptive_beta(arr(0.2, 0.8))), 6) == 0.7 and val(spark, v.adaptive_beta(arr())) == 1.0


def test_odds_ratio(spark):
    assert round(val(spark, v.log1mexp(F.lit(-1.0))), 6) == -0.458675
    assert round(val(spark, v.odds_ratio_loss(F.lit(-1.0), F.lit(-2.0))), 6) == 0.238183
    assert val(spark, v.mean_after(arr(1.0, 2.0, 4.0), F.lit(1))) == 3.0 and val(spark, v.right_padded(arr(1.0), F.lit(3), F.lit(0.0))) == [1.0, 0.0, 0.0]


def test_auc_against_pairs(spark):
    rnd = random.Random(5)
    rows = [(rnd.random() < 0.4, rnd.choice([0.1, 0.2, 0.5, 0.9])) for _ in range(60)] + [(None, 0.3), (True, None)]
    df = spark.createDataFrame(rows, "label boolean, score double").withColumn("g", F.lit(1))
    pos, neg = [s for y, s in rows if y and s is not None], [s for y, s in rows if y is False]
    want = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
    assert math.isclose(st.roc_auc(df, ["g"], "label", "score").first()["auc"], want)
    assert st.roc_auc(df.filter("label"), ["g"], "label", "score").first()["auc"] is None


def test_threshold(spark):
    df = spark.createDataFrame([(0.95, True), (0.9, True), (0.6, False), (0.5, True)], "s double, y boolean").withColumn("g", F.lit(1))
    got = st.precision_threshold(df, ["g"], "y", "s", 0.8).first()
    assert (round(got["threshold"], 6), got["n_selected"], got["precision"]) == (0.61, 2, 1.0)
    assert st.precision_threshold(df.filter("NOT y"), ["g"], "y", "s").count() == 0


def test_threshold_edges_match_products(spark):
    df = spark.createDataFrame([(i * 0.01, True) for i in range(101)], "s double, y boolean").withColumn("g", F.lit(1))
    got = {round(r_["threshold"], 2): r_["n_selected"] for r_ in st.threshold_scan(df, ["g"], "y", "s").collect()}
    assert all(got[round(i * 0.01, 2)] == sum(x * 0.01 >= i * 0.01 for x in range(101)) for i in range(101))


def test_described(spark):
    f = lambda xs: tuple(round(x, 6) for x in spark.createDataFrame([(float(x),) for x in xs], "x double").agg(*st.described("x")).first())
    assert f([1, 2, 4]) == (4, 1, 2.333333, 2.333333, 1.527525) and f([5]) == (5, 5, 5, 0, 0) and f([]) == (0, 0, 0, 0, 0)


def test_prefix_and_numbers(spark):
    df = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "i int, ok boolean")
    assert [tuple(x) for x in r.valid_prefix(df, F.col("ok"), "i").select("i", "next_start").orderBy("i").collect()] == [(1, 3), (2, 3)]
    assert r.valid_prefix(df.limit(0), F.col("ok"), "i").count() == 0
    n = r.row_numbers(spark.range(1000).withColumn("k", F.xxhash64("id")), ["k"])
    rows = sorted(n.collect(), key=lambda x: x["k"])
    assert [x["idx"] for x in rows] == list(range(1, 1001))


def test_dedup_overlay_and_anti(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z"), (None, 4, "w")], "k string, i int, t string")
    assert {(x["k"], x["t"]) for x in r.first_wins(df, ["k"], ["i"]).collect()} == {("a", "x"), (None, "z")}
    assert {(x["k"], x["t"]) for x in r.last_wins(df, ["k"], ["i"]).collect()} == {("a", "y"), (None, "w")}
    assert r.without(df, spark.createDataFrame([("A ",), (None,)], "k string"), ["k"], fold_case=True).count() == 2
    new, old = spark.createDataFrame([(1, "b"), (2, "c")], "i int, t string"), spark.createDataFrame([(2, "a")], "i int, t string")
    assert {(x["i"], x["t"], x["replaced"]) for x in r.overlay(new, old, "i", ["t"]).collect()} == {(1, "b", False), (2, "a", True)}


def test_keyword_combinations(spark):
    l = lambda *xs: arr(*xs, kind="array<string>")  # noqa: E731, E741
    got = val(spark, r.keyword_combinations([l("p"), l("e1", "e2"), l("c"), l("d")], 10))
    assert len(got) == 10 and got[0] == ["p", "e1", "c"] and got[-1] == ["p"]
    assert val(spark, r.keyword_combinations([l("p"), l("P"), l(), F.lit(None).cast("array<string>")], 10)) == [["p", "P"], ["p"]]


def test_first_by_key(spark):
    items = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i")) for i, k in enumerate("abac")])
    assert [x["i"] for x in val(spark, r.first_by_key(items, "k"))] == [0, 1, 3]


def test_jaccards(spark):
    a, b = arr("x", "x", "y", kind="array<string>"), arr("x", "y", "y", kind="array<string>")
    assert val(spark, lang.jaccard(a, b, 0.0)) == 1.0 and val(spark, lang.multiset_jaccard(a, b, 0.0)) == 0.5
    none = arr(kind="array<string>")
    s = val(spark, lang.evidence_scores(none, none, none, none))
    assert (s["ess"], s["ras"], s["esra"]) == (0.0, 1.0, 0.5)


TOKENS = [
    # i, text, lemma, pos, dep, head
    (0, "Add", "add", "VERB", "ROOT", 0), (1, "a", "a", "DET", "det", 3), (2, "null", "null", "NOUN", "compound", 3), (3, "check", "check", "NOUN", "dobj", 0),
    (4, "to", "to", "ADP", "prep", 0), (5, "parse_row.py", "parse_row.py", "PROPN", "pobj", 4),
]


def test_actions_and_concepts(spark):
    rows = [(*t, t[1] in ("a", "to"), False, False) for t in TOKENS]
    df = spark.createDataFrame([(rows,)], "t array<struct<i:int,text:string,lemma:string,pos:string,dep:string,head:int,is_stop:boolean,is_punct:boolean,like_num:boolean>>")
    got = df.select(lang.repair_actions(F.col("t")).alias("a"), lang.cause_concepts(F.col("t")).alias("c")).first()
    assert got["a"] == sorted({"add\tnull check", "add\tcheck", "add\tparse_row.py", "add\trow"})
    assert got["c"] == sorted({"null", "check", "null check", "parse_row.py"})
    with pytest.raises(ValueError):
        lang.extracted(F.col("t"), "other")


def test_bleu():
    assert lang.bleu_of(*lang.bleu_counts("the cat sat on the mat", "the cat sat on the mat")) == pytest.approx(100.0)
    assert lang.bleu_of(*lang.bleu_counts("a b c d", "e f g h")) == 0.0
    m, t, c, ref = lang.bleu_counts("the the the the", "the cat is here")
    assert m[0] == 1 and t == [4, 3, 2, 1] and (c, ref) == (4, 4)
    assert lang.bleu_tokens("It costs 3.5, not 4.") == ["It", "costs", "3.5", ",", "not", "4", "."]


def test_token_budget(spark):
    w = lambda n: " ".join(f"w{i}" for i in range(n))
    rows = [("SFT", w(80), w(40), w(30), "", "", ""), ("ORPO", w(10), w(10), w(5), w(5), w(90), w(90)), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "tag string, p string, b string, wc string, ws string, lc string, ls string")
    cols = {"problem": "p", "slice": "b", "win_rc": "wc", "win_rs": "ws", "lose_rc": "lc", "lose_rs": "ls"}
    got = [x["fitted"] for x in tr.within_tokens(df, cols, "tag", 400, 300).select("fitted").collect()]
    assert len(got[0]["problem"].split()) == 46 and len(got[0]["slice"].split()) == 23 and got[0]["final_total"] == 99
    assert got[1]["final_total"] <= 210 and got[1]["actions"][0].startswith("soft_context") and got[2]["original_total"] == 0


def test_splits_are_stable(spark):
    a = tr.hash_split(spark.range(5000), "id")
    assert abs(a.filter("part = 'train'").count() / 5000 - 0.85) < 0.03
    assert a.exceptAll(tr.hash_split(spark.range(5000).repartition(7), "id")).count() == 0
