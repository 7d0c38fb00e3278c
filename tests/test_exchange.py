"""Answers of services as tables: batches that are done, comparisons, attempts."""

import json

from pyspark.sql import functions as F

from sievewright.functions import vectors as v
from sievewright.operators import relational as r
from sievewright.sources import exchange as x
from sievewright.sources import jsonl


def test_settled_batches(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(["completed", "FAILED ", "in_progress", None, "expired", "cancelled", ""])], "i int, status string")
    assert [(y["done"], y["good"]) for y in x.settled(rows).orderBy("i").collect()] == [(True, True), (True, False), (False, False), (False, False), (True, False), (True, False), (False, False)]


def test_comparisons(spark):
    ch = spark.createDataFrame([("o/a", "b", "h", 1), ("o/a", "b", "h", 2), ("o/a", "", "h", 3), (None, "b", "h", 4)], "repo string, b string, h string, n int")
    assert [tuple(y) for y in x.comparison_requests(ch, "repo", "b", "h").collect()] == [("o/a", "b", "h")]
    answers = spark.createDataFrame([("o/a", "b", "h", json.dumps({"merge_base_commit": {"sha": "m"}, "files": []})), ("o/b", "b", "h", "no json"), ("o/c", "b", "h", None)], "repo string, base string, head string, value string")
    assert {y["repo"]: y["merge_base"] for y in x.merge_bases(answers).collect()} == {"o/a": "m", "o/b": None, "o/c": None}


def test_last_attempts(spark):
    rows = [("a", 1, 0.0, 0.0), ("a", 2, 0.0, 0.3), ("a", 3, 0.5, 0.5), ("b", 1, 0.0, None), ("b", 2, 0.0, 0.0), ("b", 3, 0.0, 0.0), ("b", 4, 0.9, 0.9), ("c", 1, 0.1, 0.0)]
    got = x.last_attempts(spark.createDataFrame(rows, "k string, n int, s double, t double"), "k", "n", ["s", "t"])
    assert {y["k"]: (y["attempts_used"], y["t"]) for y in got.collect()} == {"a": (2, 0.3), "b": (3, 0.0), "c": (1, 0.0)}


def test_pair_scores(spark):
    df = spark.createDataFrame([([[1.0, 0.0], [1.0, 0.0], [1.0, 0.0], [0.0, 1.0]],), ([[1.0, 0.0]] * 3,), (None,)], "v array<array<double>>")
    assert [tuple(y[0]) for y in df.select(v.pair_scores(F.col("v"))).collect()] == [(1.0, 0.0), (0.0, 0.0), (0.0, 0.0)]


def test_top_n(spark):
    df = spark.createDataFrame([("a", 5, 1), ("a", 5, 0), ("a", None, 2), ("a", 9, 3), (None, 1, 4)], "g string, n int, i int")
    assert [(y["g"], y["i"], y["place"]) for y in r.top_n(df, ["g"], "n", 2, ["i"]).orderBy("g", "place").collect()] == [(None, 4, 1), ("a", 3, 1), ("a", 0, 2)]


def test_side_file_and_preview(spark, tmp_path):
    df = spark.range(5).select("id", F.lit("t" * 300).alias("text"), F.rand().alias("r"))
    jsonl.write_with_side_file(df, f"{tmp_path}/main", f"{tmp_path}/side", "id", ["r"])
    main, side = spark.read.json(f"{tmp_path}/main"), spark.read.json(f"{tmp_path}/side")
    assert main.columns == ["id", "text"] and side.columns == ["id", "r"] and main.join(side, "id").count() == 5
    assert [(y["id"], len(y["text"])) for y in jsonl.preview(df, 2, 10, ["id"]).collect()] == [(0, 10), (1, 10)]
