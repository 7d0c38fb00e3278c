import json

import pytest
from pyspark.sql import functions as F

from sievewright.sources import exchange, jsonl
from sievewright.streaming import incremental


def test_tolerant_and_strict(spark, tmp_path):
    p = tmp_path / "x.jsonl"
    p.write_text('{"a": 1, "b": "x"}\n\n  \nnot json\nnull\n[1]\n"s"\n{"a": 2}\n')
    assert [tuple(r) for r in jsonl.tolerant(spark, str(p), "a int, b string").orderBy("a").collect()] == [(1, "x"), (2, None)]
    good, counts = jsonl.with_rejects(spark, str(p), "a int, b string")
    assert good.count() == 2 and tuple(counts.first()) == (2, 3)
    with pytest.raises(Exception):
        jsonl.strict(spark, str(p), "a int, b string").collect()
    assert jsonl.tolerant(spark, str(tmp_path / "none"), "a int", missing_ok=True).count() == 0


def test_arrays_and_sniffing(spark, tmp_path):
    p = tmp_path / "x.json"
    p.write_text(json.dumps([{"k": "a", "v": 1}, {"k": "b", "v": 2}, {"k": "a", "v": 3}]))
    assert {tuple(r) for r in jsonl.array_file(spark, str(p), "k string, v int", "k").collect()} == {("a", 3), ("b", 2)}
    assert jsonl.sniffed(spark, str(p), "k string, v int").count() == 3
    q = tmp_path / "y.jsonl"
    q.write_text('{"k": "a", "v": 1}\nbad\n')
    assert jsonl.sniffed(spark, str(q), "k string, v int").count() == 1


def test_numbered_lines_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(3, "c", [1.0]), (1, "a", None), (2, None, [2.0])], "i int, t string, e array<double>")
    jsonl.write_ordered(df, str(tmp_path / "o"), "i", F.col("t").isNotNull())
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()]
    assert len(lines) == 3 and lines.count("null") == 1
    jsonl.write_with_side_file(df, str(tmp_path / "m"), str(tmp_path / "s"), "i", ["e"])
    assert "e" not in spark.read.json(str(tmp_path / "m")).columns and set(spark.read.json(str(tmp_path / "s")).columns) == {"i", "e"}
    jsonl.write_log(df, str(tmp_path / "l"), "row %s: %s", "i", "t")
    n = jsonl.numbered_lines(spark, str(tmp_path / "l")).groupBy("file").agg(F.min("line_no"), F.max("line_no"), F.count("*"))
    assert all(r[1] == 1 and r[2] == r[3] for r in n.collect())
    assert jsonl.preview(spark.createDataFrame([("x" * 999,)], "t string")).first()[0] == "x" * 200


def test_resume(spark, tmp_path):
    seen = []
    run = lambda d: (seen.append(d.count()), d.withColumn("done", F.lit(1)))[1]
    items = spark.createDataFrame([("a",), ("b",)], "model string")
    assert jsonl.resume(items.limit(1), str(tmp_path / "r"), "model", run).count() == 1
    assert jsonl.resume(items, str(tmp_path / "r"), "model", run).count() == 2 and seen == [1, 1]


def test_batches_and_answers(spark):
    req = spark.range(95).select(F.concat(F.lit("r"), "id").alias("custom_id"), F.lit("x" * 10).alias("line"))
    b = exchange.batches(req, 20, 10**9).groupBy("batch").count()
    assert b.count() > 4 and b.agg(F.sum("count")).first()[0] == 95
    resp = spark.createDataFrame([('{"custom_id":"r1","content":"hi"}',), ("junk",)], "value string")
    assert exchange.answered(req, resp).filter("content IS NOT NULL").count() == 1


def test_streams(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    (src / "1.json").write_text('{"k": "a", "t": "2024-01-01T00:00:00Z"}\n{"k": "a", "t": "2024-01-01T00:01:00Z"}\n{"k": "old", "t": "2024-01-01T00:01:00Z"}\n')
    history = spark.createDataFrame([("old",)], "k string")

    def go():
        s = incremental.fresh(incremental.incoming(spark, str(src), "k string, t timestamp"), ["k"], "t", "1 day", history)
        incremental.append_each(s, out, str(tmp_path / "cp")).awaitTermination(120)

    go()
    assert [r["k"] for r in spark.read.parquet(out).collect()] == ["a"]
    (src / "2.json").write_text('{"k": "a", "t": "2024-01-01T00:02:00Z"}\n{"k": "b", "t": "2024-01-01T00:03:00Z"}\n')
    go()
    assert sorted(r["k"] for r in spark.read.parquet(out).collect()) == ["a", "b"]


def test_windowed_counts(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.json").write_text('{"k": "a", "t": "2024-01-01T00:00:30Z"}\n{"k": "a", "t": "2024-01-01T00:00:40Z"}\n{"k": "b", "t": "2024-01-01T00:10:00Z"}\n')
    q = incremental.windowed_counts(incremental.incoming(spark, str(src), "k string, t timestamp"), "t", "k", "1 minute", "1 minute")
    h = q.writeStream.outputMode("complete").format("memory").queryName("wc").trigger(availableNow=True).start()
    h.awaitTermination(120)
    assert {(r["k"], r["n"]) for r in spark.sql("SELECT * FROM wc").collect()} == {("a", 2), ("b", 1)}
