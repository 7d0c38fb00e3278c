"""Incremental runs lose no late item and write no key twice."""

from sievewright.streaming import incremental


def test_late_keys_and_late_repeats(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    history = spark.createDataFrame([("old",)], "k string")

    def go(name, *items):
        (src / name).write_text("".join(f'{{"k": "{k}", "t": "{t}T00:00:00Z"}}\n' for k, t in items))
        s = incremental.fresh(incremental.incoming(spark, str(src), "k string, t timestamp"), ["k"], "t", "1 day", history)
        incremental.append_each(s, out, str(tmp_path / "cp")).awaitTermination(120)
        return sorted(r["k"] for r in spark.read.parquet(out).collect())

    assert go("1.json", ("a", "2024-03-01"), ("old", "2024-03-01")) == ["a"]
    assert go("2.json", ("b", "2024-06-01")) == ["a", "b"]
    # a new key that is months late, a known one long after the lateness, and one of the history that is late
    assert go("3.json", ("late", "2024-01-01"), ("a", "2024-06-02"), ("old", "2024-01-01")) == ["a", "b", "late"]
