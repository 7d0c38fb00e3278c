"""The valid prefix ends where the data do, not at a fixed row."""

from sievewright.plans import catalogue


def scored(spark, path, bad):
    rows = [(i, 0.5, None if i == bad else 0.5) for i in range(1, 101)]
    spark.createDataFrame(rows, "row_id long, score1 double, score2 double").write.parquet(f"{path}/scored.parquet")
    return str(path)


def test_prefix_passes_row_41(spark, tmp_path):
    run = catalogue.QUERIES["valid_prefix_by_scores"]
    assert tuple(run(spark, scored(spark, tmp_path / "late", 77)).first()) == (76, 76, 77)
    assert tuple(run(spark, scored(spark, tmp_path / "never", 0)).first()) == (100, 100, 101)
    assert tuple(run(spark, scored(spark, tmp_path / "first", 1)).first()) == (0, None, None)
