"""Row numbers at a size where a range shuffle samples its bounds: exactly 1..n, with and without adaptive execution."""

import pytest
from pyspark.sql import functions as F

from sievewright.operators.relational import row_numbers, row_slice


@pytest.mark.parametrize("adaptive", ["true", "false"])
@pytest.mark.parametrize("partitions", [16, 200])
def test_every_row_has_a_number_of_its_own(spark, adaptive, partitions):
    n = 1_500_000
    was = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        key = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
        df = spark.range(0, n, 1, 16).select(key.alias("k"), "id", F.repeat(F.md5(F.col("id").cast("string")), 8).alias("wide"))
        out = row_numbers(df, ["k", "id"])
        r = out.agg(F.count(F.lit(1)), F.count_distinct("idx"), F.min("idx"), F.max("idx"), F.sum(F.length("wide"))).first()
        assert tuple(r) == (n, n, 1, n, 256 * n)
        first = [x["id"] for x in df.orderBy("k", "id").limit(5).collect()]
        assert [x["id"] for x in row_slice(out, 1, 5).orderBy("idx").collect()] == first
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_hot_first_key_and_empty(spark):
    df = spark.range(5000).select(F.lit(1).alias("k"), F.col("id"))
    assert [x["id"] for x in row_numbers(df, ["k", "id"]).orderBy("idx").collect()] == list(range(5000))
    assert row_numbers(df.limit(0), ["k", "id"]).count() == 0
