"""Keyword combinations of whole titles against brute force, with lists beyond the caps."""

import itertools

from pyspark.sql import functions as F

from sievewright.operators import relational as r
from sievewright.plans import catalogue

def brute(lists, most=15):
    p, e, c, d = (x or [] for x in lists)
    out, seen = [], set()
    for parts in ((p[:3], e[:4], c[:3]), (p[:3], d[:4], e[:3]), (p[:3], c[:4], d[:3]), (p[:4], [*e, *c, *d][:8]), (p[:5],)):
        for combo in itertools.product(*parts):
            key = "|".join(sorted(x.lower() for x in combo if x))
            if key not in seen and len(out) < most:
                seen.add(key)
                out.append(list(combo))
    return out


def test_caps_and_limit(spark):
    lists = [[f"{k}{i}" for i in range(10)] for k in "pecd"]
    rows = spark.createDataFrame([tuple(lists)], "p array<string>, e array<string>, c array<string>, d array<string>")
    for most in (15, 1000):
        got = rows.select(r.keyword_combinations([F.col(x) for x in "pecd"], most).alias("k")).first()["k"]
        assert got == brute(lists, most)
    assert len(got) == 3 * 4 * 3 * 3 + 4 * 8 + 5


def rows_of(spark, sf):
    out = {}
    for x in catalogue.QUERIES["keyword_combinations"](spark, sf).collect():
        out.setdefault(x["row_id"], []).append(x["keywords"])
    return out


def wanted(title, keywords):
    w = title.split(" ")
    return [" ".join(k) for k in brute([w[0::4], keywords + w[1::4], w[2::4], w[3::4]])]


def test_lists_beyond_the_caps(spark, tmp_path):
    long, short = " ".join(f"t{i}" for i in range(40)), "a b"
    spark.createDataFrame([(1, long, ["k1", "k2"]), (2, short, ["k1", "b"]), (3, None, ["k"]), (4, "x", None)], "row_id long, title string, keywords_used array<string>").write.parquet(f"{tmp_path}/mined_issue.parquet")
    assert rows_of(spark, str(tmp_path)) == {1: wanted(long, ["k1", "k2"]), 2: wanted(short, ["k1", "b"])}


def test_whole_table(spark, sf):
    m = spark.read.parquet(f"{sf}/mined_issue.parquet").filter("keywords_used IS NOT NULL AND title IS NOT NULL").collect()
    assert rows_of(spark, sf) == {x["row_id"]: wanted(x["title"], x["keywords_used"]) for x in m}
