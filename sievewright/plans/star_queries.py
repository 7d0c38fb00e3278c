"""Smoke queries of the join, aggregate and window shapes over the star schema and the event table."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievewright.operators.relational import first_wins
from sievewright.plans.text_queries import table


def pricing_summary(spark, sf):
    li = table(spark, sf, "lineitem").filter("l_shipdate <= DATE'1998-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    g = li.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.sum(net).alias("sum_net"), F.avg("l_discount").alias("avg_discount"), F.count(F.lit(1)).alias("n"))
    return g.withColumns({"sum_qty": F.round("sum_qty", 2), "sum_net": F.round("sum_net", 2), "avg_discount": F.round("avg_discount", 6)})


def revenue_by_nation(spark, sf):
    t = lambda n: table(spark, sf, n)
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"), F.countDistinct("o_orderkey").alias("n_orders"))


def latest_order(spark, sf):
    o = first_wins(table(spark, sf, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], last=True)
    return o.select("o_custkey", "o_orderkey", F.round("o_totalprice", 2).alias("o_totalprice"))


def customers_without_orders(spark, sf):
    return table(spark, sf, "customer").join(table(spark, sf, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"))


def event_gaps(spark, sf):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf, "events").withColumn("gap", F.timestamp_diff("SECOND", F.lag("ts").over(w), F.col("ts")))
    s = e.withColumn("session", F.sum(F.when((F.col("gap") > 1800) | F.col("gap").isNull(), 1).otherwise(0)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    return s.groupBy("user_id").agg(F.max("session").cast("long").alias("n_sessions"), F.count(F.lit(1)).alias("n_events"), F.round(F.sum("value"), 2).alias("value"))


QUERIES = {f.__name__: f for f in (pricing_summary, revenue_by_nation, latest_order, customers_without_orders, event_gaps)}

SQL = {
    "pricing_summary": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_net, round(avg(l_discount), 6) AS avg_discount, count(*) AS n FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY 1, 2",
    "revenue_by_nation": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(DISTINCT o_orderkey) AS n_orders FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "latest_order": "SELECT o_custkey, o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1",
    "customers_without_orders": "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) GROUP BY 1",
    "event_gaps": """WITH g AS (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events), s AS (SELECT *, sum(CASE WHEN gap >= INTERVAL 1801 SECOND OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
        SELECT user_id, max(session)::BIGINT AS n_sessions, count(*) AS n_events, round(sum(value), 2) AS value FROM s GROUP BY user_id""",
}
