"""Relational smoke set over the star schema: joins, grouping sets, windows and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.plans.registry import query
from quillframe.plans.session import table


@query("""
SELECT r_name, n_name, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, n_name
""")
def join_inner(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = rows.join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.groupBy("r_name", "n_name").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O')")
def join_semi(spark, sf_dir):
    hot = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(hot, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def join_anti(spark, sf_dir):
    return table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("""
SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier UNION (SELECT n_nationkey FROM nation EXCEPT SELECT c_nationkey FROM customer)
""")
def set_operations(spark, sf_dir):
    c, s, n = (table(spark, sf_dir, t).select(F.col(k).alias("k")) for t, k in (("customer", "c_nationkey"), ("supplier", "s_nationkey"), ("nation", "n_nationkey")))
    return c.intersect(s).union(n.subtract(c)).distinct()


@query("""
SELECT user_id, event_id, row_number() OVER w AS rn, event_id - lag(event_id) OVER w AS gap, sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) > 50 AS busy
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)
""")
def window_functions(spark, sf_dir):
    w = W.partitionBy("user_id").orderBy("event_id")
    recent = F.sum("value").over(w.rowsBetween(-2, 0))
    gap = F.col("event_id") - F.lag("event_id").over(w)
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("rn"), gap.alias("gap"), (recent > 50).alias("busy"))


@query("""
SELECT c_mktsegment, c_custkey FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rk FROM customer) WHERE rk <= 3
""")
def top_k_per_group(spark, sf_dir):
    rank = F.row_number().over(W.partitionBy("c_mktsegment").orderBy(F.desc("c_acctbal"), "c_custkey"))
    return table(spark, sf_dir, "customer").withColumn("rk", rank).filter("rk <= 3").select("c_mktsegment", "c_custkey")


@query("""
SELECT l_returnflag, l_linestatus, sum(l_quantity)::BIGINT AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus
""")
def pricing_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= F.expr("timestamp_ntz'1998-09-02'"))
    disc = F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2)
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), disc.alias("sum_disc"), F.count("*").alias("n"))


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS hour, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_window(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("hour"), "event_type", "n")
