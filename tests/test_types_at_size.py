"""The types over many orders: values are tested once each, and by many tasks also where one task reads the file."""

from pyspark.sql import functions as F

from quillframe.functions import udfs
from quillframe.plans import type_queries

SF = "/root/testdata/sf0.001"


def test_many_tasks_and_each_value_once(spark):
    report = type_queries.all_types_report(spark, SF)
    plan = report._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan ==") :]
    assert "REPARTITION_BY_NUM" in physical  # dealt out before the values are made
    # the counts stand above the grouping by value
    assert "keys=[v#" in physical and physical.index("ArrowEvalPython") < physical.index("keys=[v#")


def test_compiles(spark):
    rows = [("a.b|c^$", True), ("(", False), (")", False), ("[", False), ("*", False), ("+1", False), ("?", False), ("\\", False), ("a{2,1}", False), ("]}", True), ("(a)", True), ("", True), (None, None)]
    got = spark.createDataFrame(rows, "v string, want boolean").select(udfs.compiles(F.col("v")).alias("got"), "want").collect()
    assert [r["got"] for r in got] == [r["want"] for r in got]


def test_repeated_orders_count_each_time(spark, tmp_path):
    """Counts are of values, not of different values."""
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    orders.union(orders).write.parquet(f"{tmp_path}/orders.parquet")
    once = {r["type"]: r["good"] for r in type_queries.all_types_report(spark, SF).collect()}
    twice = {r["type"]: r["good"] for r in type_queries.all_types_report(spark, str(tmp_path)).collect()}
    assert twice == {k: 2 * n for k, n in once.items()} and once["string"] == 46 * orders.count()
