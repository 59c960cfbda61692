"""Tables sent through streams and drained into tables again."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.plans.registry import query
from quillframe.plans.session import scratch, table
from quillframe.streaming import flows, identity


@query("""
WITH ids AS (SELECT c_custkey::VARCHAR AS id, c_custkey AS rec_no FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT conv_id::VARCHAR, 10000000 + conv_id * 100 + turn FROM conversations),
refs AS (SELECT o_custkey::VARCHAR AS id, 20000000 + o_orderkey AS rec_no FROM orders)
SELECT 'DUPID' AS code, id, rec_no, 1::BIGINT AS n FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY rec_no) AS k FROM ids) WHERE k > 1
UNION ALL SELECT 'IDREF', id, min(rec_no), count(*) FROM refs WHERE id NOT IN (SELECT id FROM ids) GROUP BY id
""")
def stream_identities(spark, sf_dir):
    """Customers and turns as records with identifiers, orders as records that refer to them: the references come first, the report is that of a batch."""
    ids = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").cast("string").alias("ident"), F.col("c_custkey").alias("rec_no"))
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("ident"), (F.col("conv_id") * 100 + F.col("turn") + 10_000_000).alias("rec_no"))
    refs = table(spark, sf_dir, "orders").select((F.col("o_orderkey") + 20_000_000).alias("rec_no"), F.col("o_custkey").cast("string").alias("refs"))
    folder = scratch(spark)
    # two last records move event time on, past all that waits
    ends = spark.createDataFrame([(30_000_000, 10**6), (30_000_001, 2 * 10**6)], "rec_no long, late long")
    for rows in (refs, ids.unionByName(turns), ends.filter("rec_no = 30000000"), ends.filter("rec_no = 30000001")):
        full = spark.createDataFrame([], "rec_no long, ident string, refs string, late long").unionByName(rows.withColumn("rec_no", F.col("rec_no").cast("long")), allowMissingColumns=True)
        full = full.withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("late", F.lit(0)))).withColumn("ident", F.when(F.col("late").isNotNull(), F.concat(F.lit("end "), "rec_no")).otherwise(F.col("ident")))
        full.drop("late").write.mode("append").parquet(folder)
    identity.with_state_store(spark)
    stream = flows.parquet_stream(spark, folder, spark.read.parquet(folder).schema, per_trigger=64)
    tokens = identity.tokens(stream, "rec_no", "ts", F.col("ident"), F.col("refs"))
    return flows.drained_to(identity.checked(tokens, wait_s=10_000), scratch(spark))
