import datetime as dt

from pyspark.sql import functions as F

from quillframe.streaming import flows


def test_csv_stream(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\nx,1\ny,2\n")
    (tmp_path / "b.csv").write_text('k,v\n"x",3\n')
    stream = flows.parsed(flows.text_stream(spark, str(tmp_path)), "csv", ["k", "v"])
    rows = flows.drained(flows.running_statistics(stream, ["k"], {"s": F.sum(F.col("v").cast("int"))}), "csv_sums", "complete")
    assert sorted(map(tuple, rows.collect())) == [("x", 4), ("y", 2)]


def test_windows_and_late_rows(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    schema = spark.createDataFrame([(t(0), "a", 1.0)], "ts timestamp, k string, v double").schema
    folder = str(tmp_path / "in")
    for k, rows in enumerate([[(t(1), "a", 1.0), (t(4), "a", 2.0)], [(t(30), "a", 5.0)], [(t(2), "a", 100.0), (t(59), "a", 1.0)]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = flows.parquet_stream(spark, folder, schema, per_trigger=1)
    out = flows.windowed(stream, "ts", "5 minutes", ["k"], {"s": F.sum("v"), "n": F.count("*")}, late="10 minutes")
    got = {r["start"].minute: (r["s"], r["n"]) for r in flows.drained(out, "windows").collect()}
    assert set(got) <= {0, 30} and got[30] == (5.0, 1)


def test_sessions(spark, tmp_path):
    t = lambda m: dt.datetime(2024, 1, 1, 0, m)
    folder = str(tmp_path / "in")
    df = spark.createDataFrame([(t(0), "a"), (t(2), "a"), (t(20), "a"), (t(58), "b")], "ts timestamp, k string")
    df.coalesce(1).write.parquet(folder)
    out = flows.sessions(flows.parquet_stream(spark, folder, df.schema), "ts", "5 minutes", ["k"], {"n": F.count("*")}, late="1 minute")
    got = sorted((r["start"].minute, r["n"]) for r in flows.drained(out, "sessions").collect())
    assert got[:2] == [(0, 2), (20, 1)]


def test_validation(spark):
    df = spark.createDataFrame([("7", "x"), ("q", "x y")], "n string, id string")
    rows = flows.validated(df, {"n": "integer!", "id": "NCName!"}).collect()
    assert [r["_bad"] for r in rows] == [[], ["n", "id"]]
