"""Identifiers and references of a stream against the batch report, with late definitions and freed state."""

import datetime as dt
import random

from pyspark.sql import functions as F

from quillframe.streaming import flows, identity

SCHEMA = "rec_no long, ts timestamp, ident string, refs string"


def at(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def stream_of(spark, folder, batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
    identity.with_state_store(spark)
    stream = flows.parquet_stream(spark, folder, spark.createDataFrame([], SCHEMA).schema, per_trigger=1)
    return identity.tokens(stream, "rec_no", "ts", F.col("ident"), F.col("refs"))


def test_drained_stream_equals_batch(spark, tmp_path):
    """Half of the definitions come after their references; some are twice there, some never."""
    rng, batches, n = random.Random(2), [], 0
    for _ in range(4):
        rows = []
        for _ in range(25):
            n += 1
            refs = " ".join(f"k{rng.randrange(60)}" for _ in range(rng.randrange(3)))
            rows.append((n, at(n), rng.choice([None, "", f"k{rng.randrange(50)}"]), rng.choice([refs, None, "  "])))
        batches.append(rows)
    tokens = stream_of(spark, str(tmp_path / "in"), [*batches, [(1000, at(10**6), "last", None)], [(1001, at(2 * 10**6), "very last", None)]])
    got = flows.drained(identity.checked(tokens, wait_s=10_000), "identities")
    table = spark.createDataFrame([r for b in batches for r in b], SCHEMA)
    expected = identity.checked_batch(identity.tokens(table, "rec_no", "ts", F.col("ident"), F.col("refs")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))
    assert {r["code"] for r in expected.collect()} == {"DUPID", "IDREF"}


def test_references_wait_and_state_is_freed(spark, tmp_path):
    batches = [
        [(1, at(0), None, "late soon"), (2, at(1), "kept", None)],
        [(3, at(50), "soon", None)],
        [(4, at(500), "other", None)],  # past the wait of `late`
        [(5, at(510), "late", None), (6, at(511), None, "late")],
        [(7, at(5000), "end", None)],  # past what is kept of all before
        [(8, at(5001), "kept", None)],  # forgotten by now, so no duplicate
        [(9, at(90_000), "end of all", None)],
    ]
    tokens = stream_of(spark, str(tmp_path / "in"), batches)
    query = identity.checked(tokens, wait_s=100, keep_s=1000).writeStream.format("memory").queryName("waits").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [tuple(r) for r in spark.table("waits").collect()] == [("IDREF", "late", 1, 1)]
    rows = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert rows[-1] < max(rows)
