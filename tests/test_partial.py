"""Merged states against statistics over all rows."""

import random

from pyspark.sql import functions as F

from quillframe.operators import partial


def test_states_stored_and_merged(spark, tmp_path):
    rng = random.Random(3)
    rows = [(k, k % 3, rng.randrange(4000), rng.choice([None, rng.random() * 100])) for k in range(20_000)]
    df = spark.createDataFrame(rows, "k long, g int, u int, v double").repartition(5)
    log = partial.PartialLog().create("n", partial.count()).create("total", partial.total("v")).create("low", partial.least("v")).create("high", partial.greatest("v"))
    log.create("mean", partial.mean("v")).create("head", partial.first("u", "k")).create("tail", partial.last("u", "k"))
    log.create("few", partial.appended("u", "k")).create("users", partial.distinct("u")).create("p90", partial.quantile("v", 0.9))
    for batch in range(4):
        log.states(df.filter(f"k % 4 = {batch}"), ["g"]).write.mode("append").parquet(str(tmp_path / "states"))
    merged = log.merged(spark.read.parquet(str(tmp_path / "states")), ["g"])
    got = {r.g: r for r in log.finished(merged).collect()}
    whole = {r.g: r for r in log.finished(log.states(df, ["g"])).collect()}
    for g in range(3):
        own = [r for r in rows if r[1] == g]
        values = sorted(r[3] for r in own if r[3] is not None)
        a, b = got[g], whole[g]
        assert (a.n, a.low, a.high, a.head, a.tail, a.few) == (b.n, b.low, b.high, b.head, b.tail, b.few)
        assert a.few == [r[2] for r in own] and (a.head, a.tail, a.n) == (own[0][2], own[-1][2], len(own))
        assert abs(a.total - sum(values)) < 1e-6 and abs(a.mean - sum(values) / len(values)) < 1e-9
        users = len({r[2] for r in own})
        assert abs(a.users / users - 1) < 0.05 and abs(b.users / users - 1) < 0.05
        assert abs(sum(v <= a.p90 for v in values) / len(values) - 0.9) < 0.02
    # coarser groups from the same states
    one = log.finished(log.merged(merged, [])).first()
    assert one.n == len(rows) and abs(one.users / len({r[2] for r in rows}) - 1) < 0.05


def test_empty_and_null_groups(spark):
    log = partial.PartialLog().create("n", partial.count()).create("mean", partial.mean("v")).create("users", partial.distinct("v")).create("p", partial.quantile("v", 0.5))
    rows = spark.createDataFrame([(None, None), (None, 2)], "g string, v int")
    merged = log.merged([log.states(rows, ["g"]), log.states(rows.filter(F.lit(False)), ["g"])], ["g"])
    assert [tuple(r) for r in log.finished(merged).collect()] == [(None, 2, 2.0, 1, 2.0)]
