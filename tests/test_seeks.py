"""Records read behind a sparse index against the records of the whole file."""

import random

import pytest

from quillframe.sources import options, readers, seeks, splits


@pytest.mark.parametrize("every", [1, 3, 50])
@pytest.mark.parametrize("line_break", ["\n", "\r\n"])
def test_seeks_equal_the_scan(spark, tmp_path, every, line_break):
    rng = random.Random(every)
    o = options.resolve(comment="#")
    for k in range(3):
        lines = [rng.choice(["a,b", '"x', 'y"', "", "é日", '# it"s', '"q""r",z']) for _ in range(200)]
        (tmp_path / f"{k}.csv").write_bytes((line_break.join(lines) + (line_break if k else "")).encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        records = {(r.src, r.rec_no): r.value for r in splits.logical_records(spark, str(tmp_path), o)[0].collect()}
        index = seeks.record_index(spark, str(tmp_path), o, every, len(line_break)).cache()
        assert index.count() < len(records) or every == 1
        sources = sorted({s for s, _ in records})
        asked = spark.createDataFrame([(s, n) for s in sources for n in range(-1, 250)] + [("nowhere", 1)], "src string, rec_no long")
        got = {(r.src, r.rec_no): r.value for r in seeks.records_at(index, asked, o, every).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == records


def test_few_bytes_are_read(spark, tmp_path):
    """Record 400,000 of half a million costs a read of a hundred records."""
    (tmp_path / "big.txt").write_text("".join(f"record number {k}\n" for k in range(1, 500_001)))
    o = options.resolve(nl_in_quotes=False)
    index = seeks.record_index(spark, str(tmp_path), o, 100)
    src = index.first().src
    row = seeks.records_at(index, spark.createDataFrame([(src, 400_000)], "src string, rec_no long"), o, 100).first()
    assert row.value == "record number 400000" and row.bytes_read < 2500


def test_wrong_breaks_are_refused(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"a\r\nb\r\n")
    with pytest.raises(ValueError, match="line breaks"):
        seeks.record_index(spark, str(tmp_path), options.resolve(), 10)
    assert readers.splits.read_lines(spark, str(tmp_path)).count() == 2
