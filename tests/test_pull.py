"""Table functions against the event view and the shredder."""

import pytest
from pyspark.sql import functions as F

from quillframe.operators import pull, schema, tree


@pytest.fixture(scope="module")
def rows(spark):
    pull.register(spark)
    return spark.createDataFrame([(k % 3, k, f"v{k}" if k % 4 else None, k * 10) for k in range(1, 20)], "part int, rec_no long, v string, n int")


def test_events_equal_the_event_view(spark, rows):
    got = spark.sql("SELECT * FROM table_events(TABLE({t}) PARTITION BY (part) ORDER BY (rec_no), 'part', 'rec_no')", t=rows)
    for part in range(3):
        own = rows.filter(f"part = {part}").drop("part")
        expected = schema.event_stream(own, "rec_no")
        assert sorted(tuple(r)[1:] for r in got.filter(F.col("src") == str(part)).collect()) == sorted(map(tuple, expected.collect()))


def test_nodes_equal_the_shredder(spark, rows):
    nodes = spark.sql("SELECT * FROM table_nodes(TABLE({t}) PARTITION BY (part) ORDER BY (rec_no), 'part', 'rec_no')", t=rows.withColumn("part", F.col("part").cast("long")))
    page = {}
    for r in rows.orderBy("rec_no").collect():
        page.setdefault(r.part, []).append(f'<tr><td class="v">{r.v or ""}</td><td class="n">{r.n}</td></tr>')
    again = tree.shred(spark.createDataFrame([(k, f"<table>{''.join(v)}</table>") for k, v in page.items()], "id long, html string"), "id", "html")
    shown = lambda df: sorted(str(tuple(r)) for r in df.select([c.split()[0] for c in tree.NODE.split(", ")]).collect())
    assert shown(nodes) == shown(again)


def test_columns_must_be_there(spark, rows):
    with pytest.raises(Exception, match="name columns"):
        spark.sql("SELECT * FROM table_events(TABLE({t}) PARTITION BY (part), 'part', 'nothing')", t=rows).collect()


def test_empty_table(spark, rows):
    assert spark.sql("SELECT * FROM table_events(TABLE({t}) PARTITION BY (part) ORDER BY (rec_no), 'part', 'rec_no')", t=rows.limit(0)).count() == 0
