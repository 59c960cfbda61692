"""Every catalogue query on the smallest tables; those with an oracle must equal it."""

import math

import duckdb
import pytest

from quillframe.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def shown(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "∅" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, oracle, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in columns) for r in df.collect())
    if name not in catalogue.ORACLE_SQL:
        assert rows
        return
    found = oracle.execute(catalogue.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    place = [names.index(c) for c in columns]
    assert rows == sorted(tuple(shown(r[k]) for k in place) for r in found.fetchall())


def test_entry_and_contract(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["lang", "token", "n"]
    assert set(e.oracle_sql()) <= set(e.queries())
