"""Entities of pages in titles and texts: only those that the SQL names, each up to its semicolon; every page has its row."""

import duckdb
import pytest

from quillframe.plans import catalogue

PAGES = [
    "<html><head><title>a&amp b&am &amp;lt; &quot;x&quot; &nbsp;&</title></head><body><p>a &amp b&lt &copy; &eacute;&quot; &amp;quot; c</body></html>",
    "<html><head><title></title></head><body></body></html>", "<html><body>x &middot;&middot y</body></html>", "", None, "<title>one</title><p>t</p><title>two</title>",
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages"))
    spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").coalesce(1).write.parquet(f"{path}/pages.parquet")
    return path


@pytest.mark.parametrize("name", ["html_title", "tree_text"])
def test_as_in_sql(spark, folder, name):
    con = duckdb.connect()
    con.execute(f"create view pages as select * from read_parquet('{folder}/pages.parquet/*.parquet')")
    assert sorted(map(tuple, catalogue.QUERIES[name](spark, folder).collect())) == sorted(con.execute(catalogue.ORACLE_SQL[name]).fetchall())
