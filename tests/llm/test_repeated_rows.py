"""Rows that repeat a doc_id, and rows without one, through the join and the mixture."""

from collections import Counter

from quillframe.llm import mixing, ngram_join

COLUMNS = "doc_id long, text string, source string"


def test_repeated_rows_are_taken_once(spark, make_prose):
    rows = [(7, make_prose(1, 60), "a")] * 200 + [(7, make_prose(2, 60), "a")] + [(None, make_prose(3, 60), "b"), (None, make_prose(3, 60), "b"), (8, make_prose(4, 60), "b")]
    kept = ngram_join.one_of_each(spark.createDataFrame(rows, COLUMNS))
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter({(d, t): 1 for d, t, _ in rows})


def test_mixture_of_repeated_rows(spark, make_prose):
    rows = [(7, make_prose(1, 60), "a")] * 50 + [(None, make_prose(3, 60), "b")] * 3 + [(8, make_prose(4, 60), "b")]
    docs = spark.createDataFrame(rows, COLUMNS)
    taken, size = Counter(), Counter()
    for _, t, s in rows:
        size[s] += len(t.split())
    for r in mixing.mixture(docs).collect():
        taken[r["source"]] += len(r["text"].split())
    target = {r["source"]: r["target"] for r in mixing.mixed(docs).select("source", "target").distinct().collect()}
    assert all(abs(taken[s] - target[s]) <= 1 and taken[s] <= 2 * size[s] for s in size), (taken, target, size)
