"""Open elements over ranges of events against the shredder's numbers and a plain stack."""

import random

import pytest

from quillframe.operators import stack, tree
from test_sweeps import random_page


@pytest.mark.parametrize("size", [1, 3, 10, 1000])
def test_against_the_shredder(spark, size):
    rng = random.Random(size)
    rows = [(k, random_page(rng, rng.randrange(1, 80))) for k in range(12)]
    nodes = tree.shred(spark.createDataFrame(rows, "id long, html string").repartition(3), "id", "html").cache()
    got = stack.opened(stack.events_of(nodes), ["a", "b"], size).collect()
    starts = {(r.doc_id, r.pointer): (r.depth, r.path, r.name) for r in got if r.event != "end"}
    assert starts == {(r.doc_id, r.pointer): (r.depth, r.path, r.name) for r in nodes.collect()}
    ends = [r for r in got if r.event == "end"]
    assert all(r.ok for r in ends) and {(r.doc_id, r.pointer) for r in ends} == {(r.doc_id, r.pointer) for r in nodes.filter("kind = 'element'").collect()}
    for r in got:
        levels = [k for k, n in enumerate(r.path.split("/"), 1) if n in ("a", "b")]
        assert (r.n_open, r.innermost, r.outermost) == (len(levels), levels[-1] if levels else -1, levels[0] if levels else -1)


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_unbalanced_events(spark, size):
    rng = random.Random(9)
    rows, expected = [], {}
    for doc in range(15):
        names, counts = [], [0]
        for k in range(rng.randrange(1, 40)):
            event, name = rng.choice([("start", "a"), ("start", "b"), ("end", "a"), ("end", "b"), ("text", "#text")])
            rows.append((doc, k, event, name))
            if event == "end":
                expected[doc, k] = (len(names), "/".join(names), "/".join(map(str, counts[:-1])), bool(names) and names[-1] == name)
                if names:
                    names.pop()
                    counts.pop()
                continue
            counts[-1] += 1
            expected[doc, k] = (len(names) + 1, "/".join([*names, name]), "/".join(map(str, counts)), None)
            if event == "start":
                names.append(name)
                counts.append(0)
    events = spark.createDataFrame(rows, "doc_id long, ord long, event string, name string").repartition(4)
    got = {(r.doc_id, r.ord): (r.depth, r.path, r.pointer, r.ok) for r in stack.opened(events, size=size).collect()}
    assert got == expected


def test_no_events(spark):
    assert stack.opened(spark.createDataFrame([], "doc_id long, ord long, event string, name string")).count() == 0
