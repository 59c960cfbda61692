from collections import defaultdict

from quillframe.llm import mixing


def brute_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    left, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] >= 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_and_repetitions(edges, edge_rows):
    import re

    got = {r["doc_id"]: r for r in mixing.mixed(edges).collect()}
    size = {d: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t, _, _ in edge_rows}
    by, taken = defaultdict(int), defaultdict(int)
    for d, _, _, s in edge_rows:
        by[s] += size[d]
        taken[s] += got[d]["taken"]
    want = brute_targets(by)
    for d, _, _, s in edge_rows:
        assert got[d]["size"] == size[d] and got[d]["source_size"] == by[s]
        assert abs(got[d]["target"] - want[s]) < 1e-6
        assert 0 <= got[d]["taken"] <= 2 * size[d]
    for s, t in want.items():
        assert abs(taken[s] - t) <= 1
    again = {r["doc_id"]: r["taken"] for r in mixing.mixed(edges.repartition(3)).collect()}
    assert again == {d: r["taken"] for d, r in got.items()}


def test_mixture_takes_what_it_says(edges):
    from pyspark.sql import functions as F

    plan = {r["doc_id"]: r["taken"] for r in mixing.mixed(edges).collect()}
    rows = mixing.mixture(edges)
    assert rows.columns == edges.columns
    got = {r["doc_id"]: r["n"] for r in rows.groupBy("doc_id").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert got == {d: n for d, n in plan.items() if d in got} and all(n == 0 for d, n in plan.items() if d not in got)


def test_empty(no_documents):
    assert mixing.mixed(no_documents).count() == 0 and mixing.mixture(no_documents).count() == 0


def test_repeated_rows(edges):
    twice = edges.union(edges)
    rows = mixing.mixed(twice).collect()
    assert len(rows) == 2 * edges.count() and all(r["taken"] <= 2 * r["size"] for r in rows)
