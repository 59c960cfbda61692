import re
from itertools import combinations

from quillframe.llm import ngram_join as J


def brute(rows):
    sets = {}
    for d, t in rows:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        sets[d] = frozenset(zip(*[w[k:] for k in range(5)], strict=False)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    rep = {d: min([e for e in sets if sets[e] == sets[d]]) if sets[d] else d for d in sets}
    reps = sorted(set(rep.values()))
    links = [(a, b) for a, b in combinations(reps, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    low = {r: r for r in reps}
    for _ in reps:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    return {d: (low[rep[d]], rep[d], sum(rep[d] in x for x in links), len(sets[d])) for d in sets}


def result(df):
    return {r["doc_id"]: (r["class_id"], r["copy_of"], r["n_links"], r["n_shingles"]) for r in J.jaccard_classes(df).collect()}


def test_edges(edges, edge_rows):
    assert result(edges) == brute([r[:2] for r in edge_rows])


def test_chains_and_many_near_copies(spark):
    words = [f"w{k}" for k in range(200)]
    rows = [(k, " ".join(words[k : k + 150])) for k in range(0, 40, 2)]  # each like its neighbours: a chain
    rows += [(100 + k, " ".join(words[:60] + [f"x{k}"] + words[61:140])) for k in range(40)]  # one family
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert result(df) == want
    assert {v[0] for d, v in want.items() if d < 100} == {0}
    keep = {r["doc_id"] for r in J.one_of_each(df).collect()}
    assert keep == {v[0] for v in want.values()}


def test_repeated_rows_and_empty(spark, no_documents):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f")], "doc_id long, text string")
    assert [tuple(r)[:4] for r in J.jaccard_classes(df).collect()] == [(1, 1, 1, 0)] * 2
    assert J.jaccard_classes(no_documents).count() == 0


def test_rows_of_one_doc_id(spark):
    """Each text of a doc_id has a result of its own."""
    a, b = "one two three four five six seven", "eight nine ten eleven twelve thirteen"
    got = sorted(tuple(r)[:4] for r in J.jaccard_classes(spark.createDataFrame([(1, a), (1, b), (2, b), (3, a)], "doc_id long, text string")).collect())
    assert got == [(1, 1, 1, 0), (1, 1, 1, 0), (2, 1, 1, 0), (3, 1, 1, 0)]


def test_depth_reaches_recall():
    """Pairs at the threshold need short prefixes, copies long ones; the share found is as asked for."""
    assert J.prefix_depth({24: 100}) == 8 and J.prefix_depth({}) == 8
    d = J.prefix_depth({4: 10_000}, 0.8, 0.9995, 24, 8)
    assert 1 - (1 - 0.8**d) ** 24 >= 0.9995 > 1 - (1 - 0.8 ** (d + 1)) ** 24
    assert d < J.prefix_depth({4: 10, 24: 10_000}, 0.8, 0.9995, 24, 8)


def test_few_texts_at_once(spark, tmp_path, monkeypatch):
    """Python workers get texts by the hundred, not the 10,000 of Spark's default."""
    seen, real = tmp_path / "seen", J._profile

    def profile(depth, trees):
        run = real(depth, trees)

        def watched(batches):
            def each():
                for batch in batches:
                    with open(seen, "a") as f:
                        f.write(f"{len(batch)}\n")
                    yield batch

            return run(each())

        return watched

    monkeypatch.setattr(J, "_profile", profile)
    rows = [(k, f"text number {k} of a table in one part with words {k * 7919}") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert J.jaccard_classes(docs).count() == 1500
    sizes = [int(x) for x in seen.read_text().split()]
    assert sum(sizes) == 1500 and max(sizes) <= 256, sizes
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
