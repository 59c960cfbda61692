"""Merkle manifest against a plain recursion over lists."""

import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quillframe.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def digest(parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return digest("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)


def tree(nodes):
    """Root of a list of digests, and each node's (left, right) siblings up to it."""
    paths, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for k, i in enumerate(at):
            run = i // 3 * 3
            paths[k].append(("".join(level[run:i]), "".join(level[i + 1 : run + 3])))
            at[k] = i // 3
        level = [digest(level[i : i + 3]) for i in range(0, len(level), 3)]
    return level[0], paths


def expected(rows):
    """rows: (doc_id, source, lang, n_chars, text)."""
    sources = {}
    for r in rows:
        sources.setdefault(r[1], []).append(r)
    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    low = {}
    for name in names:
        own = sorted(((r[0] is not None, r[0] or 0, leaf(r), r) for r in sources[name]), key=lambda x: x[:3])
        low[name] = (own, *tree([x[2] for x in own]))
    root, above = tree([low[n][1] for n in names])
    out = []
    for name, high in zip(names, above, strict=True):
        own, subroot, paths = low[name]
        for (_, _, h, r), path in zip(own, paths, strict=True):
            reached = h
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                reached = leaf((*r[:4], r[4].replace("\n", "")))
            for left, right in path + high:
                reached = digest((left, reached, right))
            out.append((r[0], h, subroot, root, digest(x for step in path + high for x in step), reached, reached == root))
    return out


def ordered(rows):
    return sorted(map(tuple, rows), key=repr)


def check(spark, rows):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert ordered(merkle.manifest(frame, merkle.without_breaks()).collect()) == ordered(expected(rows))


def test_nulls_repeated_rows_and_odd_texts(spark):
    rows = [
        (5, "b", "en", 3, "a\nb"), (5, "b", "en", 3, "a\nb"), (5, "b", "de", 3, "a\nb"), (None, "b", None, None, None), (2, "b", "en", 1, ""),
        (7, None, "en", 4, "\n\n\n\n"), (1, None, None, 0, None), (9, "é", "fr", 2, "é日\U0001f642"), (10, "z", "en", 2, "alone\n"), (-3, "b", "en", 1, "x" * 100_000 + "\n"),
        (None, None, None, None, None), (8, "Z", "-", 1, "1:1"), (11, "", "", 0, "-"),
    ]
    check(spark, rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_small_trees(spark, n):
    check(spark, [(k, "only", "en", k, f"text\n{k}") for k in range(n)])


def test_trees_of_several_blocks(spark):
    """A source of three supersteps' worth of runs over the block's size, one of a block exactly, one of a block and one, and many small ones."""
    rng, rows = random.Random(1), []
    sizes = {"hot": 1700, "block": merkle.BLOCK, "more": merkle.BLOCK + 1} | {f"s{k:03d}": 1 + k % 5 for k in range(260)}
    for name, n in sizes.items():
        rows += [(len(rows) + k, name, "en", k, rng.choice(["plain", "with\nbreak"])) for k in range(n)]
    rng.shuffle(rows)
    check(spark, rows)


def test_without_probe_all_rows_verify(spark, edges):
    got = merkle.manifest(edges).collect()
    assert len(got) == edges.count() and all(r["verified"] for r in got)
    assert len({r["root"] for r in got}) == 1


def test_any_change_is_seen(spark, edges):
    values = [F.lit("xx") if c == "lang" else F.col(c) for c in merkle.FIELDS]
    probe = F.when(F.col("doc_id") == 5, merkle.leaf_digest(*values))
    got = {r["doc_id"]: r["verified"] for r in merkle.manifest(edges, probe).collect()}
    assert [k for k, ok in got.items() if not ok] == [5]


def test_empty_table(spark, no_documents):
    assert merkle.manifest(no_documents).count() == 0
