"""N-gram Jaccard join: a MinHash LSH forest proposes, exact Jaccard verification decides.

Words are runs of letters and digits, lower case; a document's set holds its five-word
shingles (or, below five words, the one shingle of all its words). Documents with equal
sets are one class and are represented by their smallest doc_id.

The forest has ``TREES`` prefix tries: a document's place in a trie is its ``DEPTH``
min-hashes there, in order, so documents sorted by them meet under common prefixes. Full
prefixes are matched first. How often two documents match over the trees tells how alike
they are; from all such matches follows what share of the pairs above the threshold a
depth finds (each match weighed by the chance of seeing it), and prefixes are shortened
until that share reaches ``RECALL``. Documents that share a prefix of the depth found are
linked; components of those links are families, which are verified exactly in blocks of
``BLOCK`` x ``BLOCK`` set intersections, so a family of any size is spread over many
tasks, no pair is written out, and no pair within a family is left out. All pairs of a
family are looked at because the result counts every link.

Result: one row per document with its class (smallest doc_id of its component of links of
Jaccard >= t), the representative of its equal set, and n_links, the number of other
different sets it is linked to.

Defined cases: null and empty texts have no words, are linked to nothing and are classes
of their own; rows that repeat a doc_id and text repeat their result and are not linked to
one another; rows that repeat a doc_id with another text have a result of their own (their
class is still named by the smallest doc_id in it); rows without doc_id are left out; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.codepoints import BASE, chunks, mix, word_hashes
from quillframe.llm.common import FEW_ROWS, saved, table
from quillframe.llm.components import components

SHINGLE, THRESHOLD, RECALL, TREES, DEPTH, BLOCK = 5, 0.8, 0.9995, 24, 8, 256


def prefix_depth(matches: dict[int, int], threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix that finds the share ``recall`` of the pairs at or above the threshold.

    matches: how many pairs match over the full depth in so many trees. A pair that matches in m of the trees is about
    (m / trees) ** (1 / depth) alike, and stands for 1 / (chance of matching at all) pairs like it.
    """

    def found(s: float, d: int) -> float:
        return 1 - (1 - s**d) ** trees

    alike = {max(threshold, (m / trees) ** (1 / depth)): 0.0 for m in matches}
    for m, n in matches.items():
        s = max(threshold, (m / trees) ** (1 / depth))
        alike[s] += n / found(s, depth)
    whole = sum(alike.values())
    for d in range(depth, 1, -1):
        if not whole or sum(n * found(s, d) for s, n in alike.items()) >= recall * whole:
            return d
    return 1


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    words, at = word_hashes(texts)
    out = []
    rolled = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        rolled = rolled * BASE + words[k : len(words) - SHINGLE + 1 + k]
    rolled = mix(rolled)
    for lo, hi in zip(at[:-1], at[1:], strict=True):
        if hi - lo >= SHINGLE:
            out.append(np.unique(rolled[lo : hi - SHINGLE + 1]))
        elif hi > lo:
            value = np.zeros(1, np.uint64)
            for w in words[lo:hi]:
                value = value * BASE + w
            out.append(mix(value + np.uint64(hi - lo)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _draws(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * BASE) | np.uint64(1)


def signatures(sets: list[np.ndarray], n: int) -> np.ndarray:
    """(sets, n) min-hashes; sets must not be empty."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), n), np.uint32)
    turned = np.empty_like(flat)
    for k, m in enumerate(_draws(n)):
        np.multiply(flat, m, out=turned)  # the high half of an odd multiple: a permutation's order, nearly
        out[:, k] = np.minimum.reduceat((turned >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _profile(depth: int, trees: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [t if isinstance(t, str) else "" for t in batch["text"]]
            for part in chunks([len(t) for t in texts], 400_000):
                sets = shingle_sets(texts[part])
                full = [k for k, s in enumerate(sets) if len(s)]
                places: list[list[bytes]] = [[] for _ in sets]
                if full:
                    tries = signatures([sets[k] for k in full], trees * depth).astype(">u4")
                    width = 4 * depth
                    for k, row in zip(full, tries, strict=True):
                        raw = row.tobytes()
                        places[k] = [raw[j * width : (j + 1) * width] for j in range(trees)]
                digest = [(int(mix(s).sum(dtype=np.uint64)), int(mix(s ^ BASE).sum(dtype=np.uint64)) + len(s)) if len(s) else (0, 0) for s in sets]
                yield pd.DataFrame(
                    {
                        "doc_id": batch["doc_id"].iloc[part].to_numpy(),
                        "th": batch["th"].iloc[part].to_numpy(),
                        "n": [len(s) for s in sets],
                        "set_a": np.array([d[0] & (2**64 - 1) for d in digest], np.uint64).view(np.int64),
                        "set_b": np.array([d[1] & (2**64 - 1) for d in digest], np.uint64).view(np.int64),
                        "places": places,
                    }
                )

    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for part in chunks([len(t) for t in batch["text"]], 400_000):
            sets = shingle_sets(batch["text"].iloc[part].tolist())
            yield batch.iloc[part].drop(columns="text").assign(shingles=[s.tobytes() for s in sets])


def _incidence(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles as small numbers: (row, column) of each member, and the sizes."""
    flat = np.concatenate(sets)
    _, column = np.unique(flat, return_inverse=True)
    return np.repeat(np.arange(len(sets)), [len(s) for s in sets]), column, np.array([len(s) for s in sets])


def intersections(left: list[np.ndarray], right: list[np.ndarray], most: int = 4096) -> np.ndarray:
    """|a & b| of every left and right set, by matrix products over slices of the shingles both sides have."""
    common = np.intersect1d(np.concatenate(left), np.concatenate(right))
    out = np.zeros((len(left), len(right)), np.float32)

    def placed(sets):
        flat, row = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.searchsorted(common, flat)
        ok = (at < len(common)) & (common[np.minimum(at, max(0, len(common) - 1))] == flat) if len(common) else np.zeros(len(flat), bool)
        order = np.argsort(at[ok], kind="stable")
        return row[ok][order], at[ok][order]

    (lr, lc), (rr, rc) = placed(left), placed(right)
    for lo in range(0, len(common), most):
        hi = min(len(common), lo + most)
        a, b = np.zeros((len(left), hi - lo), np.float32), np.zeros((len(right), hi - lo), np.float32)
        i, j = np.searchsorted(lc, [lo, hi]), np.searchsorted(rc, [lo, hi])
        a[lr[i[0] : i[1]], lc[i[0] : i[1]] - lo] = 1
        b[rr[j[0] : j[1]], rc[j[0] : j[1]] - lo] = 1
        out += a @ b.T
    return out


def _verify(threshold: float):
    """One pair of blocks of a family: the number of links of each document, and links enough to connect what is connected."""

    def run(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        bi, bj = key[1], key[2]
        sides = []
        for b in dict.fromkeys((bi, bj)):
            rows = group[group["block"] == b]
            sides.append((rows["rep"].to_numpy(np.int64), [np.frombuffer(s, np.uint64) for s in rows["shingles"]]))
        (ids, sets), (ids2, sets2) = sides[0], sides[-1]
        if not len(ids) or not len(ids2):
            return pd.DataFrame({"doc": [], "other": [], "links": []}).astype("int64")
        shared = intersections(sets, sets2)
        n, m = np.array([len(s) for s in sets]), np.array([len(s) for s in sets2])
        linked = shared >= threshold * (n[:, None] + m[None] - shared) - 1e-6
        linked &= ids[:, None] != ids2[None]
        rows, best = [], []
        for mine, theirs, hit in ((ids, ids2, linked), (ids2, ids, linked.T)) if bi != bj else ((ids, ids2, linked),):
            some = hit.any(axis=1)
            rows.append(pd.DataFrame({"doc": mine[some], "other": mine[some], "links": hit[some].sum(axis=1)}))
            best.append((mine, theirs, hit))
        for a, b in _forest(*best[0]):
            rows.append(pd.DataFrame({"doc": [a], "other": [b], "links": [0]}))
        return pd.concat(rows).astype("int64")

    return run


def _forest(left: np.ndarray, right: np.ndarray, hit: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links of a block."""
    root: dict[int, int] = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(hit), strict=True):
        a, b = int(left[i]), int(right[j])
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _prefix(depth: int):
    """The first min-hashes of a place in a trie as one number."""
    return F.xxhash64("tree", F.substring("place", 1, 4 * depth)).alias("prefix")


def _under_one_prefix(tries: DataFrame, depth: int) -> DataFrame:
    """(a, b): every node under a prefix of the depth with the least node under it."""
    placed = tries.select("node", _prefix(depth))
    first = placed.groupBy("prefix").agg(F.min("node").alias("low"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return placed.join(first, "prefix").select(F.col("node").alias("a"), F.col("low").alias("b"))


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """docs (doc_id, text) to (doc_id, class_id, copy_of, n_links, n_shingles)."""
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("th")).filter("doc_id is not null")
    profile = saved(docs.mapInPandas(_profile(depth, trees), "doc_id long, th long, n long, set_a long, set_b long, places array<binary>"), settings=FEW_ROWS)
    reps = profile.filter("n > 0").groupBy("set_a", "set_b").agg(F.min_by(F.struct("places", "n"), F.struct("doc_id", "th")).alias("of"), F.min(F.struct("doc_id", "th")).alias("at"))
    # a class of equal sets is a node with a number of its own
    reps = saved(reps.select(F.monotonically_increasing_id().alias("node"), "set_a", "set_b", F.col("at.doc_id").alias("rep"), "at.th", "of.places"))
    tries = reps.select("node", F.posexplode("places").alias("tree", "place"))
    full = _under_one_prefix(tries, depth).filter("a <> b").groupBy("a", "b").agg(F.count("*").alias("m"))
    # a row per number of trees
    seen = {r["m"]: r["pairs"] for r in full.groupBy(F.least("m", F.lit(trees)).alias("m")).agg(F.count("*").alias("pairs")).collect()}
    families = saved(components(_under_one_prefix(tries, prefix_depth(seen, threshold, recall, trees, depth))))

    sizes = families.groupBy("component").agg(F.count("*").alias("size"))
    members = families.join(sizes, "component").withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    members = members.withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    members = members.join(reps.select("node", F.col("rep").alias("doc_id"), "th"), "node").select("node", "doc_id", "th", "component", "blocks", "block")
    # a merge join at every size: what it shuffles grows with the texts, and no member table is ever broadcast
    wide = docs.join(members.hint("merge"), ["doc_id", "th"]).dropDuplicates(["doc_id", "th"])
    sets = wide.select(F.col("node").alias("rep"), "component", "blocks", "block", "text")
    sets = sets.mapInPandas(_sets, "rep long, component long, blocks int, block int, shingles binary")
    with_block = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("block")).alias("bi"), F.greatest(o, F.col("block")).alias("bj")))
    pairs = sets.withColumn("at", F.explode(with_block)).select("component", F.col("at.bi").alias("bi"), F.col("at.bj").alias("bj"), "block", "rep", "shingles")
    found = saved(pairs.groupBy("component", "bi", "bj").applyInPandas(_verify(threshold), "doc long, other long, links long"), settings=FEW_ROWS)

    links = found.filter("links > 0").groupBy(F.col("doc").alias("node")).agg(F.sum("links").alias("n_links"))
    linked = components(found.filter("doc <> other").select(F.col("doc").alias("a"), F.col("other").alias("b")))
    named = reps.select("set_a", "set_b", "rep", "node").join(linked, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("rep").alias("class_id"))
    named = named.join(least, "component").select("set_a", "set_b", "rep", "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    known = profile.filter("n > 0").join(named, ["set_a", "set_b"]).select("doc_id", "class_id", F.col("rep").alias("copy_of"), "n_links", F.col("n").alias("n_shingles"))
    own = profile.filter("n = 0").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"), F.lit(0).cast("long").alias("n_shingles"))
    return known.unionByName(own)


def op10_ngram_join(spark, sf_dir):
    return jaccard_classes(table(spark, sf_dir, "documents"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Keeps one row of each class, that of its smallest doc_id; rows that repeat a doc_id, or have none, are documents like any other."""
    rows = saved(docs.withColumn("__qf_row", F.monotonically_increasing_id()))
    classes = jaccard_classes(rows.select(F.col("__qf_row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "class_id")
    ids = rows.select(F.col("__qf_row").alias("row"), F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col("__qf_row").alias("row")).alias("at"))
    keep = classes.join(ids, "row").groupBy("class_id").agg(F.min("at").alias("at")).select(F.col("at.row").alias("__qf_row"))
    return rows.join(keep, "__qf_row", "left_semi").select(*docs.columns)


OP10_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM words),
classes AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY list_sort(s)) END AS rep FROM sets),
members AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets JOIN classes USING (doc_id) WHERE doc_id = rep),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM members a JOIN members b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING count(*) >= 0.8 * (a.n + b.n - count(*)) - 1e-6),
reach(a, b) AS (SELECT a, b FROM pairs UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON r.b = p.a),
low AS (SELECT a, least(a, min(b)) AS class_id FROM reach GROUP BY a),
links AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT c.doc_id, coalesce(low.class_id, c.rep) AS class_id, c.rep AS copy_of, coalesce(n_links, 0) AS n_links, c.n AS n_shingles
FROM classes c LEFT JOIN low ON low.a = c.rep LEFT JOIN links ON links.a = c.rep
"""
