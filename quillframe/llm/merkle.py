"""A Merkle manifest of a dataset by supersteps over blocks of its tree, and proofs that check rows.

Every row is a leaf, each source has a tree of its leaves in order of doc_id, and the
sources' roots, in order of source, are the leaves of the last tree. Runs of ``ARITY``
consecutive nodes become their parent.

1. Leaves are hashed by Spark's own functions where the texts are read; only digests go on.
2. Places. Leaves are range-partitioned by (source, doc_id, leaf), numbered within their
   partition, and shifted by what earlier partitions hold of their source, so a source of
   any size is dealt over many tasks. Equal rows are told apart by a number of their own.
3. Upward supersteps. A vertex is a block: the subtree of ``BAND`` levels over 3^BAND
   consecutive nodes. Nodes send their digests to their block; a block that has them hashes
   up to its top and sends that on as a node of the next superstep. A tree is complete when
   one node is left; all trees climb at once. Each superstep is written to the shared folder.
4. Downward supersteps. A complete tree's top is told its siblings in the tree above; each
   block gets its top's path, adds the siblings within, and sends to each of its nodes the
   path of siblings from there to the root. Leaves end with their whole path: one message
   for each block of leaves is shuffled, not one for each leaf.

A group is one block: 243 digests and one path, whose length is the height of the trees.
The driver sees the root and the size of the largest tree.

Defined cases: null is hashed as `-` in any column; rows without doc_id come first in their
source and are not tampered with; rows that repeat a doc_id are leaves of their own, in
order of their digests; rows without source are a source, the first; a table of one row has
that leaf as root; an empty table gives an empty result; extra columns are not hashed.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pandas as pd
from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.llm.common import partitions, saved, table

#: Nodes of a run; levels of a block.
ARITY, BAND = 3, 5
BLOCK = ARITY**BAND
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: A node as it climbs: its tree, the tree's number of nodes on this level, its place among them, its digest.
_NODE = "tree string, size long, place long, digest string"
Path = list[tuple[str, str]]


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(*values: Column) -> Column:
    """Digest of a row: each value with its length in bytes before it."""
    return F.sha2(F.concat(*map(_field, values)), 256)


def _hashed(parts: Iterable[str]) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def _parents(level: list[str]) -> list[str]:
    return [_hashed(level[k : k + ARITY]) for k in range(0, len(level), ARITY)]


def _levels(size: int) -> int:
    """Levels that a block of a tree with so many nodes climbs."""
    n = 0
    while size > 1 and n < BAND:
        size, n = -(-size // ARITY), n + 1
    return n


def _bands(size: int) -> int:
    """Supersteps from so many nodes to their top; one at least."""
    n = 1
    while size > BLOCK:
        size, n = -(-size // BLOCK), n + 1
    return n


def _subtree(digests: list[str], size: int) -> list[list[str]]:
    """A block's levels, from its nodes to its top."""
    out = [digests]
    for _ in range(_levels(size)):
        out.append(_parents(out[-1]))
    return out


def _way_up(levels: list[list[str]], slot: int) -> Path:
    """(left, right) siblings of one node of a block, level by level."""
    out = []
    for level in levels[:-1]:
        run = slot - slot % ARITY
        out.append(("".join(level[run:slot]), "".join(level[slot + 1 : run + ARITY])))
        slot //= ARITY
    return out


def numbered(nodes: DataFrame, order: list[str]) -> DataFrame:
    """Adds ``place``, a row's number from 0 in its tree in this order (nulls first), and ``size``, the tree's number of rows.

    ``nodes`` is a written table, so its range bounds are sampled without making it again.
    """
    by = [F.asc_nulls_first(c) for c in ["tree", *order, "_same"]]
    plain = nodes.withColumn("_same", F.monotonically_increasing_id())
    ranged = plain.repartitionByRange(partitions(nodes.sparkSession), *by).sortWithinPartitions(*by).withColumn("_part", F.spark_partition_id()).drop("_same")

    def count_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, n = object(), 0
        for batch in batches:
            at = []
            for tree in batch["tree"]:
                tree = tree if isinstance(tree, str) else None
                if tree != last:
                    last, n = tree, 0
                at.append(n)
                n += 1
            yield batch.assign(_at=at)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranged.schema.fields)
    placed = saved(ranged.mapInPandas(count_up, fields + ", _at long"))
    held = placed.groupBy("tree", "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy("tree").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shifts = saved(held.select(F.col("tree").alias("_t"), F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"), F.sum("_n").over(W.partitionBy("tree")).alias("size")))
    rows = placed.join(shifts, (F.col("_part") == F.col("_p")) & F.col("tree").eqNullSafe(F.col("_t")))
    return rows.withColumn("place", F.col("_at") + F.col("_shift")).drop("_t", "_p", "_part", "_at", "_shift")


def _to_block(key: tuple) -> int:
    return zlib.crc32(repr(key).encode())


def _sent(nodes: DataFrame, *payload: str) -> RDD:
    """Messages of nodes to their blocks: ((tree, block), (size, slot, digest, payload))."""
    return nodes.select("tree", "size", "place", "digest", *payload).rdd.map(lambda r: ((r[0], r[2] // BLOCK), (r[1], r[2] % BLOCK, r[3], *r[4:])))


def _complete(item: tuple) -> tuple[str, int, int, str]:
    """A block that has its nodes: its top, as a node of the next superstep."""
    (tree, block), nodes = item
    nodes = sorted(nodes)
    size = nodes[0][0]
    return tree, -(-size // ARITY ** _levels(size)), block, _subtree([n[2] for n in nodes], size)[-1][0]


def climbed(nodes: DataFrame) -> list[DataFrame]:
    """The nodes of each superstep, the given ones first; the trees' tops are last in their last one."""
    spark, steps = nodes.sparkSession, [nodes]
    largest = nodes.agg(F.max("size")).first()[0] or 0
    while largest > 1:
        going = steps[-1].filter("size > 1")
        tops = _sent(going).groupByKey(partitions(spark), _to_block).map(_complete)
        steps.append(saved(spark.createDataFrame(tops, _NODE, verifySchema=False)))
        largest = -(-largest // BLOCK)
    return steps


def tops(steps: list[DataFrame]) -> DataFrame:
    """(tree, digest) of each tree's top."""
    parts = [s.filter("size = 1").select("tree", "digest") for s in steps]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _received(item: tuple) -> Iterator[tuple]:
    """A block that got its top's path: each node with its siblings within, and what the top was told."""
    (tree, block), (nodes, told) = item
    nodes = sorted(nodes)
    if not nodes:
        return
    word, path = next(iter(told))
    levels = _subtree([n[2] for n in nodes], nodes[0][0])
    for n in nodes:
        yield tree, block * BLOCK + n[1], n, _way_up(levels, n[1]), word, path


def descended(steps: list[DataFrame], told: RDD, *payload: str) -> RDD:
    """The given nodes of ``climbed`` with their paths: (tree, place, node, path within its block, word, path above).

    ``told``: (tree, size, word, path) for each top, with a word that all its nodes are to know and the path above it.
    """
    n, last = partitions(steps[0].sparkSession), max(0, len(steps) - 2)

    def of_tops(k: int) -> RDD:
        """Messages to the blocks whose top is a tree's, on their step."""
        return told.filter(lambda t: _bands(t[1]) == k + 1).map(lambda t: ((t[0], 0), (t[2], t[3])))

    messages = of_tops(last)
    for k in range(last, 0, -1):
        nodes = _grouped(_sent(steps[k].filter("size > 1")), messages, n).flatMap(_received)
        messages = nodes.map(lambda r: ((r[0], r[1]), (r[4], r[3] + r[5]))).union(of_tops(k - 1))
    return _grouped(_sent(steps[0], *payload), messages, n).flatMap(_received)


def _grouped(nodes: RDD, messages: RDD, n: int) -> RDD:
    """(nodes, messages) of each block."""
    both = nodes.mapValues(lambda v: (0, v)).union(messages.mapValues(lambda v: (1, v))).groupByKey(n, _to_block)
    return both.mapValues(lambda vs: ([v for side, v in vs if side == 0], [v for side, v in vs if side == 1]))


def folded(digest: str, path: Path) -> str:
    """The root that a node's digest and its siblings lead to."""
    for left, right in path:
        digest = _hashed((left, digest, right))
    return digest


def _checked(root: str):
    def row(item: tuple) -> tuple:
        _, _, (_, _, leaf, doc_id, probe), within, subroot, above = item
        path = within + above
        reached = folded(probe, path)
        return doc_id, leaf, subroot, root, _hashed(x for step in path for x in step), reached, reached == root

    return row


def manifest(docs: DataFrame, probe: Column | None = None) -> DataFrame:
    """Each row's leaf, its source's root, the root of all, a digest of its proof, and the check of ``probe``.

    ``probe``: the digest of the row as it is found later, of the columns of ``docs``; the row's own digest where null or not given.
    """
    spark = docs.sparkSession
    leaf = leaf_digest(*map(F.col, FIELDS))
    probe = leaf if probe is None else F.coalesce(probe, leaf)
    leaves = saved(docs.select("doc_id", F.col("source").cast("string").alias("tree"), leaf.alias("digest"), probe.alias("probe")))
    nodes = saved(numbered(leaves, ["doc_id", "digest"]))
    steps = climbed(nodes)
    sizes = nodes.filter("place = 0").select(F.col("tree").alias("source"), F.col("size").alias("leaves"))
    above = saved(tops(steps).join(sizes, F.col("tree").eqNullSafe(F.col("source"))).select(F.lit(None).cast("string").alias("tree"), "source", "leaves", "digest"))
    upper = climbed(saved(numbered(above, ["source"])))
    top = tops(upper).first()
    root = top["digest"] if top else ""
    known = spark.sparkContext.parallelize([(None, above.count(), None, [])], 1)
    subroots = descended(upper, known, "source", "leaves").map(lambda r: (r[2][3], r[2][4], r[2][2], r[3] + r[5]))
    rows = descended(steps, subroots, "doc_id", "probe").map(_checked(root))
    schema = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return spark.createDataFrame(rows, schema, verifySchema=False)


def without_breaks() -> Column:
    """The digest of rows found without the line breaks of their text, where 2 divides crc32 of doc_id."""
    values = [F.replace("text", F.lit("\n"), F.lit("")) if c == "text" else F.col(c) for c in FIELDS]
    return F.when(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, leaf_digest(*values))


def op13_merkle_manifest(spark, sf_dir):
    return manifest(table(spark, sf_dir, "documents"), without_breaks())


#: crc32 bit by bit; places and trees by recursion; proofs from the siblings on each level.
OP13_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, source, lang, n_chars, text, dense_rank() OVER (ORDER BY source NULLS FIRST) AS tree,
    list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::UBIGINT)),
      lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]),
        lambda x, k: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END))) AS crc
  FROM documents),
fields AS (
  SELECT doc_id, tree, (crc % 2) = 1 AS tampered,
    coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
      || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
    text, replace(text, chr(10), '') AS bare
  FROM docs),
leaves AS (
  SELECT doc_id, tree, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
    sha256(head || coalesce(strlen(CASE WHEN tampered THEN bare ELSE text END) || ':' || CASE WHEN tampered THEN bare ELSE text END, '-')) AS probe
  FROM fields),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
low AS (
  SELECT 0 AS level, tree, i, n, leaf AS h FROM placed
  UNION ALL
  SELECT level + 1, tree, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY level, tree, i // 3, n),
subroots AS (SELECT tree, h, level AS height FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, tree - 1 AS i, (SELECT count(*) FROM subroots) AS n, h FROM subroots
  UNION ALL
  SELECT level + 1, i // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 3, n),
steps AS (
  SELECT a.tree, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS lft, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS rgt
  FROM low a JOIN low b ON a.tree = b.tree AND a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.tree, a.level, a.i
  UNION ALL
  SELECT 0 AS tree, a.level, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), ''), coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '')
  FROM high a JOIN high b ON a.level = b.level AND a.i // 3 = b.i // 3 WHERE a.n > 1 GROUP BY a.level, a.i),
fold AS (
  SELECT tree AS home, i AS place, tree, 0 AS level, i, probe AS h, '' AS proof FROM placed
  UNION ALL
  SELECT f.home, f.place, CASE WHEN s.tree IS NULL THEN 0 ELSE f.tree END, CASE WHEN s.tree IS NULL THEN 0 ELSE f.level + 1 END, CASE WHEN s.tree IS NULL THEN f.tree - 1 ELSE f.i // 3 END,
    CASE WHEN s.tree IS NULL THEN f.h ELSE sha256(s.lft || f.h || s.rgt) END, f.proof || coalesce(s.lft || s.rgt, '')
  FROM fold f LEFT JOIN steps s ON s.tree = f.tree AND s.level = f.level AND s.i = f.i WHERE f.tree > 0 OR s.tree IS NOT NULL),
ended AS (SELECT home, place, arg_max(h, level) AS h, arg_max(proof, level) AS proof FROM fold WHERE tree = 0 GROUP BY home, place)
SELECT p.doc_id, p.leaf, r.h AS subroot, top.h AS root, sha256(e.proof) AS proof_sha256, e.h AS folded_root, e.h = top.h AS verified
FROM placed p JOIN subroots r ON r.tree = p.tree JOIN ended e ON e.home = p.tree AND e.place = p.i, (SELECT h FROM high WHERE n = 1) top
"""
