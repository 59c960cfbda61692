"""Exact top-k inner products by a pivot-distance index.

Vectors become integers, floor(256 x). One more coordinate, sqrt(M - |x|^2) with M the
largest squared norm, makes all norms equal, so the largest inner product is the
smallest distance and a metric index applies. Every vector is keyed by its nearest pivot
and its distance to it; the distances are cut into annuli. A query first searches its
own pivot's annuli outwards from its own distance; the k-th best it finds there bounds
its radius. It then visits only the annuli of other pivots that the triangle inequality
cannot exclude, in order of their distance, and stops within each by the same bound.

Pivots come from a bounded sample (``SAMPLE`` rows by hash order) by k-means; the index
holds every row. An annulus of more than ``CELL`` rows is dealt into parts by hash, so a
third of all rows with one vector does not meet in one task. Queries come in blocks of one
home pivot, and a part of an annulus goes only to the blocks that visit it.
Scores are integer inner products, exact in float64 below 2**53.

Defined cases: vectors that are null or hold null or non-finite components take no
part, neither as query nor as candidate, nor do rows without vec_id; of rows that repeat
a vec_id the one of the largest vector (in array order) counts; shorter vectors are padded with zeros; the
query's own row (by vec_id) is no candidate; ties go to the smaller vec_id; fewer
candidates than k give fewer rows; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.llm.common import saved, table

K, PIVOTS, SAMPLE, ANNULI, CELL = 5, 32, 4096, 16, 4096
SCALE = 256
#: Room for rounding in the bounds, far below the least difference of two integer scores.
SLACK = 1e-6


def scaled(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, x): usable vectors as integer components."""
    usable = F.col(vector).isNotNull() & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    )
    whole = F.transform(vector, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("double"))
    rows = vectors.filter(usable & F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), whole.alias("x"))
    return rows.groupBy("vec_id").agg(F.max("x").alias("x"))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for k, row in enumerate(column):
        out[k, : len(row)] = row
    return out


def pivots_of(sample: np.ndarray, count: int = PIVOTS, rounds: int = 6) -> np.ndarray:
    """k-means centres of the sample, from a fixed start."""
    distinct = np.unique(sample, axis=0)
    rng = np.random.default_rng(5)
    centres = distinct[rng.permutation(len(distinct))[:count]].astype(np.float64)
    for _ in range(rounds):
        near = ((sample[:, None, :] - centres[None]) ** 2).sum(axis=2).argmin(axis=1) if sample.size * len(centres) < 2e7 else _nearest(sample, centres)[0]
        for k in range(len(centres)):
            if (near == k).any():
                centres[k] = sample[near == k].mean(axis=0)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = distances(x, centres)
    near = d.argmin(axis=1)
    return near, d[np.arange(len(x)), near]


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x * x).sum(axis=1)[:, None] + (centres * centres).sum(axis=1)[None] - 2 * x @ centres.T
    return np.sqrt(np.maximum(d, 0))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def search_cell(queries: np.ndarray, own: np.ndarray, bound: np.ndarray, to_pivot: np.ndarray, x: np.ndarray, ids: np.ndarray, dist: np.ndarray, top: float, k: int):
    """Best k of one cell for each query. bound: scores below it cannot count. x is sorted by dist.

    A candidate with score s lies at squared distance q2 + top - 2 s from the lifted query, so
    |dist - to_pivot| of at most sqrt(q2 + top - 2 bound) is needed to reach the bound.
    Blocks of candidates are taken outwards from the query's own distance until both
    sides are beyond the radius, which shrinks as better scores turn up.
    """
    q2 = (queries * queries).sum(axis=1)
    block = 1024
    for j in range(len(queries)):
        scores, found, least = np.zeros(0), np.zeros(0, np.int64), bound[j]
        mid = int(np.searchsorted(dist, to_pivot[j]))
        lo, hi = mid, mid
        while lo > 0 or hi < len(dist):
            radius = np.sqrt(max(0.0, q2[j] + top - 2 * least)) + SLACK * (1 + to_pivot[j]) if np.isfinite(least) else np.inf
            left = to_pivot[j] - dist[lo - 1] if lo > 0 else np.inf
            right = dist[hi] - to_pivot[j] if hi < len(dist) else np.inf
            if min(left, right) > radius:
                break
            if left <= right:
                part = slice(max(0, lo - block), lo)
                lo = part.start
            else:
                part = slice(hi, min(len(dist), hi + block))
                hi = part.stop
            s = x[part] @ queries[j]
            ok = (s >= least) & (ids[part] != own[j])
            if ok.any():
                scores, found = _best(np.concatenate([scores, s[ok]]), np.concatenate([found, ids[part][ok]]), k)
                if len(scores) == k:
                    least = max(least, scores[-1])
        yield scores, found


_HITS = "query_id long, vec_id long, score double"


def _searcher(top: float, width: int, k: int):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64"})
        right = right.sort_values("dist", kind="stable")
        x, ids, dist = _matrix(right["x"], width), right["vec_id"].to_numpy(np.int64), right["dist"].to_numpy(np.float64)
        own = left["query_id"].to_numpy(np.int64)
        hits = search_cell(_matrix(left["q"], width), own, left["bound"].to_numpy(np.float64), left["to_pivot"].to_numpy(np.float64), x, ids, dist, top, k)
        rows = [(np.full(len(s), o), f, s) for o, (s, f) in zip(own, hits, strict=True)]
        return pd.DataFrame({"query_id": np.concatenate([r[0] for r in rows]), "vec_id": np.concatenate([r[1] for r in rows]), "score": np.concatenate([r[2] for r in rows])})

    return search


def top_k(vectors: DataFrame, is_query, k: int = K, pivots: int = PIVOTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best other rows for each row where is_query holds."""
    spark = vectors.sparkSession
    rows = saved(scaled(vectors, vec_id, vector))
    norm = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    facts = rows.agg(F.max(norm).alias("top"), F.max(F.size("x")).alias("width")).first()
    empty = "query_id long, rank int, vec_id long, score long"
    if facts["top"] is None:
        return spark.createDataFrame([], empty)
    top, width = float(facts["top"]), int(facts["width"])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("x").collect()
    points = lifted(_matrix(pd.Series([r["x"] for r in sample]), width), top)
    centres = pivots_of(points, pivots)
    reach = float(_nearest(points, centres)[1].max()) or 1.0

    def key(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            near, dist = _nearest(lifted(_matrix(batch["x"], width), top), centres)
            yield batch.assign(pivot=near.astype(np.int32), annulus=np.minimum(dist / reach * ANNULI, 4 * ANNULI).astype(np.int32), dist=dist)

    index = saved(rows.mapInPandas(key, "vec_id long, x array<double>, pivot int, annulus int, dist double"))
    # a row per cell: at most PIVOTS x (4 ANNULI + 1), whatever the size of the table
    cells = index.groupBy("pivot", "annulus").agg(F.count("*").alias("n"), F.min("dist").alias("near"), F.max("dist").alias("far")).collect()
    parts = {(c["pivot"], c["annulus"]): -(-c["n"] // CELL) for c in cells}
    by_pivot: dict[int, list] = {}
    for c in cells:
        by_pivot.setdefault(c["pivot"], []).append((c["annulus"], c["near"], c["far"]))
    part_of = spark.createDataFrame([(p, a, n) for (p, a), n in parts.items()], "pivot int, annulus int, parts int")
    split = index.join(F.broadcast(part_of), ["pivot", "annulus"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), "parts").cast("int")).drop("parts")

    queries = index.filter(is_query).select(F.col("vec_id").alias("query_id"), F.col("x").alias("q"), F.col("pivot").alias("home"))
    cell = ["pivot", "annulus", "part", "block"]

    def visits(rest: bool):
        """Cells each query must visit: its own pivot's, or, given its bound, those of the others. A block is up to 512 queries."""

        def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                q = _matrix(batch["q"], width)
                # the lifted query has 0 in the added coordinate
                d = distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), centres)
                q2 = (q * q).sum(axis=1)
                at, to = [], []
                bounds = batch["bound"].to_numpy(np.float64)
                for j, home in enumerate(batch["home"]):
                    radius = np.sqrt(max(0.0, q2[j] + top - 2 * bounds[j])) + SLACK * (1 + q2[j]) if np.isfinite(bounds[j]) else np.inf
                    for p, rings in by_pivot.items():
                        if (p == home) == rest:
                            continue
                        for a, near, far in rings:
                            if near - d[j, p] <= radius and d[j, p] - far <= radius:
                                at += [j] * parts[p, a]
                                to += [(p, a, s, d[j, p]) for s in range(parts[p, a])]
                out = batch[["query_id", "q", "bound", "block"]].iloc[at].reset_index(drop=True)
                out["pivot"], out["annulus"], out["part"] = (np.array([t[i] for t in to], np.int32) for i in range(3))
                out["to_pivot"] = np.array([t[3] for t in to], np.float64)
                yield out

        return plan

    shape = "query_id long, q array<double>, bound double, block int, pivot int, annulus int, part int, to_pivot double"
    # a row per pivot; a block is up to some 512 queries of one home
    sizes = queries.groupBy("home").agg(F.ceil(F.count("*") / 512).cast("int").alias("blocks"))
    before = W.orderBy("home").rowsBetween(W.unboundedPreceding, -1)
    first = saved(sizes.withColumn("first", F.coalesce(F.sum("blocks").over(before), F.lit(0)).cast("int")))
    queries = queries.join(F.broadcast(first), "home").withColumn("block", F.col("first") + F.pmod(F.xxhash64("query_id"), "blocks").cast("int")).drop("first", "blocks")

    def run(wanted: DataFrame, rest: bool) -> DataFrame:
        asked = saved(wanted.mapInPandas(visits(rest), shape))
        visits_of = asked.select("pivot", "annulus", "part", F.col("block").alias("visitor")).distinct()
        held = split.join(visits_of, ["pivot", "annulus", "part"])
        return asked.groupBy(*cell).cogroup(held.groupBy("pivot", "annulus", "part", "visitor")).applyInPandas(_searcher(top, width, k), _HITS)

    def merged(hits: DataFrame) -> DataFrame:
        """The k best hits of each query, by a fold that never holds more than its own hits: k a cell."""
        best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("minus"), "vec_id"))), 1, k)
        return hits.groupBy("query_id").agg(best.alias("best"))

    home = saved(run(queries.withColumn("bound", F.lit(float("-inf"))), rest=False))
    bound = F.when(F.size("best") == k, -F.element_at("best", k)["minus"]).otherwise(F.lit(float("-inf")))
    bounds = merged(home).select("query_id", bound.alias("found"))
    again = queries.join(bounds, "query_id", "left").withColumn("bound", F.coalesce("found", F.lit(float("-inf")))).drop("found")
    best = merged(home.unionByName(run(again, rest=True)))
    found = best.select("query_id", F.posexplode("best").alias("place", "hit"))
    return found.select("query_id", (F.col("place") + 1).alias("rank"), F.col("hit.vec_id").alias("vec_id"), (-F.col("hit.minus")).cast("long").alias("score"))


def op5_exact_top_k(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP5_SQL = """
WITH parts AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS c FROM embeddings),
usable AS (SELECT vec_id FROM parts GROUP BY vec_id HAVING count(*) = count(c) AND bool_and(isfinite(c))),
whole AS (SELECT vec_id, i, floor(256 * c)::BIGINT AS c FROM parts SEMI JOIN usable USING (vec_id)),
scores AS (
  SELECT q.vec_id AS query_id, x.vec_id, sum(q.c * x.c)::BIGINT AS score
  FROM whole q JOIN whole x ON q.i = x.i AND q.vec_id <> x.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, x.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scores) WHERE rank <= 5
"""
