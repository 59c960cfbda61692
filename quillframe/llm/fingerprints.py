"""Document fingerprints by locally consistent parsing.

Each level names the runs of its symbols, labels them by deterministic coin tossing
(the lowest bit in which a name differs from its left neighbour, repeated until there
are at most six labels) and cuts phrases at local minima of the labels. A phrase's name
is a hash of its symbols, so equal substrings get equal phrases in their interior at
every level, wherever they stand. A fingerprint is the bottom-k sketch of the names of
levels 2 to 4; texts too short for those add the names of their symbols and level 1.

Defined cases: null is the empty text, which has a fingerprint of its own; equal texts
have equal fingerprints; doc_id null sorts last; of rows that repeat a doc_id, larger
texts in code-point order come first; a table of one document is its own successor; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.codepoints import BASE, chunks, mix, points, powers
from quillframe.llm.common import partitions, table

SKETCH, LEVELS, SHORT = 64, 4, 4
#: Bytes of text in a range.
RANGE = 32_000_000
#: Longer runs of one symbol are named as runs of this length, so that a piece of a run resembles the run.
LONG_RUN = 8


@lru_cache(maxsize=1)
def _toss() -> np.ndarray:
    """Next label by (label, left neighbour's label), both below 128."""
    a, b = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    x = np.where(a == b, 1, a ^ b)
    low = np.round(np.log2(x & -x)).astype(np.int64)
    return (2 * low + ((a >> low) & 1)).astype(np.uint8).ravel()


def level_up(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases over these symbols, and the text each belongs to."""
    if not len(names):
        return names, owner
    new = np.empty(len(names), bool)
    new[0] = True
    new[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    starts = np.flatnonzero(new)
    if len(starts) < len(names):
        run = np.diff(starts, append=len(names))
        names, owner = names[starts], owner[starts]
        names = np.where(run > 1, mix(names + np.minimum(run, LONG_RUN).astype(np.uint64) * BASE), names)
    head = np.empty(len(names), bool)
    head[0] = True
    head[1:] = owner[1:] != owner[:-1]
    first = np.flatnonzero(head)

    left = np.empty_like(names)
    left[1:] = names[:-1]
    left[first] = ~names[first]
    x = names ^ left
    x &= np.negative(x)
    low = (x.astype(np.float64).view(np.int64) >> 52) - 1023
    np.clip(low, 0, 63, out=low)
    low = low.view(np.uint64)
    label = (low * np.uint64(2) + ((names >> low) & np.uint64(1))).astype(np.uint16)
    for _ in range(3):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[first] = label[first] ^ 1
        label = _toss()[(label << 7) | before].astype(np.uint16)
    cut = head.copy()
    # a text's last symbol starts no phrase: what follows it is another text
    cut[1:-1] |= (label[1:-1] < label[:-2]) & (label[1:-1] <= label[2:]) & ~head[2:]
    cut[1:] &= ~head[:-1] | head[1:]  # a phrase has two symbols at least, but for the last of a text
    at = np.flatnonzero(cut)
    size = np.diff(at, append=len(names))
    place = np.arange(len(names)) - np.repeat(at, size)
    named = np.add.reduceat(mix(names) * powers()[place & 0xFFFF], at)
    return mix(named + size.astype(np.uint64)), owner[at]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The fingerprint of each text: at most SKETCH sorted 32-bit values."""
    out: list[np.ndarray] = []
    for part in chunks([len(t) for t in texts]):
        group = texts[part]
        flat, at = points(group)
        owner = np.repeat(np.arange(len(group), dtype=np.int32), np.diff(at))
        level = [(mix(flat.astype(np.uint64) + BASE), owner)]
        for _ in range(LEVELS):
            level.append(level_up(*level[-1]))
        phrases = sum(np.bincount(o, minlength=len(group)) for _, o in level[2:])
        low = phrases < SHORT
        picked = level[2:] + [(n[low[o]], o[low[o]]) for n, o in level[:2]]
        blank = np.flatnonzero(np.diff(at) == 0).astype(np.int32)
        picked.append((np.zeros(len(blank), np.uint64), blank))
        key = np.unique(np.concatenate([(o.astype(np.uint64) << np.uint64(32)) | (n >> np.uint64(32)) for n, o in picked]))
        values, owner = (key & np.uint64(0xFFFFFFFF)).astype(np.uint32), (key >> np.uint64(32)).astype(np.int64)
        ends = np.searchsorted(owner, np.arange(len(group) + 1))
        out += [values[lo : min(hi, lo + SKETCH)] for lo, hi in zip(ends[:-1], ends[1:], strict=True)]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard estimate of two bottom-k sketches; exact while both hold all their values."""
    x, y = set(a.tolist()), set(b.tolist())
    union = sorted(x | y)[:SKETCH]
    return len(x & y & set(union)) / len(union) if union else 1.0


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _rows(ids: list, texts: list[str], following: list[str]) -> pd.DataFrame:
    changed = [edited(t, f) for t, f in zip(texts, following, strict=True)]
    # a text's successor is the next row's text, so its sketch is made once
    own = sketches([*texts, following[-1]])
    after = own[1:]
    other = sketches(changed)
    return pd.DataFrame(
        {
            "doc_id": pd.array(ids, dtype="Int64"),
            "n_chars": [len(t) for t in texts],
            "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed],
            "fingerprint": [v.astype(">u4").tobytes().hex() for v in own[:-1]],
            "edited_fingerprint": [v.astype(">u4").tobytes().hex() for v in other],
            "near_edited": [likeness(a, b) for a, b in zip(own, other, strict=False)],
            "near_next": [likeness(a, b) for a, b in zip(own, after, strict=False)],
        }
    )


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by bucket, doc_id descending, then the first row of the bucket below (ghost); text by text in bounded groups."""
    ids, texts, group = [], [], None

    def flush(following: str) -> Iterator[pd.DataFrame]:
        if ids:
            yield _rows(ids, texts, [*texts[1:], following])
            ids.clear()
            texts.clear()

    size = 0
    for batch in batches:
        for bucket, ghost, doc_id, text in zip(batch["bucket"], batch["ghost"], batch["doc_id"], batch["text"], strict=True):
            text = text if isinstance(text, str) else ""
            if ghost:
                yield from flush(text)
                size = 0
                continue
            if bucket != group or size > 2_000_000:
                yield from flush(text)
                group, size = bucket, 0
            ids.append(None if pd.isna(doc_id) else int(doc_id))
            texts.append(text)
            size += len(text)
    yield from flush(texts[-1] if texts else "")  # only without a ghost, which every bucket has


def fingerprints(docs: DataFrame) -> DataFrame:
    """One shuffle of the texts: documents are dealt into ranges of doc_id, and the first of each range is also sent to the range above.

    Every range is a partition of its own, of ``RANGE`` bytes or so at most.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(partitions(spark), -(-int(size) // RANGE))
    bounds = sorted(set(docs.select(F.col("doc_id").cast("double").alias("d")).approxQuantile("d", [k / n for k in range(1, n)], 0.25 / n))) if n > 1 else []
    cuts = np.array(bounds)

    @F.pandas_udf("int")
    def bucket_of(doc_id: pd.Series) -> pd.Series:
        return pd.Series(np.where(doc_id.isna(), -1, np.searchsorted(cuts, doc_id.fillna(0).to_numpy(np.float64)))).astype("int32")

    tops = {r["bucket"]: r["top"] for r in docs.select(bucket_of("doc_id").alias("bucket"), "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    order = sorted(tops)
    routes = [(order[(k + 1) % len(order)], tops[b]) for k, b in enumerate(order)]
    edges = spark.createDataFrame(routes, "bucket int, top long")  # a row per bucket, of which there are as many as partitions
    placed = docs.withColumns({"bucket": bucket_of("doc_id"), "ghost": F.lit(False)})
    ghosts = docs.join(F.broadcast(edges), F.col("doc_id").eqNullSafe(F.col("top"))).select("doc_id", "text", "bucket", F.lit(True).alias("ghost"))
    # the null bucket is -1
    rows = placed.unionByName(ghosts).repartitionById(n + 1, F.col("bucket") + 1)
    rows = rows.sortWithinPartitions("bucket", "ghost", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))
    return rows.select("bucket", "ghost", "doc_id", "text").mapInPandas(
        _walk, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )


def op7_fingerprints(spark, sf_dir):
    return fingerprints(table(spark, sf_dir, "documents"))
