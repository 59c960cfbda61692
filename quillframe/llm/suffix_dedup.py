"""Exact-substring removal by a hash-compared suffix sort.

A byte goes if it lies in a string of ``MATCH`` bytes that also starts earlier (in a
document of smaller doc_id, or earlier in its own). All windows of MATCH bytes are
covered, as follows.

1. Anchors. Each window has one anchor, the leftmost least hash of its ``SEED``-byte
   strings, so equal windows have equal anchors at equal offsets, and consecutive
   windows share one: about one anchor for 35 bytes. Anchor hashes are counted over the
   corpus; those seen twice fill a bit set of fixed size, which is broadcast. A bit set
   by chance costs work, never a match.
2. Runs. Each run of windows around such an anchor is sent, with its bytes, to the group
   of its anchor's hash. A task sends equal runs once, so the runs of a passage that a
   third of all documents share come to a group from each task, not from each document.
3. Suffix sort. In a group, the windows' suffixes are sorted by mergesort. Two suffixes
   are compared by their longest common extension, found by binary search over prefix
   polynomial hashes (seven probes), and the byte after it. Neighbours that agree on
   MATCH bytes are verified byte by byte. All but the earliest of equal suffixes go.
4. The starts that go come back to their documents as ranges, which are merged and cut.

Defined cases: null is the empty text; texts below MATCH bytes lose nothing; rows
without doc_id lose nothing and are compared with nothing; repeated rows of one doc_id and
text count as one document and repeat its result; other texts of one doc_id are documents
of their own, in order of their hashes; an empty table gives an empty result; extra columns
stay out of the result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillframe.llm.codepoints import BASE, INVERSE, mix
from quillframe.llm.common import partitions, saved, table
from quillframe.llm.merkle import numbered

MATCH, SEED = 100, 32
SPAN = MATCH - SEED + 1
#: Bytes that are looked at together: a task makes some ten arrays of eight bytes for each.
PIECE = 2_000_000
#: Bits of the set of repeated anchors: 16 MB, whatever the size of the corpus.
BITS = 27
_ORDER = np.uint64(24)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def prefix_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P and I such that (P[i + n] - P[i]) * I[i] is the polynomial hash of data[i : i + n]."""
    p = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(BASE, len(data)), out=p[1:])
    return p, _powers(INVERSE, len(data) + 1)


def _sliding_least(x: np.ndarray, span: int) -> np.ndarray:
    """Least of each span of values, by block prefixes and suffixes."""
    n = len(x)
    padded = np.full(-(-n // span) * span, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, span)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - span + 1], ahead[span - 1 : n])


def anchored_runs(data: np.ndarray, ends: np.ndarray):
    """Runs of window starts that share an anchor: (first start, number, anchor's place, anchor's hash). ends: where each piece ends."""
    empty = np.zeros(0, np.int64)
    if len(data) < MATCH:
        return empty, empty, empty, empty.view(np.uint64)
    p, inverse = prefix_hashes(data)
    seeds = mix((p[SEED:] - p[:-SEED]) * inverse[: len(data) - SEED + 1])
    ranked = (seeds >> _ORDER << _ORDER) | np.arange(len(seeds), dtype=np.uint64)
    least = _sliding_least(ranked, SPAN)
    anchor = (least & np.uint64((1 << int(_ORDER)) - 1)).astype(np.int64)
    start = np.arange(len(anchor))
    owner = np.searchsorted(ends, start, side="right")
    ok = start + MATCH <= ends[np.minimum(owner, len(ends) - 1)]
    new = np.ones(len(anchor), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | ~ok[:-1] | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new & ok)
    # a run ends at the next run's start or at the last good start before it
    stop = np.flatnonzero(new | ~ok)
    following = np.append(stop, len(anchor))[np.searchsorted(stop, first, side="right")]
    return first, following - first, anchor[first], seeds[anchor[first]]


def _pieces(batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The batch's texts as flat bytes in bounded pieces: (bytes, ends, doc_id and offset of each). Longer texts overlap by MATCH - 1."""
    raws, ids, offsets, size = [], [], [], 0

    def flush():
        yield np.frombuffer(b"".join(raws), np.uint8), np.cumsum([len(r) for r in raws]), np.array(ids, np.int64), np.array(offsets, np.int64)

    for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
        if not isinstance(text, str):
            continue
        raw = text.encode("utf-8", "surrogatepass")
        for lo in range(0, max(0, len(raw) - MATCH + 1), PIECE - MATCH + 1):
            part = raw[lo : lo + PIECE]
            if raws and size + len(part) > PIECE:
                yield from flush()
                raws, ids, offsets, size = [], [], [], 0
            raws.append(part)
            ids.append(doc_id)
            offsets.append(lo)
            size += len(part)
    if raws:
        yield from flush()


def _count_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for data, ends, _, _ in _pieces(batch):
            found, n = np.unique(anchored_runs(data, ends)[3], return_counts=True)
            yield pd.DataFrame({"h": found.view(np.int64), "n": n})


def _slots(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64((1 << BITS) - 1)
    return h & mask, (h >> np.uint64(64 - BITS)) & mask


def _probably_in(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for s in _slots(h):
        out &= (bits[(s >> np.uint64(3)).astype(np.int64)] >> (s & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return out


def repeated_anchors(docs: DataFrame) -> tuple[np.ndarray, int]:
    """The bit set of anchor hashes seen twice, and how many anchors those are."""
    counted = docs.mapInPandas(_count_anchors, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    low, high = F.col("h").bitwiseAND(F.lit((1 << BITS) - 1)), F.shiftrightunsigned("h", 64 - BITS)
    counted = saved(counted.select("n", low.alias("low"), high.alias("high")))
    slots = counted.select(F.col("low").alias("slot")).union(counted.select("high"))
    chunk = F.shiftright("slot", 15)
    chunks = slots.groupBy(chunk.alias("chunk")).agg(F.bitmap_construct_agg(F.col("slot").bitwiseAND(F.lit(32767))).alias("bits")).collect()
    bits = np.zeros(1 << (BITS - 3), np.uint8)
    for row in chunks:  # at most 2**(BITS - 15) rows of 4 KB
        bits[row["chunk"] * 4096 : (row["chunk"] + 1) * 4096] = np.frombuffer(bytes(row["bits"]), np.uint8)
    return bits, counted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def merged_runs(doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs (doc, start, n) that touch or overlap, joined."""
    order = np.lexsort((start, doc))
    doc, start, n = doc[order], start[order], n[order]
    if not len(doc):
        return doc, start, n
    stop = start + n
    base = np.concatenate([[0], np.cumsum(doc[1:] != doc[:-1])])
    reach = int(stop.max()) + 1
    far = np.maximum.accumulate(stop + base * reach) - base * reach
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (start[1:] > far[:-1])
    at = np.flatnonzero(new)
    return doc[at], start[at], np.maximum.reduceat(stop, at) - start[at]


_RUNS = "h long, doc_id long, start long, anchor int, n int, raw binary"


def _goes(doc, start, n, buckets: int) -> pd.DataFrame:
    """Runs whose starts all go, in the shape of runs to be compared: they have no bytes."""
    doc, start, n = merged_runs(np.array(doc, np.int64), np.array(start, np.int64), np.array(n, np.int64))
    return pd.DataFrame({"h": mix(doc.astype(np.uint64)).view(np.int64), "doc_id": doc, "start": start, "anchor": np.int32(0), "n": n.astype(np.int32), "raw": None})


def _send_runs(bits):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, tuple[int, int]] = {}
        for batch in batches:
            for data, ends, ids, offsets in _pieces(batch):
                first, n, anchor, h = anchored_runs(data, ends)
                keep = np.flatnonzero(_probably_in(bits.value, h))
                owner = np.searchsorted(ends, first[keep], side="right")
                begin = np.concatenate([[0], ends[:-1]])[owner]
                doc, start = ids[owner], first[keep] - begin + offsets[owner]
                order = np.lexsort((start, doc))
                sent, gone, whole = [], ([], [], []), data.tobytes()
                for k in order:
                    at, size, d, s = int(first[keep[k]]), int(n[keep[k]]), int(doc[k]), int(start[k])
                    raw = whole[at : at + size + MATCH - 1]
                    key = (int(anchor[keep[k]]) - at, raw)
                    before = seen.get(key)
                    if before is not None and before <= (d, s):
                        if before < (d, s):
                            for column, value in zip(gone, (d, s, size), strict=True):
                                column.append(value)
                        continue
                    if len(seen) >= 100_000:
                        seen.clear()
                    seen[key] = (d, s)
                    sent.append((int(h[keep[k]].view(np.int64)), d, s, key[0], size, raw))
                yield pd.DataFrame(sent, columns=["h", "doc_id", "start", "anchor", "n", "raw"]).astype({"anchor": "int32", "n": "int32"})
                yield _goes(*gone, 0)

    return run


class Suffixes:
    """Suffixes of a byte buffer, compared through prefix hashes up to MATCH bytes."""

    def __init__(self, data: np.ndarray):
        self.data = np.append(data, np.zeros(MATCH, np.uint8))
        self.p, self.inverse = prefix_hashes(self.data)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common extension of suffixes a and b, MATCH at most, by binary search."""
        low, high = np.zeros(len(a), np.int64), np.full(len(a), MATCH, np.int64)
        pa, pb, ia, ib = self.p[a], self.p[b], self.inverse[a], self.inverse[b]
        for _ in range(MATCH.bit_length()):
            mid = (low + high + 1) >> 1
            same = (self.p[a + mid] - pa) * ia == (self.p[b + mid] - pb) * ib
            low, high = np.where(same, mid, low), np.where(same, high, np.maximum(low, mid - 1))
        return low

    def compare(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """-1, 0 or 1 as suffix a is below, equal to (over MATCH bytes) or above b."""
        n = self.common(a, b)
        sign = np.sign(self.data[a + np.minimum(n, MATCH - 1)].astype(np.int16) - self.data[b + np.minimum(n, MATCH - 1)])
        return np.where(n >= MATCH, 0, sign)

    def sort(self, at: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Stable order of the suffixes within each group (equal values side by side): bottom-up mergesort, all merges of a round at once."""
        n = len(at)
        order = np.arange(n)
        new = np.ones(n, bool)
        new[1:] = group[1:] != group[:-1]
        begin = np.flatnonzero(new)
        sizes = np.diff(begin, append=n)
        base, end = np.repeat(begin, sizes), np.repeat(begin + sizes, sizes)
        width, largest = 1, int(sizes.max(initial=0))
        while width < largest:
            place = np.arange(n) - base
            run = place // width
            left = run % 2 == 0
            low = np.minimum(base + (run ^ 1) * width, end)
            high = np.minimum(low + width, end)
            other = low.copy()
            live = np.flatnonzero(low < high)
            while len(live):
                mid = (low[live] + high[live]) >> 1
                c = self.compare(at[order[mid]], at[order[live]])
                up = (c < 0) | ((c == 0) & ~left[live])
                low[live] = np.where(up, mid + 1, low[live])
                high[live] = np.where(up, high[live], mid)
                live = live[low[live] < high[live]]
            where = base + (run // 2) * 2 * width + place % width + (low - other)
            moved = np.empty_like(order)
            moved[where] = order
            order = moved
            width *= 2
        return order


def repeats(doc: np.ndarray, start: np.ndarray, group: np.ndarray, at: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Which windows (of one group each) hold MATCH bytes that an earlier window of the group holds too."""
    first = np.lexsort((start, doc, group))
    doc, start, group, at = doc[first], start[first], group[first], at[first]
    s = Suffixes(data)
    order = s.sort(at, group)
    a, b = order[:-1], order[1:]
    equal = group[a] == group[b]
    equal[equal] = s.common(at[a[equal]], at[b[equal]]) >= MATCH
    where = np.flatnonzero(equal)
    for lo in range(0, len(where), 50_000):  # collision verification
        k = where[lo : lo + 50_000]
        reach = np.arange(MATCH)
        equal[k] = (s.data[at[a[k]][:, None] + reach] == s.data[at[b[k]][:, None] + reach]).all(axis=1)
    head = np.concatenate([[True], ~equal]) if len(order) else np.zeros(0, bool)
    earliest = np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))
    lead = order[earliest]  # stable sort: the first of equal suffixes is the earliest
    later = ~head & ((doc[lead] != doc[order]) | (start[lead] != start[order]))
    out = np.zeros(len(at), bool)
    out[first[order[later]]] = True
    return out


def _compare_group(group: pd.DataFrame) -> pd.DataFrame:
    """Runs of some anchors' groups to the runs of starts that go."""
    bare = group["raw"].isna()
    done = group[bare]
    doc, start, n = [done["doc_id"].to_numpy(np.int64)], [done["start"].to_numpy(np.int64)], [done["n"].to_numpy(np.int64)]
    runs = group[~bare].sort_values(["h", "doc_id", "start"], kind="stable")
    whole = runs.duplicated(["anchor", "raw"])  # equal runs of other tasks: they sort together, the earliest stays
    if whole.any():
        lead = runs.groupby(["anchor", "raw"], sort=False)[["doc_id", "start"]].transform("first")
        late = runs[whole & ((lead["doc_id"] != runs["doc_id"]) | (lead["start"] != runs["start"]))]
        doc.append(late["doc_id"].to_numpy(np.int64))
        start.append(late["start"].to_numpy(np.int64))
        n.append(late["n"].to_numpy(np.int64))
        runs = runs[~whole]
    runs = runs[runs.duplicated("h", keep=False)]
    if len(runs):
        sizes = runs["n"].to_numpy(np.int64)
        heads = np.concatenate([[True], runs["h"].to_numpy()[1:] != runs["h"].to_numpy()[:-1]])
        total = np.cumsum(sizes)
        lo = 0
        while lo < len(runs):  # whole anchor groups, about a million windows at a time
            hi = int(np.searchsorted(total, (total[lo - 1] if lo else 0) + 1_000_000)) + 1
            while hi < len(runs) and not heads[hi]:
                hi += 1
            part = runs.iloc[lo:hi]
            m = part["n"].to_numpy(np.int64)
            raws = part["raw"].tolist()
            base = np.cumsum([0] + [len(r) for r in raws[:-1]])
            step = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
            kind = np.cumsum(heads[lo : lo + len(part)])
            offset = np.repeat(part["anchor"].to_numpy(np.int64), m) - step
            d, s = np.repeat(part["doc_id"].to_numpy(np.int64), m), np.repeat(part["start"].to_numpy(np.int64), m) + step
            gone = repeats(d, s, np.repeat(kind, m) * MATCH + offset, np.repeat(base, m) + step, np.frombuffer(b"".join(raws), np.uint8))
            doc.append(d[gone])
            start.append(s[gone])
            n.append(np.ones(int(gone.sum()), np.int64))
            lo = hi
    d, s, m = merged_runs(np.concatenate(doc), np.concatenate(start), np.concatenate(n))
    return pd.DataFrame({"doc_id": d, "start": s, "n": m})


def _cut(text: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.DataFrame:
    rows = []
    for t, s, n in zip(text, starts, sizes, strict=True):
        raw = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b""
        if s is None or not len(s):
            rows.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw))
            continue
        s = np.asarray(s, np.int64)
        _, at, m = merged_runs(np.zeros(len(s), np.int64), s, np.asarray(n, np.int64) + MATCH - 1)
        kept, last = [], 0
        for lo, size in zip(at.tolist(), m.tolist(), strict=True):
            kept.append(raw[last:lo])
            last = lo + size
        kept.append(raw[last:])
        left = b"".join(kept)
        rows.append((len(raw), len(raw) - len(left), len(at), hashlib.sha256(left).hexdigest(), left))
    return pd.DataFrame(rows, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def deduplicated(docs: DataFrame, keep_text: bool = True) -> DataFrame:
    """docs (doc_id, text) to (doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the bytes that stay)."""
    docs = docs.select("doc_id", "text")
    texts = docs.filter("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("hash"))
    several = texts.groupBy("doc_id").agg((F.min("hash") < F.max("hash")).alias("several")).filter("several")
    if several.isEmpty():
        return _deduplicated(docs, keep_text)
    # texts of one doc_id are told apart: every pair of doc_id and text gets a number that keeps their order
    pairs = saved(texts.distinct().withColumn("tree", F.lit(None).cast("string")))
    places = numbered(pairs, ["doc_id", "hash"]).select(F.col("doc_id").alias("own"), "hash", "place")
    rows = docs.join(places, (F.col("doc_id") == F.col("own")) & (F.xxhash64("text") == F.col("hash")) & F.col("text").isNotNull(), "left")
    rows = saved(rows.select(F.col("place").alias("doc_id"), "text", F.col("doc_id").alias("own")))
    done = _deduplicated(rows, keep_text)
    return done.select(F.col("own").alias("doc_id"), *[c for c in done.columns if c not in ("doc_id", "own")])


def _deduplicated(docs: DataFrame, keep_text: bool) -> DataFrame:
    """The same where a doc_id has one text; other columns are kept."""
    usable = docs.filter("doc_id is not null and text is not null").select("doc_id", "text")
    bits, total = repeated_anchors(usable)
    held = docs.sparkSession.sparkContext.broadcast(bits)
    runs = usable.mapInPandas(_send_runs(held), _RUNS)
    buckets = max(partitions(docs.sparkSession), -(-int(total) // 20_000))
    runs = runs.withColumn("bucket", F.pmod("h", F.lit(buckets)))
    gone = runs.groupBy("bucket").applyInPandas(_compare_group, "doc_id long, start long, n long")
    spans = gone.groupBy("doc_id").agg(F.collect_list("start").alias("starts"), F.collect_list("n").alias("sizes"))
    shape = "n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_text else "")

    @F.pandas_udf(shape)
    def cut(text: pd.Series, starts: pd.Series, sizes: pd.Series) -> pd.DataFrame:
        rows = _cut(text, starts, sizes)
        return rows if keep_text else rows.drop(columns="kept")

    done = docs.join(spans.hint("merge"), "doc_id", "left").withColumn("cut", cut("text", "starts", "sizes"))
    return done.select(*[c for c in docs.columns if c != "text"], "cut.*")


def op4_suffix_dedup(spark, sf_dir):
    return deduplicated(table(spark, sf_dir, "documents"), keep_text=False)
