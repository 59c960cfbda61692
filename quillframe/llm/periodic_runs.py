"""Maximal periodic runs of words by a harmonic grid and hashed extensions.

A run is a stretch of words whose smallest period q (words q apart are equal) fits twice
into it, of ``LEAST`` words at least, that no neighbouring word continues. In a text of n
words, for each period p up to n/2 the places 0, p, 2p, ... form a grid of n/p points, n ln n
points in all. A run of period p has a grid point g with g and g + p inside it, so it is
found where words g and g + p are equal, by extending both ways.

1. All (text, period, grid point) triples of a batch are laid out flat, in pieces of
   ``TRIPLES``, and kept where the two words are equal.
2. Prefix hashes (polynomials modulo 2**64 over mixed word numbers) and one vectorised
   binary search give the longest common extension to the right and to the left of all kept
   triples at once.
3. Stretches that hold their period twice are put together by (text, start, end), with the
   smallest period that found them: that is the smallest there is, as a multiple of a period
   extends exactly as far. Their words are then compared one by one. A text in which hashes
   have deceived is done again by comparing words for each period.

Texts need no shuffle. Memory is bounded by the longest text and the piece of triples.

Defined cases: null is the empty text, of no words; texts below ``LEAST`` words have no run;
words are byte strings between ASCII white space, so other spaces belong to words; rows are
independent, so repeated rows repeat their result; an empty table gives an empty result;
extra columns stay out of the result.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from itertools import compress, count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from quillframe.llm.codepoints import BASE, chunks, mix
from quillframe.llm.common import table

#: Words of the shortest run; triples laid out at a time; words of a batch.
LEAST, TRIPLES, BATCH = 12, 1 << 20, 400_000
#: A run of LEAST words or more has so many places whose word is equal to that a period on.
_MATCHED = LEAST // 2


def _powers(n: int) -> np.ndarray:
    out = np.full(n, BASE, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _extended(same, most: np.ndarray) -> np.ndarray:
    """The largest length up to ``most`` for which ``same(length)`` holds, of each item, by binary search; it holds for 0."""
    low, high = np.zeros_like(most), most.copy()
    while (low < high).any():
        middle = (low + high + 1) >> 1
        ok = same(middle)
        low = np.where(ok, middle, low)
        high = np.where(ok, high, middle - 1)
    return low


def _spread(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For items of these sizes laid out flat: the item, and the place in it."""
    item = np.repeat(np.arange(len(sizes)), sizes)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _smallest(found: np.ndarray) -> np.ndarray:
    """Of rows (text, start, end, period), the one of smallest period for each stretch, in order."""
    found = found[np.lexsort(found.T[::-1])]
    first = np.ones(len(found), bool)
    first[1:] = (found[1:, :3] != found[:-1, :3]).any(axis=1)
    return found[first]


def _candidates(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows (text, start, end, period), places counted over the batch, by hashes alone."""
    sizes = np.diff(at)
    prefix, power = np.zeros(len(words) + 1, np.uint64), _powers(len(words) + 1)
    np.cumsum(mix(words.astype(np.uint64) + BASE) * power[:-1], out=prefix[1:])
    # periods of each text, and the grid points of each period
    text, period = _spread(np.where(sizes >= LEAST, sizes // 2, 0))
    period += 1
    points = (sizes[text] - 1) // period
    piece = np.cumsum(points) // TRIPLES
    out = [np.zeros((0, 4), np.int64)]
    for part in np.split(np.arange(len(text)), np.flatnonzero(np.diff(piece)) + 1):
        item, k = _spread(points[part])
        p = period[part][item]
        owner = text[part][item]
        g = at[owner] + k * p
        hit = words[g] == words[g + p]
        g, p, lo, hi = g[hit], p[hit], at[owner[hit]], at[owner[hit] + 1]
        owner = owner[hit]
        scale = power[p]
        right = _extended(lambda n, g=g, p=p, scale=scale: (prefix[g + n] - prefix[g]) * scale == prefix[g + p + n] - prefix[g + p], hi - g - p)
        # the stretch to the left, of as many places as it may still need or have
        able = right + (g - lo) >= np.maximum(p, _MATCHED)
        g, p, lo, owner, right, scale = g[able], p[able], lo[able], owner[able], right[able], scale[able]
        left = _extended(lambda n, g=g, p=p, scale=scale: (prefix[g] - prefix[g - n]) * scale == prefix[g + p] - prefix[g + p - n], g - lo)
        matched = left + right
        good = (matched >= p) & (matched + p >= LEAST)
        start = g - left
        out.append(_smallest(np.stack([owner, start, start + matched + p, p], axis=1)[good]))
    return _smallest(np.concatenate(out))


def _deceived(words: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The texts with a stretch whose words are not what its hashes said."""
    wrong = [np.zeros(0, np.int64)]
    lengths = found[:, 2] - found[:, 1] - found[:, 3]
    for part in chunks(lengths.tolist(), TRIPLES):
        item, k = _spread(lengths[part])
        x = found[part, 1][item] + k
        wrong.append(found[part, 0][item[words[x] != words[x + found[part, 3][item]]]])
    return np.unique(np.concatenate(wrong))


def _compared(words: np.ndarray, lo: int, hi: int, text: int) -> np.ndarray:
    """The stretches of one text by comparing the words of every period."""
    out = [np.zeros((0, 4), np.int64)]
    for p in range(1, (hi - lo) // 2 + 1):
        edges = np.flatnonzero(np.diff(np.concatenate([[False], words[lo : hi - p] == words[lo + p : hi], [False]]).astype(np.int8)))
        start, stop = edges[::2], edges[1::2]
        good = (stop - start >= p) & (stop - start + p >= LEAST)
        start, stop = start[good], stop[good]
        out.append(np.stack([np.full(len(start), text), start + lo, stop + p + lo, np.full(len(start), p)], axis=1))
    return _smallest(np.concatenate(out))


def found_runs(words: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Rows (start, length, period) of each text, by start, then period. ``words``: numbers of the words of all texts; ``at``: where each text starts, and the end."""
    found = _candidates(words, at)
    for text in _deceived(words, found).tolist():
        found = np.concatenate([found[found[:, 0] != text], _compared(words, int(at[text]), int(at[text + 1]), text)])
    found = found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]
    rows = np.stack([found[:, 1] - at[found[:, 0]], found[:, 2] - found[:, 1], found[:, 3]], axis=1)
    return np.split(rows, np.searchsorted(found[:, 0], np.arange(1, len(at) - 1)))


def split_words(text: str | None) -> list[bytes]:
    """Byte strings between spaces, tabs, line breaks, vertical tabs and form feeds."""
    return text.encode("utf-8", "surrogatepass").split() if isinstance(text, str) else []


def kept_words(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words without those of each run behind its first period."""
    if not len(runs):
        return words
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    return list(compress(words, (np.cumsum(change[:-1]) == 0).tolist()))


def with_period(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """Of one text in ten, the words from a place on become repetitions of the first few of them; which, where and how many follows from doc_id."""
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def _mapped(docs: DataFrame, words_of, result, schema: str) -> DataFrame:
    """``result(words, runs)`` of every text, of which there may be several rows."""
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = [None if pd.isna(d) else int(d) for d in batch["doc_id"]]
            texts = batch["text"].tolist()
            for part in chunks([len(t) // 4 if isinstance(t, str) else 0 for t in texts], BATCH):
                lists = [words_of(t, d) for t, d in zip(texts[part], ids[part], strict=True)]
                at = np.concatenate([[0], np.cumsum([len(w) for w in lists])]).astype(np.int64)
                number: dict[bytes, int] = {}
                flat = np.fromiter((x for w in lists for x in map(number.setdefault, w, count(len(number)))), np.int64, int(at[-1]))
                rows = [(d, *r) for d, w, runs in zip(ids[part], lists, found_runs(flat, at), strict=True) for r in result(w, runs)]
                if rows:
                    columns = list(zip(*rows, strict=True))
                    yield pd.DataFrame({n: pd.array(c, dtype="Int64") if isinstance(next((x for x in c if x is not None), 0), int) else list(c) for n, c in zip(["doc_id", *names], columns, strict=True)})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, " + schema)


def runs(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period) of every run of every text, in words."""
    return _mapped(docs, lambda t, _: split_words(t), lambda words, found: map(tuple, found.tolist()), "start long, length long, period long")


def collapsed(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each run cut to its first period, words joined by one space."""
    return _mapped(docs, lambda t, _: split_words(t), lambda words, found: [(b" ".join(kept_words(words, found)).decode("utf-8", "surrogatepass"),)], "text string")


def _digest(words: list[bytes], found: np.ndarray):
    rows = found.tolist()
    longest = min(rows, key=lambda r: (-r[1], r[0], r[2]), default=None)
    figures = (*longest, 1000 * longest[1] // longest[2]) if longest else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
    return [(len(rows), *figures, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(b" ".join(kept_words(words, found))).hexdigest())]


def run_digests(docs: DataFrame, words_of=lambda text, _: split_words(text)) -> DataFrame:
    """Number of runs, the longest one, and digests of the runs and of the collapsed text, of each document."""
    schema = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"
    return _mapped(docs, words_of, _digest, schema)


def op11_periodic_runs(spark, sf_dir):
    return run_digests(table(spark, sf_dir, "documents"), lambda text, doc_id: with_period(split_words(text), doc_id))
