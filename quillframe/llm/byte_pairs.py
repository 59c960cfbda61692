"""Byte-level BPE by a monoid tree: halves are encoded on their own and joined at their boundary.

Encoding is a monoid over slices of a text. Two trees use it.

1. Bytes of one match of the pattern. Halves are encoded recursively. Neighbours are joined
   by encoding a window anew, one token from each side at first, then two, four and so on,
   until the window's outermost tokens come out as they were (or a side is used up). That
   proves the rest: a token sequence is the encoding of its bytes exactly if each two
   neighbours are the encoding of theirs, since a merge across two tokens of the sequence
   would be the same merge between these two alone. The pairs outside the window are old
   pairs, those inside come from an encoding, and those at its edges are unchanged.
2. Slices of one text. A slice of ``LEAF`` characters at most is split by the pattern and
   its matches are looked up. Neighbours are joined by matching anew from the left slice's
   last match that cannot have looked past its end (``LOOK`` characters before it), until a
   match starts where one of the right slice does; the pattern looks ahead only, so all
   further matches are the same.

Decoding concatenates the bytes of tokens, blocks of a text at a time, in order.

The vocabulary file is read where the query is planned and broadcast: its size is that of
the vocabulary, whatever the corpus. Per task, known matches are kept in a table of bounded
size. Documents need no shuffle.

Defined cases: null is the empty text, of no tokens; no special token is ever made; texts
of any length are whole; rows are independent, so repeated rows repeat their result; an
empty table gives an empty result; extra columns stay out of the result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame

from quillframe.llm.common import table

#: Characters of a leaf of the text tree; how far before a slice's end a match may still depend on what follows.
LEAF, LOOK = 8192, 4
#: Matches, and windows, that a worker keeps with their tokens; their longest length in characters, and in bytes.
KEPT, KEPT_CHARS = 400_000, 64
#: Bytes up to which a window is merged by plain search and kept; above the rank of any pair.
SHORT, NONE = 40, 1 << 62


class Encoded(NamedTuple):
    """A slice's encoding: where its matches start in the text, where each match's tokens start, and the tokens."""

    starts: np.ndarray
    firsts: np.ndarray
    ids: np.ndarray


class BytePairs:
    """Encoder and decoder of a rank table, by tokens' bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.known: dict[str, bytes] = _Known(self)
        self.windows: dict[bytes, list[int]] = {}

    def merged(self, window: bytes) -> list[int]:
        """Ranks after merging the pair of least rank, the leftmost of equals, for as long as there is one."""
        if len(window) > SHORT:
            return self._merged_long(window)
        if (kept := self.windows.get(window)) is not None:
            return kept
        rank_of, cuts = self.ranks.get, list(range(len(window) + 1))
        pairs = [rank_of(window[k : k + 2], NONE) for k in range(len(window) - 1)]
        while pairs and (least := min(pairs)) != NONE:
            k = pairs.index(least)
            del cuts[k + 1], pairs[k]
            if k < len(pairs):
                pairs[k] = rank_of(window[cuts[k] : cuts[k + 2]], NONE)
            if k:
                pairs[k - 1] = rank_of(window[cuts[k - 1] : cuts[k + 1]], NONE)
        out = [self.ranks[window[a:b]] for a, b in zip(cuts, cuts[1:], strict=False)]
        if len(self.windows) >= KEPT:
            self.windows.clear()
        self.windows[window] = out
        return out

    def _merged_long(self, window: bytes) -> list[int]:
        """The same by a heap of pairs over linked tokens."""
        n, ranks = len(window), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, k + 2) for k in range(n - 1) if (r := ranks.get(window[k : k + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, at, end = heapq.heappop(heap)
            middle = after[at]
            if middle >= n or middle < 0 or after[middle] != end:  # one of the two has been merged since
                continue
            after[at], after[middle] = end, -1
            if end < n:
                before[end] = at
                if (r := ranks.get(window[at : after[end]])) is not None:
                    heapq.heappush(heap, (r, at, after[end]))
            if (left := before[at]) >= 0 and (r := ranks.get(window[left:end])) is not None:
                heapq.heappush(heap, (r, left, end))
        out, at = [], 0
        while at < n:
            out.append(ranks[window[at : after[at]]])
            at = after[at]
        return out

    def joined(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of two neighbours' bytes from their own encodings."""
        size = 1
        while True:
            a, b = left[-size:], right[:size]
            new = self.merged(b"".join([self.tokens[t] for t in a + b]))
            if (size >= len(left) or new[0] == a[0]) and (size >= len(right) or new[-1] == b[-1]):
                return left[:-size] + new + right[size:]
            size *= 2

    def encoded_bytes(self, piece: bytes) -> list[int]:
        """Leaves of 16 bytes are merged as they are; longer pieces are cut at a power of two, where tokens of a run of equal bytes end."""
        if len(piece) <= 16:
            return self.merged(piece)
        half = 1 << (len(piece) - 1).bit_length() - 1
        return self.joined(self.encoded_bytes(piece[:half]), self.encoded_bytes(piece[half:]))

    def match_ids(self, match: str) -> bytes:
        """Tokens of one match of the pattern, as little-endian 32-bit numbers; a match that is a token is that token."""
        raw = match.encode("utf-8")
        whole = self.ranks.get(raw)
        ids = [whole] if whole is not None else self.encoded_bytes(raw)
        return struct.pack(f"<{len(ids)}I", *ids)

    def _of(self, lo: int, matches: list[str]) -> Encoded:
        codes = list(map(self.known.__getitem__, matches))
        ends = np.cumsum(np.fromiter(map(len, matches), np.int64, len(matches)))
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) >> 2
        starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
        return Encoded(starts + lo, np.cumsum(sizes) - sizes, np.frombuffer(b"".join(codes), "<u4"))

    def encoded_slice(self, text: str, lo: int, hi: int) -> Encoded:
        """The encoding of text[lo:hi] as a text of its own."""
        if hi - lo <= LEAF:
            return self._of(lo, self.pattern.findall(text, lo, hi))
        mid = (lo + hi) // 2
        return self.joined_slices(text, self.encoded_slice(text, lo, mid), self.encoded_slice(text, mid, hi), mid, hi)

    def joined_slices(self, text: str, left: Encoded, right: Encoded, mid: int, hi: int) -> Encoded:
        i = max(0, int(np.searchsorted(left.starts, mid - LOOK, side="right")) - 1)
        matches, j = [], len(right.starts)
        for m in self.pattern.finditer(text, int(left.starts[i]), hi):
            if m.start() >= mid and (k := int(np.searchsorted(right.starts, m.start()))) < len(right.starts) and right.starts[k] == m.start():
                j = k
                break
            matches.append(m[0])
        new = self._of(int(left.starts[i]), matches)
        head = int(left.firsts[i])
        tail = int(right.firsts[j]) if j < len(right.starts) else len(right.ids)
        firsts = [left.firsts[:i], new.firsts + head, right.firsts[j:] - tail + head + len(new.ids)]
        return Encoded(np.concatenate([left.starts[:i], new.starts, right.starts[j:]]), np.concatenate(firsts), np.concatenate([left.ids[:head], new.ids, right.ids[tail:]]))

    def encode(self, text: str) -> bytes:
        """Token ids of a whole text, as little-endian 32-bit numbers."""
        if len(text) <= LEAF:
            return b"".join(map(self.known.__getitem__, self.pattern.findall(text)))
        return self.encoded_slice(text, 0, len(text)).ids.tobytes()

    def decode(self, ids: bytes) -> bytes:
        """Bytes of token ids: halves are decoded on their own and concatenated."""
        if len(ids) > 4 * LEAF:
            half = len(ids) // 8 * 4
            return self.decode(ids[:half]) + self.decode(ids[half:])
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class _Known(dict):
    """Tokens by match; emptied when it is full."""

    def __init__(self, coder: BytePairs):
        super().__init__()
        self.coder = coder

    def __missing__(self, match: str) -> bytes:
        out = self.coder.match_ids(match)
        if len(match) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[match] = out
        return out


def rank_table(raw: bytes) -> dict[bytes, int]:
    """Ranks by token from the lines (base64 of the token, rank) of a vocabulary file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, raw.splitlines()) if token}


@lru_cache(maxsize=2)
def coder(raw: bytes, pattern: str) -> BytePairs:
    return BytePairs(rank_table(raw), pattern)


def with_tokens(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, ids, decoded): the token ids of each text, and the bytes they decode to."""
    return _mapped(docs, vocabulary, pattern, lambda ids, decoded: (np.frombuffer(ids, "<u4").astype(np.int64), decoded), "ids array<long>, decoded binary")


def token_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each text."""
    digest = lambda ids, decoded: (len(ids) >> 2, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded).hexdigest())
    return _mapped(docs, vocabulary, pattern, digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def _mapped(docs: DataFrame, vocabulary: str, pattern: str, result, schema: str) -> DataFrame:
    with open(vocabulary, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    names = [field.split()[0] for field in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs = coder(shared.value, pattern)
        for batch in batches:
            rows, ids, size = [], [], 0
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                code = pairs.encode(text if isinstance(text, str) else "")
                rows.append(result(code, pairs.decode(code)))
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                size += len(code)
                if size > 8_000_000:  # results of long texts leave one by one
                    yield _frame(ids, rows, names)
                    rows, ids, size = [], [], 0
            if rows:
                yield _frame(ids, rows, names)

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, " + schema)


def _frame(ids: list, rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame({"doc_id": pd.array(ids, dtype="Int64"), **dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))})


def op12_byte_pairs(spark, sf_dir):
    import public_tokenizers

    return token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
