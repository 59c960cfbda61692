"""Sampled SentencePiece segmentation: forward filtering, backward sampling over the piece lattice.

The lattice of a text is the product of the lattices of its words (a word starts at each
space marker), because no vocabulary piece crosses from a word's end into the next
marker; runs of markers, for which such pieces exist, are kept in one word. Forward
filtering therefore runs once for each distinct word of a batch, and backward sampling
once for each occurrence, both in numpy over all of them at a time.

A piece's log-probability is -log(rank + RANK_OFFSET): the model file is a BPE model,
whose scores are negated merge ranks, and frequency falls about as 1 / rank.
``temperature`` scales it. Random numbers are a hash of the row's key, the seed and the
position, so a row gets the same segmentation on any executor and in any batch.

Lossless: a space is written as the marker U+2581; a marker in the text itself and every
character outside the vocabulary are written as their UTF-8 bytes (byte pieces), so
decoding gives back the text exactly.

Defined cases: null text gives null pieces; the empty text gives none; repeated rows
with one key get equal samples; extra columns stay as they are.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.llm.codepoints import chunks, mix
from quillframe.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
RANK_OFFSET, TEMPERATURE, SEED = 10.0, 1.0, 11
#: Characters whose lattices are held at a time.
CHUNK = 200_000
#: Characters of distinct words whose lattices are kept: some 100 MB.
STORE = 1_000_000
MARK = "▁"
#: A word: markers, then the characters up to the next marker. Long ones are split where no piece could cross.
LITERAL = "\0" + MARK  # not a word that _WORD finds: those have markers only in front
_WORD = re.compile(f"{MARK}*[^{MARK}]*")


class Vocabulary:
    """Pieces of a model file as a trie over code points, in arrays."""

    def __init__(self, model: str, temperature: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        n = sp.get_piece_size()
        self.pieces = [sp.id_to_piece(k) for k in range(n)]
        self.byte_id = np.zeros(256, np.int32)
        normal = []
        for k, piece in enumerate(self.pieces):
            if sp.is_byte(k):
                self.byte_id[int(piece[3:-1], 16)] = k
            elif not (sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k)):
                normal.append(k)
        self.shown = [p.replace(MARK, " ") for p in self.pieces]
        for b in range(128):
            self.shown[self.byte_id[b]] = chr(b)
        self.longest = max(len(self.pieces[k]) for k in normal)
        chars = sorted({c for k in normal for c in self.pieces[k]})
        symbol = {c: s + 1 for s, c in enumerate(chars)}
        self.symbol_of = np.zeros(0x110000, np.int32)
        self.symbol_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        base = len(chars) + 1
        nodes: dict[tuple[int, int], int] = {}
        ids, count = [-1], 1
        for k in normal:
            at = 0
            for c in self.pieces[k]:
                key = (at, symbol[c])
                if key not in nodes:
                    nodes[key] = count
                    ids.append(-1)
                    count += 1
                at = nodes[key]
            ids[at] = k
        self.piece_at = np.array(ids, np.int32)
        keys = np.array([a * base + s for a, s in nodes], np.int64)
        order = np.argsort(keys)
        self.edges, self.targets, self.base = keys[order], np.array(list(nodes.values()), np.int32)[order], base
        rank = np.arange(n, dtype=np.float64)
        self.weight = np.exp(-temperature * np.log(rank + RANK_OFFSET))

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Child of each node by symbol, -1 where there is none."""
        key = node.astype(np.int64) * self.base + symbol
        at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
        return np.where((self.edges[at] == key) & (node >= 0) & (symbol > 0), self.targets[at], -1)


@lru_cache(maxsize=2)
def vocabulary(model: str, temperature: float) -> Vocabulary:
    return Vocabulary(model, temperature)


class Lattices:
    """Forward-filtered lattices of distinct words, kept from one group of texts to the next and dropped when STORE characters are full.

    Row e of ``piece`` has the pieces that end with character e, by length; the same row of
    ``cumulative`` has their running shares of all ways to get there.
    """

    def __init__(self, v: Vocabulary):
        self.v, self.used = v, 0
        self.words: dict[str, int] = {}
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.room(STORE)

    def room(self, n: int) -> None:
        width = self.v.longest
        self.piece = np.full((n, width), -1, np.int16 if len(self.v.pieces) < 2**15 else np.int32)
        self.cumulative = np.ones((n, width), np.float32)
        self.unknown = np.zeros(n, bool)
        self.points = np.zeros(n, np.uint32)

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word, new ones filtered first."""
        known = self.words
        fresh = list(dict.fromkeys(w for w in words if w not in known))
        need = sum(map(len, fresh))
        if self.used + need > len(self.piece) and self.used:
            self.__init__(self.v)
            return self.numbers(words)
        if need > len(self.piece):
            self.room(need)
        if fresh:
            self.filter(fresh)
            known = self.words
        return np.fromiter((known[w] for w in words), np.int64, len(words))

    def filter(self, words: list[str]) -> None:
        v, base = self.v, self.used
        texts = [MARK if w == LITERAL else w for w in words]
        sizes = np.array([len(t) for t in texts], np.int64)
        at = np.cumsum(sizes) - sizes
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols, total, width = v.symbol_of[points], len(points), v.longest
        if LITERAL in words:
            symbols[at[words.index(LITERAL)]] = 0
        piece, cumulative = self.piece[base : base + total], self.cumulative[base : base + total]
        left = np.repeat(at + sizes, sizes) - np.arange(total)  # characters from here to the word's end
        live, node = np.arange(total), np.zeros(total, np.int32)
        for k in range(width):
            keep = left[live] > k
            live, node = live[keep], node[keep]
            node = v.step(node, symbols[live + k])
            keep = node >= 0
            live, node = live[keep], node[keep]
            piece[live + k, k] = v.piece_at[node]
        unknown = piece[:, 0] < 0  # written as bytes: one edge of the rarest piece's weight, cubed
        # forward filtering; words advance together, by position, longest first
        order = np.argsort(-sizes, kind="stable")
        starts, ascending = at[order], sizes[order][::-1]
        alpha, start = np.zeros(total), np.ones(len(order))  # start: a word's alpha before its first character
        weight = np.append(v.weight, 0.0)  # piece -1: no edge
        for t in range(int(sizes.max(initial=0))):
            e = starts[: len(order) - np.searchsorted(ascending, t, side="right")] + t
            span = min(width, t + 1)
            terms = weight[piece[e, :span]]
            terms[unknown[e], 0] = v.weight[-1] ** 3
            for k in range(min(width, t)):
                terms[:, k] *= alpha[e - k - 1]
            if t < width:
                terms[:, t] *= start[: len(e)]
            cum = np.cumsum(terms, axis=1)
            full = cum[:, -1]
            cumulative[e, :span] = cum / full[:, None]
            alpha[e] = full
            if t % 8 == 7:  # rescale a word's recent values together, lest long words underflow
                for k in range(span):
                    alpha[e - k] /= full
                if t < width:
                    start[: len(e)] /= full
        self.unknown[base : base + total], self.points[base : base + total] = unknown, points
        self.words.update(zip(words, range(len(self.begin), len(self.begin) + len(words)), strict=True))
        self.begin, self.size = np.append(self.begin, base + at), np.append(self.size, sizes)
        self.used += total


@lru_cache(maxsize=2)
def lattices(v: Vocabulary) -> Lattices:
    return Lattices(v)


def sample(texts: list[str], keys: np.ndarray, v: Vocabulary, seed: int) -> list[np.ndarray]:
    """Piece ids of one sampled segmentation of each text."""
    all_words: list[str] = []
    per_text = []
    for t in texts:
        if MARK in t:  # a marker in the text itself is no space: it stands alone, as a symbol outside the vocabulary
            words = []
            for part in re.split(f"({MARK})", t):
                words += [LITERAL] if part == MARK else _WORD.findall(part.replace(" ", MARK))
            words = [w for w in words if w]
        else:
            words = _WORD.findall(t.replace(" ", MARK))
            if words and not words[-1]:
                words.pop()
        per_text.append(len(words))
        all_words += words
    if not all_words:
        return [np.zeros(0, np.int32) for _ in texts]
    store = lattices(v)
    kind = store.numbers(all_words)
    n, begin = store.size[kind], store.begin[kind]
    owner = np.repeat(np.arange(len(texts)), per_text)
    ends = np.cumsum(n)
    starts_of_text = np.concatenate([[0], np.cumsum(np.bincount(owner, weights=n, minlength=len(texts)).astype(np.int64))])
    first = (ends - n - starts_of_text[owner]).astype(np.uint64)  # the word's start in its own text
    salt = mix(keys.astype(np.uint64) ^ mix(np.array([seed], np.uint64)))[owner]
    found_at, found_id = [], []
    live, back = np.arange(len(kind)), n.copy()  # back: characters of the word not yet segmented
    while len(live):
        e = begin[live] + back[live] - 1
        where = first[live] + back[live].astype(np.uint64)
        u = (mix(salt[live] + where * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(40)).astype(np.float32) * np.float32(2**-24)
        k = np.zeros(len(live), np.int64)
        open_, row, draw = np.arange(len(live)), e, u
        for j in range(v.longest - 1):  # the first length whose running share exceeds the draw; most are short
            more = store.cumulative[row, j] <= draw
            open_, row, draw = open_[more], row[more], draw[more]
            if not len(open_):
                break
            k[open_] += 1
        found_at.append(ends[live] - n[live] + back[live])
        found_id.append(np.where(store.unknown[e] & (k == 0), -1 - e, store.piece[e, k]))
        back[live] -= k + 1
        live = live[back[live] > 0]
    at, ids = np.concatenate(found_at), np.concatenate(found_id)
    slot = np.full(int(ends[-1]) + 1, np.iinfo(np.int64).min)
    slot[at] = ids  # places are distinct: a counting sort
    used = slot != np.iinfo(np.int64).min
    ids = slot[used]
    cut = np.cumsum(used)[starts_of_text]
    bare = np.flatnonzero(ids < 0)
    if not len(bare):
        flat = ids.astype(np.int32)
        return [flat[lo:hi] for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
    raws = [v.byte_id[list(chr(store.points[-1 - x]).encode("utf-8", "surrogatepass"))] for x in ids[bare]]
    count = np.ones(len(ids), np.int64)
    count[bare] = [len(r) for r in raws]
    flat = np.repeat(ids, count).astype(np.int32)
    place = np.cumsum(count) - count
    fill = np.repeat(place[bare], count[bare]) + np.concatenate([np.arange(len(r)) for r in raws])
    flat[fill] = np.concatenate(raws)
    bounds = np.append(place, len(flat))[cut]
    return [flat[lo:hi] for lo, hi in zip(bounds[:-1], bounds[1:], strict=True)]


def decode(ids, v: Vocabulary) -> str:
    """The text whose segmentation these ids are."""
    out, raw = [], bytearray()
    first = int(v.byte_id[0])
    for k in ids:
        k = int(k)
        if first <= k < first + 256:
            raw.append(k - first)
        else:
            if raw:
                out.append(raw.decode("utf-8", "surrogatepass"))
                raw.clear()
            out.append(v.pieces[k].replace(MARK, " "))
    if raw:
        out.append(raw.decode("utf-8", "surrogatepass"))
    return "".join(out)


def _decodes(texts: list[str], ids: list[np.ndarray], v: Vocabulary) -> list[bool]:
    """Whether each list of ids decodes to its text."""
    names, high = v.shown, v.byte_id[128:]
    out = []
    for t, k in zip(texts, ids, strict=True):
        if ((k >= high[0]) & (k <= high[-1])).any():  # bytes of characters beyond ASCII
            out.append(decode(k, v) == t)
        else:
            out.append("".join(map(names.__getitem__, k.tolist())) == t)
    return out


def encoded(
    docs: DataFrame, keep: list[str] | None = None, key: str = "doc_id", text: str = "text", model: str = MODEL, temperature: float = TEMPERATURE, seed: int = SEED
) -> DataFrame:
    """The kept columns of docs (all, if not named), then pieces (array of ids) and lossless (the decoded pieces equal the text).

    Texts are worked off and sent back in groups of CHUNK characters, so memory does not depend on the batch.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("pieces", "lossless")]
    shape = T.StructType([docs.schema[c] for c in keep] + [T.StructField("pieces", T.ArrayType(T.IntegerType())), T.StructField("lossless", T.BooleanType())])

    def segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(model, temperature)
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch["__qf_text"]), 0).to_pylist()
            for part in chunks(sizes, CHUNK):
                rows = batch.slice(part.start, part.stop - part.start)
                texts = rows["__qf_text"].to_pylist()
                hashes = rows["__qf_key"].to_numpy().view(np.uint64)
                known = np.array([k for k, t in enumerate(texts) if t is not None], np.int64)
                group = [texts[k] for k in known]
                ids = sample(group, hashes[known], v, seed)
                same: list = [None] * len(texts)
                count = np.zeros(len(texts), np.int64)
                for k, found, ok in zip(known, ids, _decodes(group, ids, v), strict=True):
                    same[k], count[k] = ok, len(found)
                offsets = pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32())
                flat = pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32())
                pieces = pa.ListArray.from_arrays(offsets, flat, mask=pa.array([s is None for s in same]))
                yield pa.RecordBatch.from_arrays([*[rows[c] for c in keep], pieces, pa.array(same, pa.bool_())], names=shape.fieldNames())

    rows = docs.select(*keep, F.xxhash64(F.col(key).cast("string")).alias("__qf_key"), F.col(text).alias("__qf_text"))
    return rows.mapInArrow(segment, shape)


def op3_sample_pieces(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.length("text").cast("long").alias("n_chars"))
    return encoded(docs, keep=["doc_id", "n_chars"]).select("doc_id", "n_chars", F.size("pieces").cast("long").alias("n_pieces"), "lossless", "pieces")
