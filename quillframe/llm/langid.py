"""Language identification with a bidirectional gated recurrent network over bytes.

Texts are read as UTF-8 in segments of ``SEGMENT`` bytes (the whole text, no prefix);
the network runs over each segment in both directions, labels every byte, and the
document's probabilities are the mean over all its bytes. Training is backpropagation
through time in numpy on the driver.

Training data: per language, the segments of the documents that come first in a hash
order, at most ``TRAIN_DOCS`` documents a language and ``TRAIN_SEGMENTS`` hash-placed
segments a document. That bound is the operator's parameter; prediction covers all.

Defined cases: null texts and texts without letters give ``und`` with score 0; with no
labelled text to learn from, every prediction is ``und``; repeated rows repeat their
result; ties between languages go to the first in code-point order.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import table

SEGMENT, HIDDEN, BATCH = 64, 8, 4096
TRAIN_DOCS, TRAIN_SEGMENTS, EPOCHS, LEARNING_RATE = 200, 6, 8, 0.02
UND = "und"


def _squash(x, scratch=None):
    """x / (1 + |x|) in place: bounded like tanh at a fraction of its cost. A gate is half of it plus a half."""
    scratch = np.abs(x, out=scratch)
    scratch += 1
    x /= scratch
    return x


def new_weights(n_langs: int, seed: int = 7) -> dict[str, np.ndarray]:
    rng, h = np.random.default_rng(seed), HIDDEN
    draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0] if len(shape) > 1 else 1)).astype(np.float32)
    w = {"W": draw(2 * h, n_langs), "b": np.zeros(n_langs, np.float32)}
    for d in "fb":
        w |= {f"E{d}": draw(257, 3 * h) * np.float32(8), f"U{d}": draw(h, 2 * h), f"V{d}": draw(h, h)}
    return w


def _direction(w, d, x, keep=False):
    """Hidden states (T, n, h) of one direction; x is (T, n) of byte codes, 256 where a segment has ended."""
    steps, n = x.shape
    h = HIDDEN
    E, U, V = w[f"E{d}"], w[f"U{d}"], w[f"V{d}"]
    states = np.zeros((steps, n, h), np.float32)
    cache, prev = [], np.zeros((n, h), np.float32)
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        a = E[x[t]]
        g = _squash(a[:, : 2 * h] + prev @ U) * np.float32(0.5) + np.float32(0.5)
        z, r = g[:, :h], g[:, h:]
        rh = r * prev
        c = _squash(a[:, 2 * h :] + rh @ V)
        new = prev + z * (c - prev)
        if keep:
            cache.append((t, prev, z, r, rh, c))
        states[t] = prev = new
    return states, cache


def _softmax(o):
    o -= o.max(axis=-1, keepdims=True)
    np.exp(o, out=o)
    o /= o.sum(axis=-1, keepdims=True)
    return o


def position_probabilities(w, x) -> np.ndarray:
    """(T, n, languages): the label distribution of every byte."""
    f, _ = _direction(w, "f", x)
    b, _ = _direction(w, "b", x)
    h = HIDDEN
    return _softmax(f @ w["W"][:h] + b @ w["W"][h:] + w["b"])


def _fast_scores(w, d, x):
    """(T, languages, n): one direction's share of the label scores. The same network as ``_direction``, with segments
    along the last axis, so that every pass is contiguous."""
    h, (steps, n) = HIDDEN, x.shape
    Eg, Ec = np.ascontiguousarray(w[f"E{d}"][:, : 2 * h].T), np.ascontiguousarray(w[f"E{d}"][:, 2 * h :].T)
    U, V = np.ascontiguousarray(w[f"U{d}"].T), np.ascontiguousarray(w[f"V{d}"].T)
    W = np.ascontiguousarray((w["W"][:h] if d == "f" else w["W"][h:]).T)
    out = np.empty((steps, W.shape[0], n), np.float32)
    state, g, mm, c, cc, s2, s1 = (np.zeros((k, n), np.float32) for k in (h, 2 * h, 2 * h, h, h, 2 * h, h))
    for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
        np.take(Eg, x[t], axis=1, out=g, mode="clip")
        np.matmul(U, state, out=mm)
        g += mm
        _squash(g, s2)
        g += 1  # twice the gate
        z, r = g[:h], g[h:]
        r *= state
        r *= 0.5
        np.take(Ec, x[t], axis=1, out=c, mode="clip")
        np.matmul(V, r, out=cc)
        c += cc
        _squash(c, s1)
        c -= state
        c *= z
        c *= 0.5
        state += c
        np.matmul(W, state, out=out[t])
    return out


def summed_probabilities(w, x) -> np.ndarray:
    """(n, languages): the label distributions of each segment's bytes, summed."""
    f, b = _fast_scores(w, "f", x), _fast_scores(w, "b", x)
    sums = np.zeros(f.shape[1:], np.float32)
    for t in range(len(x)):
        p = f[t]
        p += b[t]
        p += w["b"][:, None]
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p *= (x[t] < 256) / p.sum(axis=0)
        sums += p
    return sums.T


def _slope(gate):
    """Derivative of a gate by its input."""
    return np.float32(0.5) * (1 - np.abs(2 * gate - 1)) ** 2


def _gradients(w, x, y):
    """Loss and gradients by backpropagation through time; y is (n,) of labels, shared by a segment's bytes."""
    h, g = HIDDEN, {k: np.zeros_like(v) for k, v in w.items()}
    states = {d: _direction(w, d, x, keep=True) for d in "fb"}
    both = np.concatenate([states["f"][0], states["b"][0]], axis=2)
    p = _softmax(both @ w["W"] + w["b"])
    live = (x < 256).astype(np.float32)
    total = max(1.0, float(live.sum()))
    loss = -float((np.log(p[:, np.arange(len(y)), y] + 1e-9) * live).sum()) / total
    p[:, np.arange(len(y)), y] -= 1
    p *= (live / total)[:, :, None]
    g["W"] += np.einsum("tnh,tnl->hl", both, p, optimize=True)
    g["b"] += p.sum(axis=(0, 1))
    dstates = p @ w["W"].T
    for k, d in enumerate("fb"):
        U, V = w[f"U{d}"], w[f"V{d}"]
        carry = np.zeros((x.shape[1], h), np.float32)
        for t, prev, z, r, rh, c in reversed(states[d][1]):
            dh = dstates[t, :, k * h : (k + 1) * h] + carry
            dc = dh * z * (1 - np.abs(c)) ** 2
            drh = dc @ V.T
            dg = np.concatenate([dh * (c - prev) * _slope(z), drh * prev * _slope(r)], axis=1)
            g[f"V{d}"] += rh.T @ dc
            g[f"U{d}"] += prev.T @ dg
            np.add.at(g[f"E{d}"], x[t], np.concatenate([dg, dc], axis=1))
            carry = dh * (1 - z) + drh * r + dg @ U.T
    return loss, g


def train(segments: list[bytes], labels: np.ndarray, n_langs: int, epochs: int = EPOCHS, seed: int = 7) -> dict[str, np.ndarray]:
    """Adam over shuffled minibatches; the same input gives the same weights."""
    w, rng = new_weights(n_langs, seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(a) for k, a in w.items()}, {k: np.zeros_like(a) for k, a in w.items()}, 0
    x = _codes(segments)
    for _ in range(epochs):
        order = rng.permutation(x.shape[1])
        for at in range(0, len(order), 256):
            pick = order[at : at + 256]
            _, g = _gradients(w, x[:, pick], labels[pick])
            step += 1
            for k in w:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] ** 2
                w[k] -= (LEARNING_RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return w


def _codes(segments: list[bytes]) -> np.ndarray:
    x = np.full((len(segments), SEGMENT), 256, np.int16)
    for k, s in enumerate(segments):
        x[k, : len(s)] = np.frombuffer(s, np.uint8)
    return np.ascontiguousarray(x.T)


def pooled(w, texts: list[bytes], n_langs: int) -> np.ndarray:
    """(documents, languages): mean label distribution over all bytes of each text, in bounded batches of segments."""
    sizes = np.array([len(t) for t in texts], np.int64)
    counts = -(-sizes // SEGMENT)
    sums, owner = np.zeros((len(texts), n_langs)), np.repeat(np.arange(len(texts)), counts)
    flat = np.full(int(counts.sum()) * SEGMENT, 256, np.int16)
    at = np.concatenate([[0], np.cumsum(counts)]) * SEGMENT
    for k, t in enumerate(texts):
        flat[at[k] : at[k] + len(t)] = np.frombuffer(t, np.uint8)
    flat = flat.reshape(-1, SEGMENT)
    for lo in range(0, len(flat), BATCH):
        x = np.ascontiguousarray(flat[lo : lo + BATCH].T)
        own = owner[lo : lo + BATCH]
        first = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[first]] += np.add.reduceat(summed_probabilities(w, x).astype(np.float64), first, axis=0)
    return sums / np.maximum(1, sizes)[:, None]


def sample_segments(docs: DataFrame, langs: list[str], counts: dict[str, int], train_docs: int, train_segments: int) -> tuple[list[bytes], np.ndarray]:
    """At most train_docs documents a language, by hash order, and train_segments segments of each."""
    span = float(2**32)
    share = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("train")), F.lit(2**32)) / F.lit(span)
    wanted = F.lit(False)
    for lang in langs:
        wanted = wanted | ((F.col("lang") == lang) & (share < min(1.0, 1.5 * train_docs / max(1, counts[lang]))))

    @F.pandas_udf("array<binary>")
    def segments(text: pd.Series, key: pd.Series) -> pd.Series:
        out = []
        for t, k in zip(text, key, strict=True):
            raw = t.encode("utf-8", "surrogatepass")
            rng = np.random.default_rng(int(k) & 0xFFFFFFFF)
            n = -(-len(raw) // SEGMENT)
            picks = np.sort(rng.permutation(n)[:train_segments])
            out.append([raw[p * SEGMENT : (p + 1) * SEGMENT] for p in picks])
        return pd.Series(out)

    key = F.xxhash64(F.col("doc_id").cast("string"))
    rows = docs.filter(wanted & F.col("text").isNotNull()).select("lang", key.alias("key"), segments("text", key).alias("parts"))
    found = rows.orderBy("key", "lang").limit(2 * train_docs * len(langs)).collect()
    place, used, raw, labels = {lang: k for k, lang in enumerate(langs)}, dict.fromkeys(langs, 0), [], []
    for row in found:
        if used[row["lang"]] < train_docs:
            used[row["lang"]] += 1
            raw += [bytes(p) for p in row["parts"]]
            labels += [place[row["lang"]]] * len(row["parts"])
    return raw, np.array(labels, np.int64)


@lru_cache(maxsize=4)
def _cached_train(raw: tuple[bytes, ...], labels: tuple[int, ...], n: int):
    return train(list(raw), np.array(labels, np.int64), n)


def identify(
    docs: DataFrame, train_on: Column, train_docs: int = TRAIN_DOCS, train_segments: int = TRAIN_SEGMENTS, names: tuple[str, str] = ("lang_pred", "score")
) -> DataFrame:
    """Adds the predicted language and its score to docs under ``names``, in place of columns called so. train_on: true where a lang may be learnt from."""
    learn = docs.filter(train_on & F.col("lang").isNotNull())
    counts = {r["lang"]: r["n"] for r in learn.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    weights = None
    if langs:
        raw, labels = sample_segments(learn, langs, counts, train_docs, train_segments)
        weights = _cached_train(tuple(raw), tuple(labels.tolist()), len(langs)) if raw else None
    trained = docs.sparkSession.sparkContext.broadcast((weights, langs))

    @F.pandas_udf("lang_pred string, score double")
    def predict(text: pd.Series) -> pd.DataFrame:
        w, names = trained.value
        readable = np.array([isinstance(t, str) and any(map(str.isalpha, t)) for t in text], bool)
        pred, score = np.full(len(text), UND, object), np.zeros(len(text))
        if w is not None and readable.any():
            at = np.flatnonzero(readable)
            size, lo = 0, 0
            for hi in range(len(at) + 1):  # bounded memory whatever the lengths of the texts
                if hi == len(at) or size > 4_000_000:
                    rows = at[lo:hi]
                    if len(rows):
                        p = pooled(w, [text.iloc[k].encode("utf-8", "surrogatepass") for k in rows], len(names))
                        best = p.argmax(axis=1)
                        pred[rows] = np.array(names, object)[best]
                        score[rows] = np.clip(p[np.arange(len(rows)), best], 0.0, 1.0)
                    lo, size = hi, 0
                if hi < len(at):
                    size += len(text.iloc[at[hi]])
        return pd.DataFrame({"lang_pred": pred, "score": score})

    found = docs.withColumn("__qf_found", predict("text"))
    return found.withColumns({names[0]: F.col("__qf_found.lang_pred"), names[1]: F.col("__qf_found.score")}).drop("__qf_found")


def fold(doc_id: Column) -> Column:
    """Remainder by 5 of the crc32 of doc_id as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def op6_language_id(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = fold(F.col("doc_id")) == 0
    return identify(docs, ~held_out).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def accepted(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """Documents whose language the network can tell: not ``und`` and scored at least ``least``."""
    found = identify(docs, fold(F.col("doc_id")) != 0, names=("__qf_lang", "__qf_score"))
    return found.filter((F.col("__qf_lang") != UND) & (F.col("__qf_score") >= least)).select(*docs.columns)
