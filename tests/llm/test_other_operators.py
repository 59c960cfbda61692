"""Preference pairs, sampled pieces, top-k search, language ID, fingerprints and secrets: brute force, round trips, held-out accuracy, edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillframe.llm import fingerprints, langid, pieces, preference, secrets, topk

# --- preference pairs


def test_preference_pairs(spark):
    turns = "pair_id long, turn long, role string, text string, size int"
    c = [(1, 0, "user", "hi", 1), (1, 1, "assistant", "yo", 1), (1, 2, "user", None, 1), (1, 3, "assistant", "bye", 1), (2, 0, "user", "q", 1), (None, 0, "user", "x", 1), (3, 0, None, "", 1)]
    r = [(1, 0, "user", "hi", 1), (1, 1, "assistant", "no", 1), (2, 0, "user", "q", 1), (2, 1, "assistant", "a", 1), (3, 0, None, "", 1), (4, 0, "user", "z", 1)]
    rows = {x["pair_id"]: x for x in preference.preference_pairs(spark.createDataFrame(c, turns), spark.createDataFrame(r, turns)).collect()}
    assert set(rows) == {1, 2, 3}
    one = rows[1]
    assert one["n_common"] == 1 and one["prompt"] == "<|user|>\nhi<|end|>\n"
    spans = [one["chosen"][s["start"] : s["start"] + s["length"]] for s in one["chosen_mask"]]
    assert spans == ["yo<|end|>\n", "bye<|end|>\n"] and one["rejected"] == "<|assistant|>\nno<|end|>\n"
    assert rows[2]["chosen"] == "" and rows[2]["chosen_mask"] == [] and rows[2]["n_common"] == 1
    assert rows[3]["prompt"] == "<||>\n<|end|>\n" and rows[3]["rejected"] == ""
    assert preference.preference_pairs(spark.createDataFrame([], turns), spark.createDataFrame(r, turns)).count() == 0


def test_swapped_responses(spark):
    rows = [(0, 0, "user", "a"), (0, 1, "assistant", "A"), (1, 0, "user", "b"), (1, 1, "assistant", "B"), (1, 1, "assistant", "B"), (2, 0, "user", "c"), (3, 0, "assistant", "D")]
    pairs = preference.preference_pairs(*preference.swapped_responses(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert {(p["pair_id"], p["n_common"]) for p in pairs} == {(0, 1), (1, 2)}


# --- sampled pieces


def test_pieces_round_trip_and_repeat(edges, edge_rows, no_documents):
    v = pieces.vocabulary(pieces.MODEL, pieces.TEMPERATURE)
    rows = {r["doc_id"]: r for r in pieces.encoded(edges).collect()}
    for d, t, _, _ in edge_rows:
        assert (rows[d]["pieces"] is None) == (t is None)
        if t is not None:
            assert rows[d]["lossless"] and pieces.decode(rows[d]["pieces"], v) == t
    again = {r["doc_id"]: r["pieces"] for r in pieces.encoded(edges.repartition(3), keep=["doc_id"]).collect()}
    assert again == {d: r["pieces"] for d, r in rows.items()}
    assert rows[0]["pieces"] != rows[2]["pieces"]  # one text, two keys
    assert pieces.encoded(no_documents).count() == 0


def test_sampling_follows_the_lattice():
    v = pieces.vocabulary(pieces.MODEL, 1.0)
    word = "▁under"
    index = {p: k for k, p in enumerate(v.pieces) if k >= 259}

    def ways(s):
        if not s:
            yield ()
        for k in range(1, len(s) + 1):
            if s[:k] in index:
                for rest in ways(s[k:]):
                    yield (index[s[:k]], *rest)

    weight = {w: math.prod(v.weight[k] for k in w) for w in ways(word)}
    total, n, count = sum(weight.values()), 20000, {}
    for ids in pieces.sample([" under"] * n, np.arange(n, dtype=np.uint64), v, 3):
        count[tuple(ids.tolist())] = count.get(tuple(ids.tolist()), 0) + 1
    assert set(count) <= set(weight)
    assert max(abs(count.get(w, 0) / n - x / total) for w, x in weight.items()) < 0.015


# --- top-k


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((1200, 16)) * 0.3
    x[300:700] = x[7]  # a third of all rows are one vector
    rows = [(k, v.tolist(), 1) for k, v in enumerate(x)]
    rows += [(2000, None, 1), (2050, [None] + [0.1] * 15, 1), (2100, [float("nan")] * 16, 1), (2150, [float("inf")] * 16, 1), (2200, [0.5, 0.5], 1), (2250, [], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, part int")
    whole = {k: np.pad(np.floor(256 * np.array(v)), (0, 16 - len(v))) for k, v, _ in rows if v is not None and None not in v and np.isfinite(v).all()}
    ids = np.array(sorted(whole))
    m = np.stack([whole[k] for k in ids])
    want = {}
    for q in ids[ids % 50 == 0]:
        s = m @ whole[q]
        order = [k for k in np.lexsort((ids, -s)) if ids[k] != q][:5]
        want[int(q)] = [(r, int(ids[k]), int(s[k])) for r, k in enumerate(order, 1)]
    got: dict = {}
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert got == want


def test_top_k_of_few_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (50, [0.5, 0.5]), (7, [0.0, 1.0])], "vec_id long, embedding array<float>")
    rows = topk.top_k(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in rows] == [(0, 1, 50, 32768), (0, 2, 7, 0), (50, 1, 0, 32768), (50, 2, 7, 32768)]
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_with_repeated_and_missing_ids(spark):
    rng = random.Random(6)
    rows = [(k % 90, [rng.choice((-1.0, -0.5, 0.25, 1.0)) for _ in range(4)]) for k in range(150)] + [(None, [9.0] * 4), (50, None), (50, [float("nan")] * 4)]
    got = [tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    held = {}
    for k, v in rows:
        if k is not None and v is not None and v[0] == v[0]:
            held[k] = max(held.get(k, []), [int(256 * c) for c in v])
    want = []
    for q in (0, 50):
        best = sorted((-sum(a * b for a, b in zip(held[q], v, strict=True)), k) for k, v in held.items() if k != q)[:5]
        want += [(q, r, k, -s) for r, (s, k) in enumerate(best, 1)]
    assert got == want


# --- language ID


@pytest.fixture(scope="module")
def tongues(spark):
    rng = random.Random(5)
    vocab = {"en": "the and river with house", "de": "der und über größe straße", "fr": "le été être où château"}
    rows = [(k, " ".join(rng.choice(vocab[lang].split()) for _ in range(rng.randrange(3, 60))), lang) for k, lang in enumerate(rng.choices(list(vocab), k=400))]
    rows += [(1000, None, "en"), (1001, "", "de"), (1002, "123 456 !", "fr"), (1003, "ü" * 5000, None), (1004, "the river", None), (1004, "the river", None)]
    return spark.createDataFrame([(*r, 0.1, "zz") for r in rows], "doc_id long, text string, lang string, score double, lang_pred string")


def test_language_accuracy_and_edges(tongues):
    rows = langid.identify(tongues, langid.fold(F.col("doc_id")) != 0).withColumn("held", langid.fold(F.col("doc_id")) == 0).collect()
    held = [r for r in rows if r["held"] and r["doc_id"] < 1000]
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.97 * len(held) > 0
    by = {r["doc_id"]: r for r in rows}
    assert all((by[d]["lang_pred"], by[d]["score"]) == ("und", 0.0) for d in (1000, 1001, 1002))
    assert by[1003]["lang_pred"] in ("de", "fr", "en") and by[1004]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in rows) and len(rows) == 406
    kept = {r["doc_id"] for r in langid.accepted(tongues).collect()}
    assert not kept & {1000, 1001, 1002} and len(kept) > 395


def test_language_without_labels(tongues):
    rows = langid.identify(tongues.limit(5), F.lit(False)).collect()
    assert {(r["lang_pred"], r["score"]) for r in rows} == {("und", 0.0)}
    assert langid.identify(tongues.limit(0), F.lit(True)).count() == 0


def test_gradients_by_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in langid.new_weights(3).items()}
    x = langid._codes([bytes(rng.integers(97, 110, n).astype(np.uint8)) for n in (64, 40, 7)])[:12]
    y = np.array([0, 1, 2])
    _, g = langid._gradients(w, x, y)
    for name in ("W", "Uf", "Vb", "Eb", "b"):
        flat = int(np.argmax(np.abs(g[name])))
        at = np.unravel_index(flat, g[name].shape)
        step = 1e-3
        w[name][at] += step
        up, _ = langid._gradients(w, x, y)
        w[name][at] -= 2 * step
        down, _ = langid._gradients(w, x, y)
        w[name][at] += step
        assert abs((up - down) / (2 * step) - g[name][at]) < 0.02 * abs(g[name][at]) + 1e-4, name


def test_fast_pass_is_the_same_network():
    w = langid.new_weights(4)
    x = langid._codes([b"some bytes", b"x" * 64, "größe".encode()])
    slow = (langid.position_probabilities(w, x) * (x < 256)[:, :, None]).sum(axis=0)
    assert np.allclose(slow, langid.summed_probabilities(w, x), atol=1e-3)


# --- fingerprints


def test_fingerprints(edges, edge_rows, no_documents):
    rows = {r["doc_id"]: r for r in fingerprints.fingerprints(edges).collect()}
    texts = {d: t or "" for d, t, _, _ in edge_rows}
    order = sorted(texts, reverse=True)
    for k, d in enumerate(order):
        t, nxt = texts[d], texts[order[(k + 1) % len(order)]]
        e = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        r = rows[d]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        own, other, after = fingerprints.sketches([t, e, nxt])
        assert r["fingerprint"] == own.astype(">u4").tobytes().hex() and r["edited_fingerprint"] == other.astype(">u4").tobytes().hex()
        assert r["near_edited"] == fingerprints.likeness(own, other) and r["near_next"] == fingerprints.likeness(own, after)
    assert rows[0]["fingerprint"] == rows[2]["fingerprint"] and rows[3]["fingerprint"] == rows[4]["fingerprint"]
    assert fingerprints.fingerprints(no_documents).count() == 0
    one = fingerprints.fingerprints(edges.filter("doc_id = 5")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0


MASK = 2**64 - 1


def plain_level(names):
    """One level of the parsing of one text, symbol by symbol."""
    from quillframe.llm.codepoints import BASE, mix, powers

    h = lambda x: int(mix(np.array([x & MASK], np.uint64))[0])
    base, power = int(BASE), [int(p) for p in powers()[:64]]
    runs = []
    for x in names:
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    names = [x if n == 1 else h(x + min(n, fingerprints.LONG_RUN) * base) for x, n in runs]
    label = []
    for k, x in enumerate(names):
        left = names[k - 1] if k else ~x & MASK
        low = ((x ^ left) & -(x ^ left)).bit_length() - 1
        label.append(2 * low + ((x >> low) & 1))
    for _ in range(3):
        out = []
        for k, a in enumerate(label):
            b = label[k - 1] if k else a ^ 1
            low = 0 if a == b else ((a ^ b) & -(a ^ b)).bit_length() - 1
            out.append(2 * low + ((a >> low) & 1))
        label = out
    phrases, last = [], len(names) - 1
    cut = [k == 0 or (0 < k < last and label[k] < label[k - 1] and label[k] <= label[k + 1]) for k in range(len(names))]
    for k in range(1, len(cut)):
        if k == 1:
            cut[k] = False  # a phrase has two symbols at least
    for k, x in enumerate(names):
        if cut[k]:
            phrases.append([])
        phrases[-1].append(x)
    return [h(sum(h(x) * power[i] for i, x in enumerate(p)) + len(p)) for p in phrases]


def plain_sketch(text):
    from quillframe.llm.codepoints import BASE, mix

    levels = [[int(mix(np.array([(ord(c) + int(BASE)) & MASK], np.uint64))[0]) for c in text]]
    for _ in range(fingerprints.LEVELS):
        levels.append(plain_level(levels[-1]))
    names = [x for level in levels[2:] for x in level]
    if len(names) < fingerprints.SHORT:
        names += levels[0] + levels[1]
    return sorted({x >> 32 for x in names} or {0})[: fingerprints.SKETCH]


def test_fingerprints_by_plain_parsing(edge_rows):
    texts = [t or "" for _, t, _, _ in edge_rows if len(t or "") < 4000] + ["a", "ab", "aab" * 30, "abc" * 100, "x" * 40 + "yz" * 9]
    for t, sketch in zip(texts, fingerprints.sketches(texts), strict=True):
        assert sketch.tolist() == plain_sketch(t), t[:40]


def test_phrases_do_not_depend_on_the_offset():
    rng = random.Random(8)
    t = "".join(rng.choice("abcdefghij ") for _ in range(4000))
    a, b, c = fingerprints.sketches([t, "zzz" + t, "".join(rng.choice("abcdefghij ") for _ in range(4000))])
    assert fingerprints.likeness(a, b) > 0.9 and fingerprints.likeness(a, c) < 0.1


def test_repeated_ids(spark):
    df = spark.createDataFrame([(1, "a" * 50), (1, "a" * 50), (None, "b" * 20)], "doc_id long, text string")
    assert fingerprints.fingerprints(df).count() == 3


# --- secrets


def test_secrets(spark, no_documents):
    rng = random.Random(1)
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = [(k, f'some words token = "{h}" and more', "repo/a") for k, h in enumerate(hexes[:40])]
    rows += [(100 + k, f"the sum of file {h} was fine", None) for k, h in enumerate(hexes[40:])]
    rows += [(200 + k, f"call 1234567890{k:04d} or mail a.person{k}@example.com today", "repo/b") for k in range(40)]
    rows += [(300, None, "x"), (301, "", "x"), (302, "z9" * 5000, None), (303, f"api_key={hexes[0]}", "t/test"), (303, f"api_key={hexes[0]}", "t/test")]
    df = spark.createDataFrame([(*r, 1.0, 2) for r in rows], "doc_id long, text string, source string, score double, length int")
    got = secrets.scored(df).collect()
    hit = {r["doc_id"] for r in got if r["is_secret"]}
    assert {k for k in range(40)} <= hit and 303 in hit and not hit & set(range(100, 240)) and not {300, 301} & {r["doc_id"] for r in got}
    assert sum(r["doc_id"] == 303 for r in got) == 2 and all(0 <= r["score"] <= 1 for r in got)
    assert secrets.scored(no_documents).count() == 0
