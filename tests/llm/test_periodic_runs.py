"""Periodic runs of words against the definition, hash collisions included."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from quillframe.llm import periodic_runs as pr


def by_definition(w):
    """(start, length, period) of each run: stretches of equal words a period apart, with their smallest period."""
    smallest = {}
    for p in range(1, len(w) // 2 + 1):
        x = 0
        while x + p < len(w):
            y = x
            while y + p < len(w) and w[y] == w[y + p]:
                y += 1
            if y - x >= p:
                smallest.setdefault((x, y + p), p)
            x = max(y, x + 1)
    return sorted((s, e - s, p) for (s, e), p in smallest.items() if e - s >= 12)


def found(*texts):
    at = np.cumsum([0, *map(len, texts)])
    return [list(map(tuple, r.tolist())) for r in pr.found_runs(np.array([x for t in texts for x in t], np.int64), at)]


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_against_definition(piece, monkeypatch):
    monkeypatch.setattr(pr, "TRIPLES", piece)
    rng = random.Random(piece)
    for _ in range(200):
        texts = []
        for _ in range(4):
            w = [rng.randrange(rng.choice([1, 2, 3, 7])) for _ in range(rng.choice([0, 1, 5, 11, 12, 13, 40, 90]))]
            texts.append(w + w[: rng.randrange(1, len(w) + 1)] * rng.randrange(4) if w else w)
        assert found(*texts) == [by_definition(t) for t in texts]


def test_texts_do_not_touch():
    assert found([1] * 8, [1] * 8) == [[], []]
    assert found([1] * 12, [1] * 11, [1] * 13) == [[(0, 12, 1)], [], [(0, 13, 1)]]


def test_smallest_period_and_edges():
    assert found([1, 2] * 6 + [1]) == [[(0, 13, 2)]]
    assert found([9] + [1, 2, 3, 4, 5, 6] * 2 + [7]) == [[(1, 12, 6)]]
    assert found([1, 2, 3, 4, 5] * 2 + [9]) == [[]]  # 10 words are too few


def test_colliding_hashes():
    """Polynomials modulo 2**64 take a Thue-Morse word and its complement for one; the words decide."""
    word = [k.bit_count() % 2 for k in range(2048)]
    text = word + [1 - x for x in word]
    at = np.array([0, len(text)])
    assert len(pr._deceived(np.array(text), pr._candidates(np.array(text), at))) == 1
    assert found(text) == [by_definition(text)]


def expected(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    rows = by_definition(words)
    dropped = {i for s, n, q in rows for i in range(s + q, s + n)}
    longest = sorted(rows, key=lambda r: (-r[1], r[0], r[2]))[:1]
    figures = (*longest[0], 1000 * longest[0][1] // longest[0][2]) if longest else (None,) * 4
    listed = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
    left = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return doc_id, len(rows), *figures, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(left).hexdigest()


def test_query_against_definition(spark, tmp_path, make_prose, edge_rows):
    """Texts of up to 400 words under 60 ids, with white space of all kinds and words of odd characters."""
    odd = ["a b c " * 7 + " x   y", "\x1cx \x0b" * 14, "A a " * 9, "one two\x00 three " * 5, "", None, " \n\t ", "w " * 12]
    rows = [(k, t) for k, t in enumerate(odd)] + [(k + 100, make_prose(k, 20 + 6 * k)) for k in range(60)]
    rows += [(r[0] + 1000, r[1]) for r in edge_rows if len(r[1] or "") < 3000]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: tuple(r) for r in pr.op11_periodic_runs(spark, str(tmp_path)).collect()}
    assert got == {k: expected(k, t) for k, t in rows}
    assert sum(r[1] > 0 for r in got.values()) > 10


def test_operator_rows(spark, edges, no_documents):
    both = edges.unionByName(edges.limit(2))
    assert pr.run_digests(both).count() == edges.count() + 2
    spans = {(r["doc_id"], r["start"], r["length"], r["period"]) for r in pr.runs(both).collect()}
    assert (8, 0, 2500, 1) in spans
    texts = {r["doc_id"]: r["text"] for r in pr.collapsed(both).collect()}
    assert texts[8] == "abc" and texts[3] == "" and texts[4] == "" and texts[7] == "x" * 3000
    for frame in (pr.runs(no_documents), pr.collapsed(no_documents), pr.run_digests(no_documents)):
        assert frame.count() == 0


def test_null_key_and_long_text(spark):
    rows = spark.createDataFrame([(None, "x y " * 20), (1, "word " * 200_000)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_runs"], r["length"], r["period"]) for r in pr.run_digests(rows, lambda t, d: pr.with_period(pr.split_words(t), d)).collect()}
    assert got == {None: (1, 40, 2), 1: (1, 200_000, 1)}
