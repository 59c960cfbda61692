import hashlib
import random

import numpy as np
import pytest

from quillframe.llm import suffix_dedup as S


def brute(rows, n=100):
    seen, out = set(), {}
    for d, t in sorted({(d, t) for d, t in rows if d is not None}, key=lambda r: r[0]):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - n + 1):
            w = raw[p : p + n]
            if w in seen:
                gone[p : p + n] = True
            seen.add(w)
        left = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[d] = (len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest())
    return out


def result(df):
    return {r["doc_id"]: tuple(r)[1:5] for r in S.deduplicated(df, keep_text=False).collect()}


def test_edges(edges, edge_rows):
    assert result(edges) == brute([r[:2] for r in edge_rows])


def test_overlaps_periods_and_shared_passages(spark):
    rng = random.Random(4)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    shared, rows = text(260), []
    for k in range(30):
        cut = rng.randrange(0, 150)
        rows.append((k, text(rng.randrange(0, 300)) + shared[cut : cut + rng.randrange(90, 120)] + text(50) + (shared if k % 5 == 0 else "")))
    rows += [(40, "ab" * 400), (41, "ab" * 90 + "c" + "ab" * 90), (42, "é" * 200), (43, text(99)), (44, rows[0][1]), (45, rows[0][1][:150])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(df.repartition(4)) == brute(rows)


def test_repeated_rows_and_null_ids(spark):
    rng = random.Random(9)
    t = "".join(rng.choice("abcdef") for _ in range(300))
    df = spark.createDataFrame([(1, t), (1, t), (None, t), (2, t + "zz")], "doc_id long, text string")
    rows = S.deduplicated(df).collect()
    assert sorted((r["doc_id"] or -1, r["n_removed"]) for r in rows) == [(-1, 0), (1, 0), (1, 0), (2, 300)]
    assert {bytes(r["kept"]) for r in rows if r["doc_id"] == 2} == {b"zz"}


def test_text_of_one_letter(spark):
    df = spark.createDataFrame([(1, "d" * 300)], "doc_id long, text string")
    assert [(r["n_removed"], r["n_spans"]) for r in S.deduplicated(df).collect()] == [(299, 1)]


def test_pieces_of_long_texts(spark, monkeypatch):
    monkeypatch.setattr(S, "PIECE", 1000)
    rng = random.Random(2)
    t = "".join(rng.choice("abcdef") for _ in range(5000))
    bits, gone = np.full(1 << (S.BITS - 3), 255, np.uint8), []

    class Held:
        value = bits

    import pandas as pd

    sent = pd.concat(S._send_runs(Held)(iter([pd.DataFrame({"doc_id": [1, 2], "text": [t, "q" + t[700:2600]]})])))
    gone = S._compare_group(sent)
    spans = [(r.doc_id, r.start, r.n + 99) for r in gone.itertuples()]
    assert spans == [(2, 1, 1900)]


def test_sort_agrees_with_bytes():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    at = np.arange(0, 2800)
    s = S.Suffixes(data)
    order = s.sort(at, np.zeros(len(at), np.int64))
    keys = [bytes(s.data[p : p + 100]) for p in at[order]]
    assert keys == sorted(keys)


def test_empty(no_documents):
    assert S.deduplicated(no_documents).count() == 0


@pytest.mark.parametrize("n", [0, 5, 99, 100, 101])
def test_short_buffers(n):
    first, count, _, _ = S.anchored_runs(np.full(n, 7, np.uint8), np.array([n]))
    assert int(count.sum()) == max(0, n - 99)


def test_texts_of_one_id_are_apart(spark):
    """A text that another row of its doc_id does not share loses nothing; a text that an earlier id has goes, whatever else its own id has."""
    a, b = "".join(f"first {k} " for k in range(40)), "".join(f"second {k} " for k in range(40))
    rows = [(1, a), (2, a), (2, b), (2, b), (3, b), (None, a), (4, None), (5, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["n_removed"]) for r in S.deduplicated(frame).collect())
    n, m = len(a.encode()), len(b.encode())
    assert got == sorted([(1, n, 0), (2, n, n), (2, m, 0), (2, m, 0), (3, m, m), (0, n, 0), (4, 0, 0), (5, 0, 0)])
