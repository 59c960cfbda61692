"""Sampled pieces: shares of long words against exact forward sums."""

from fractions import Fraction

import numpy as np

from quillframe.llm import pieces


def exact(v, word):
    """Running shares of the pieces that end with each character, by length."""
    index = {p: k for k, p in enumerate(v.pieces) if k >= 259}
    alpha, rows = [Fraction(1)], []
    for end in range(1, len(word) + 1):
        terms = [Fraction(float(v.weight[index[word[end - k : end]]])) * alpha[end - k] if word[end - k : end] in index else Fraction(0) for k in range(1, min(end, v.longest) + 1)]
        alpha.append(sum(terms))
        rows.append([float(x) for x in np.cumsum([t / alpha[-1] for t in terms])])
    return rows


def test_shares_of_words_of_9_to_40_characters():
    v = pieces.vocabulary(pieces.MODEL, 1.0)
    long_ones = [p for k, p in enumerate(v.pieces) if k >= 259 and len(p) >= 9 and p[0] == "▁" and p[1:].isascii() and p[1:].isalpha()]
    words = long_ones[:200] + ["▁" + "internationalization" + "internationalisation"[:19]]
    words += [("▁" + (a + b + c)[1:].replace("▁", ""))[:n] for n, a, b, c in zip(range(9, 41), long_ones[::7], long_ones[3::7], long_ones[5::7], strict=False)]
    words = list(dict.fromkeys(words))
    store = pieces.Lattices(v)
    numbers = store.numbers(words)
    for word, at in zip(words, store.begin[numbers], strict=True):
        for e, want in enumerate(exact(v, word)):
            assert np.allclose(store.cumulative[at + e, : len(want)], want, atol=1e-5), (word, e)


def test_long_piece_is_sampled_whole():
    v = pieces.vocabulary(pieces.MODEL, 1.0)
    piece = next(p for k, p in enumerate(v.pieces) if k >= 259 and len(p) >= 11 and p[0] == "▁" and p[1:].isascii() and p[1:].isalpha())
    n = 4000
    whole = sum(len(ids) == 1 for ids in pieces.sample([piece.replace("▁", " ")] * n, np.arange(n, dtype=np.uint64), v, 3)) / n
    rows = exact(v, piece)
    assert abs(whole - (1 - rows[-1][len(piece) - 2])) < 0.03
