"""Byte-pair encoding by joined halves against plain merging over whole matches, and lossless decoding."""

import hashlib
import random

import numpy as np
import pytest

import public_tokenizers
import tiktoken
from quillframe.llm import byte_pairs

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pairs():
    with open(PATH, "rb") as f:
        return byte_pairs.coder(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def plain(pairs):
    """The public library over the same ranks."""
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=pairs.ranks, special_tokens={})


def ids(pairs, text):
    return np.frombuffer(pairs.encode(text), "<u4").tolist()


@pytest.mark.parametrize("alphabet", ["ab 'rel", "a ", "  \n\tx's", "é日 a1", "0123 ab", " '  x", "thequickand \r\n", "<|endoftext|> ", "\U0001f642́a "])
@pytest.mark.parametrize("leaf", [5, 16, 8192])
def test_equal_to_plain_encoding(pairs, plain, alphabet, leaf, monkeypatch):
    monkeypatch.setattr(byte_pairs, "LEAF", leaf)
    rng = random.Random(leaf)
    for _ in range(300):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randrange(80)))
        assert ids(pairs, text) == plain.encode_ordinary(text), text
        assert pairs.decode(pairs.encode(text)) == text.encode()


@pytest.mark.parametrize("text", ["a" * 30_000, " " * 30_000 + "x", "abc" * 9_001, "'" * 9_000 + "re", "\n" * 9_000, "日本" * 5_000])
def test_long_matches(pairs, plain, text):
    """Plain encoding of such texts takes the square of their length, so they are short here; larger ones must round-trip."""
    short = text[:3_000]
    assert ids(pairs, short) == plain.encode_ordinary(short)
    assert pairs.decode(pairs.encode(text)) == text.encode()


def test_windows_against_brute_force(pairs):
    """Long windows by the heap, short ones by search, and halves: all the same as merging one pair at a time."""
    rng = random.Random(5)
    for _ in range(300):
        raw = bytes(rng.choice(b"aabtheing rs\xc3\xa9") for _ in range(rng.randrange(1, 120)))
        parts = [raw[k : k + 1] for k in range(len(raw))]
        while True:
            ranks = [pairs.ranks.get(a + b, 1 << 60) for a, b in zip(parts, parts[1:], strict=False)]
            if not ranks or min(ranks) == 1 << 60:
                break
            k = ranks.index(min(ranks))
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        expected = [pairs.ranks[p] for p in parts]
        assert pairs._merged_long(raw) == pairs.merged(raw) == pairs.encoded_bytes(raw) == expected


def test_edge_rows(spark, edges, pairs, plain):
    rows = edges.unionByName(edges.limit(3))
    got = [tuple(r) for r in byte_pairs.token_digests(rows, PATH, public_tokenizers.PATTERN).collect()]
    expected = []
    for r in rows.collect():
        text = r["text"] or ""
        code = np.array(plain.encode_ordinary(text), "<u4").tobytes()
        expected.append((r["doc_id"], len(code) // 4, hashlib.sha256(code).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(got) == sorted(expected)


def test_tokens_and_bytes(spark, edges, plain):
    for r in byte_pairs.with_tokens(edges, PATH, public_tokenizers.PATTERN).join(edges.select("doc_id", "text"), "doc_id").collect():
        assert r["ids"] == plain.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")


def test_empty_table_and_null_key(spark, no_documents):
    assert byte_pairs.token_digests(no_documents, PATH, public_tokenizers.PATTERN).count() == 0
    rows = spark.createDataFrame([(None, "some text"), (1, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["n_tokens"] for r in byte_pairs.token_digests(rows, PATH, public_tokenizers.PATTERN).collect()} == {None: 2, 1: 0}


def test_full_table_of_known_matches(pairs, monkeypatch):
    monkeypatch.setattr(byte_pairs, "KEPT", 5)
    fresh = byte_pairs.BytePairs(pairs.ranks, public_tokenizers.PATTERN)
    text = " ".join(f"word{k}ing" for k in range(300))
    assert ids(fresh, text) == ids(pairs, text)
    assert len(fresh.known) <= 5
