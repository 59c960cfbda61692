"""Secret scans: secrets that occur often, and secrets inside words."""

import random

from quillframe.llm import secrets

COLUMNS = "doc_id long, text string, source string"


def clean(rng):
    hexes = ["".join(rng.choice("0123456789abcdef") for _ in range(40)) for _ in range(60)]
    rows = [(k, f"the sum of the file {h} was fine and more words here", "repo/a") for k, h in enumerate(hexes)]
    return rows + [(100 + k, f"call 1234567890{k:04d} or mail a.person{k}@example.com today", "repo/b") for k in range(40)]


def test_a_secret_in_many_documents(spark):
    rng = random.Random(2)
    leaked = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123") for _ in range(32)) for _ in range(3)]
    rows = clean(rng) + [(1000 + k, f"some words token = {leaked[k % 3]} and more", "repo/a") for k in range(900)]
    found = secrets.scored(spark.createDataFrame(rows, COLUMNS)).collect()
    hit = {r["doc_id"] for r in found if r["is_secret"]}
    assert hit == set(range(1000, 1900))


def test_secrets_inside_words(spark):
    rng = random.Random(3)
    key = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n - 1)) + "7"
    k = [key(24) for _ in range(8)]
    texts = [
        f'{{"api_key":"{k[0]}","n":1}}', f"API_KEY1={k[1]}", f"https://host/path?x=1&token={k[2]}&auth={k[3]}", f"var a={{token:'{k[4]}',secret:'{k[5]}'}};f(1)",
        "password=hunter2x9", "password = hunter2x8", f"token = {k[6]}", f"api_key={k[7]}", "secret: plainletters",
    ]
    want = {*k, "hunter2x9", "hunter2x8"}
    rows = clean(rng) + [(1000 + 10 * j + i, f"some words here {t} and more words", "repo/a") for i, t in enumerate(texts) for j in range(10)]
    found = secrets.scored(spark.createDataFrame(rows, COLUMNS)).collect()
    assert want | {"plainletters"} <= {r["value"] for r in found}
    assert want <= {r["value"] for r in found if r["is_secret"]}
    assert not {r["doc_id"] for r in found if r["is_secret"]} & set(range(1000))
    assert len({(r["doc_id"], r["place"], r["part"]) for r in found}) == len(found)
