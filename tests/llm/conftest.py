import random

import pytest

WORDS = "the of and river stone light under window garden paper cloud silver orange river bridge winter summer field horse".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    out = []
    for k in range(n):
        out.append(rng.choice(WORDS) + ("" if rng.random() < 0.6 else str(rng.randrange(1000))))
        if k % 9 == 8:
            out[-1] += ".\n"
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def make_prose():
    return prose


@pytest.fixture(scope="session")
def edge_rows():
    """Documents with nulls, empty and very long texts, ties, copies, near copies and repeated lines, and columns of odd names."""
    base = prose(1, 120)
    near = base.replace(base.split(" ")[40], "changed", 1)
    rows = [
        (0, base, "en", "a"), (1, near, "en", "a"), (2, base, None, "b"), (3, None, "en", None), (4, "", "de", "b"), (5, prose(2, 300), "en", None),
        (6, "   \n\n  ", "en", "a"), (7, "x" * 3000, "de", "c"), (8, "abc " * 2500, None, "c"), (9, prose(3, 4000), "en", "a"), (10, "ein Wort", "de", "b"),
        (11, "Été ▁ naïve\t日本 \U0001f642\r\nend", "fr", "b"), (12, prose(2, 300)[:900] + prose(7, 80), "en", "c"), (13, "one two three four five", "en", "c"),
        (14, "One, two; three four FIVE!", "en", "c"), (15, "12345 67890", "en", "a"),
    ]
    return rows


@pytest.fixture(scope="session")
def edges(spark, edge_rows):
    """The rows above as a table, with extra columns whose names the operators use themselves."""
    extra = "size long, h string, words long, gone string, bucket int, score double, lang_pred string, pieces string, key long, n_lines long, class_id long"
    rows = [(*r, len(r[1]) if r[1] is not None else None, 7, "h", 7, "g", 7, 0.5, "zz", "p", 7, 7, 7) for r in edge_rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + extra)


@pytest.fixture(scope="session")
def no_documents(edges):
    return edges.limit(0)
