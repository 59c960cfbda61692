"""Axes, inheritance and edits by sweeps against plain loops over random trees."""

import random

import pytest
from pyspark.sql import functions as F

from quillframe.operators import tree


def random_page(rng, n):
    out, opened = [], []
    for _ in range(n):
        k = rng.random()
        if k < 0.45 and len(opened) < 9:
            name = rng.choice("abc")
            out.append(f"<{name}{rng.choice(['', ' lang=\"' + rng.choice(['en', 'fr']) + '\"'])}>")
            opened.append(name)
        elif k < 0.75 and opened:
            out.append(f"</{opened.pop()}>")
        else:
            out.append(rng.choice(["x", "<br>", "<!-- n -->", "y &amp; z"]))
    return "".join(out) + "".join(f"</{name}>" for name in reversed(opened))


@pytest.fixture(scope="module")
def pages(spark):
    rng = random.Random(4)
    rows = [(k, random_page(rng, rng.randrange(1, 60))) for k in range(25)]
    return tree.shred(spark.createDataFrame(rows, "id long, html string").repartition(4), "id", "html").cache()


RULES = {
    "ancestor": lambda a, b: b.pre < a.pre and b.post > a.post,
    "descendant": lambda a, b: b.pre > a.pre and b.post < a.post,
    "child": lambda a, b: b.parent == a.pre,
    "parent": lambda a, b: a.parent == b.pre,
    "preceding": lambda a, b: b.pre < a.pre and b.post < a.post,
    "following": lambda a, b: b.pre > a.pre and b.post > a.post,
    "preceding-sibling": lambda a, b: b.parent == a.parent and b.sib_no < a.sib_no,
    "following-sibling": lambda a, b: b.parent == a.parent and b.sib_no > a.sib_no,
}


@pytest.mark.parametrize("axis", tree.AXES)
@pytest.mark.parametrize("n,name", [(1, ""), (2, "b"), (1, "*")])
def test_axes_against_rules(pages, axis, n, name):
    rows, expected = pages.collect(), set()
    for a in (r for r in rows if r.kind == "element"):
        found = [b for b in rows if b.doc_id == a.doc_id and RULES[axis](a, b) and (name == "" or b.kind == "element" and name in ("*", b.name))]
        found.sort(key=lambda b: b.pre, reverse=axis in ("ancestor", "preceding", "preceding-sibling"))
        if len(found) >= n:
            expected.add((a.doc_id, a.pre, found[n - 1].pre))
    got = tree.select(pages.filter("kind = 'element'"), pages, axis, n, tree.matches(name))
    assert {(r.doc_id, r.from_pre, r.pre) for r in got.collect()} == expected


def test_context_outside_the_nodes(pages):
    """Nodes may be a part of the tree: ancestors are still told by their numbers."""
    some = pages.filter("name = 'a'")
    got = {(r.doc_id, r.from_pre, r.pre) for r in tree.select(pages.filter("name = 'b'"), some, "ancestor").collect()}
    rows = pages.collect()
    expected = set()
    for b in (r for r in rows if r.name == "b"):
        above = [a.pre for a in rows if a.name == "a" and a.doc_id == b.doc_id and a.pre < b.pre and a.post > b.post]
        if above:
            expected.add((b.doc_id, b.pre, max(above)))
    assert got == expected


def test_inherited_and_branches(pages):
    rows = {(r.doc_id, r.pre): r for r in pages.collect()}
    for r in tree.inherited(pages, "lang", "found").collect():
        at, value = rows[r.doc_id, r.pre], None
        while at is not None and value is None:
            value = at.attrs.get("lang")
            at = rows.get((r.doc_id, at.parent))
        assert r.found == value
    for r in tree.branches(pages).collect():
        a = rows[r.doc_id, r.pre]
        under = [b for b in rows.values() if b.doc_id == a.doc_id and b.pre > a.pre and b.post < a.post]
        assert (r.left_leaf, r.right_leaf) == (min(under, key=lambda b: b.post).pre, max(under, key=lambda b: b.pre).pre)


def markup(df):
    return {r["doc_id"]: r["markup"] for r in tree.serialized(df).collect()}


def test_untagged_equals_the_page_without_tags(spark, pages):
    """Of untagged trees, numbers, paths and markup are those of the page without the tags."""
    import re

    flat = tree.untagged(pages, "b")
    texts = [(k, re.sub(r"</?b>|<b [^>]*>", "", text)) for k, text in markup(pages).items()]
    again = tree.shred(spark.createDataFrame(texts, "id long, html string"), "id", "html")
    merged = tree.merged_sibling_texts(flat)
    key = ["doc_id", "pre", "post", "parent", "depth", "sib_no", "kind", "name", "text", "path", "pointer"]
    br = lambda df: sorted(map(str, df.select(*key).collect()))
    assert br(merged) == br(again)
    assert markup(merged) == markup(again)


def test_edits_after_edits(spark):
    nodes = tree.shred(spark.createDataFrame([(1, "<a><b>x</b><c>y<d>z</d></c></a>")], "id long, html string"), "id", "html")
    edited = tree.inserted_sibling(tree.untagged(nodes, "c"), F.col("name") == "d", "z")
    assert markup(edited) == {1: "<a><b>x</b>y<d>z</d><z></z></a>"}
    edited = tree.wrapped_in_parent(tree.merged_sibling_texts(tree.untagged(nodes, "b")), F.col("name") == "c", "w")
    assert markup(edited) == {1: "<a>x<w><c>y<d>z</d></c></w></a>"}
    edited = tree.untagged(tree.inserted_sibling(tree.promoted_children(nodes, "d"), F.col("name") == "b", "e"), "c")
    assert markup(edited) == {1: "<a><b>x</b><e></e>yz</a>"}
    assert tree.untagged(nodes.limit(0), "a").count() == 0


def test_a_large_document(spark):
    """A chain of 300 elements and 200,000 siblings in one document: work grows with the nodes, not with their pairs."""
    page = "<p>" * 300 + "<i>x</i>" * 100_000 + "</p>" * 300
    nodes = tree.shred(spark.createDataFrame([(1, page.replace("<p>", "<q>").replace("</p>", "</q>"))], "id long, html string"), "id", "html").select("doc_id", "pre", "post", "parent", "depth", "sib_no", "kind", "name").cache()
    items = nodes.filter("name = 'i'")
    assert tree.select(items, nodes, "preceding", 1, tree.matches("i")).count() == 99_999
    assert tree.select(items, nodes, "ancestor", 300, tree.matches("q")).count() == 100_000
    assert tree.select(items, nodes, "following", 1, tree.matches("i")).count() == 99_999
