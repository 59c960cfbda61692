"""Tree operators on one small document, entities, printable forms, and the converter."""

import pytest
from pyspark.sql import functions as F

from quillframe.functions import udfs
from quillframe.operators import markup, tree

PAGE = '<html lang="en"><body><ul id="u"><li>a<br>b</li><li lang="fr">c &amp; d</li></ul><p>  </p><!-- x --></body></html>'


@pytest.fixture(scope="module")
def nodes(spark):
    return tree.shred(spark.createDataFrame([(1, PAGE), (2, None), (3, "<p>x<p>y")], "id long, html string"), "id", "html").cache()


def names(df):
    return [tuple(r) for r in df.collect()]


def test_numbers_and_paths(nodes):
    one = {r["pointer"]: r for r in nodes.filter("doc_id = 1").collect()}
    assert one["1/1/1/2"]["path"] == "html/body/ul/li" and one["1/1/1/2"]["lang"] == "fr" and one["1/1/1/1"]["lang"] == "en"
    assert (one["1/1/1"]["depth"], one["1/1/1"]["sib_no"], one["1/1/3"]["kind"]) == (3, 1, "comment")
    assert sorted(r["pre"] for r in one.values()) == sorted(r["post"] for r in one.values()) == list(range(len(one)))


def test_axes(nodes):
    page = nodes.filter("doc_id = 1")
    items = page.filter(tree.matches("li"))
    assert names(tree.select(items, page, "ancestor", 2).select("name")) == [("body",), ("body",)]
    assert names(tree.select(items, page, "following-sibling", 1, tree.matches("li")).select("pointer")) == [("1/1/1/2",)]
    assert names(tree.select(page.filter("name = 'ul'"), page, "descendant", 1, tree.matches("", None)).select("name")) == [("li",)]
    assert names(page.filter(tree.matches("*", "lang", "fr")).select("name")) == [("li",)]
    assert names(tree.resolve(page, "1/1/2").select("name")) == [("p",)]


def test_text_and_edits(nodes):
    page = nodes.filter("doc_id = 1")
    assert names(tree.collected_text(tree.without_blank_texts(page), "|")) == [(1, "a|b|c & d")]
    assert names(tree.serialized(page).select("markup")) == [(PAGE.replace("<br>", "<br></br>"),)]
    flat = tree.untagged(page, "ul")
    assert {(r["name"], r["depth"], r["path"]) for r in flat.filter("name = 'li'").collect()} == {("li", 3, "html/body/li")}
    assert tree.without_elements(page, "ul").filter("kind = 'text'").count() == 1
    wrapped = tree.wrapped_in_parent(page, F.col("name") == "ul", "div")
    assert names(wrapped.filter("name = 'ul'").select("path", "depth")) == [("html/body/div/ul", 4)]
    added = tree.inserted_sibling(page, F.col("name") == "ul", "hr")
    assert names(added.filter("parent = 1").orderBy("sib_no").select("name")) == [("ul",), ("hr",), ("p",), ("#comment",)]
    assert names(tree.attribute_index(page, "id").select("value")) == [("u",)]
    got = tree.inherited(page, "lang", "l").filter("name = 'br'").select("l")
    assert names(got) == [("en",)]


def test_entities(spark):
    e = markup.Entities.of_dtd('<!ENTITY co "Acme &amp; &t;"><!ENTITY t "Co">', default="?")
    df = spark.createDataFrame([("&co; &#65;&eacute; &zz;",)], "v string")
    assert df.select(e.expanded(F.col("v"))).first()[0] == "Acme &amp; Co Aé ?"
    e.define("a", "&b;")
    e.define("b", "&a;")
    with pytest.raises(ValueError):
        e.flat("a")
    assert markup.declared_elements("<!ELEMENT p (#PCDATA | b)*>") == [("p", "(#PCDATA | b)*")]
    assert markup.declared_attributes('<!ATTLIST p id ID #REQUIRED k (a|b) "a">') == [("p", "id", "ID", "#REQUIRED"), ("p", "k", "(a|b)", '"a"')]


def test_printable(spark):
    df = spark.createDataFrame([("a\tÿ \x01",)], "v string")
    shown = {m: df.select(udfs.printable(F.col("v"), m)).first()[0] for m in ("C", "XML", "LATIN1", "SYM")}
    assert shown == {"C": "a\\tÿ \\x01", "XML": "a&#x9;ÿ &#x1;", "LATIN1": "a\\t\\xff \\x01", "SYM": "a␉ÿ ␁"}


def test_converter(spark, tmp_path):
    from quillframe.__main__ import main

    (tmp_path / "in.csv").write_text("k;v\nx;1\ny;2\n")
    assert main([str(tmp_path / "in.csv"), str(tmp_path / "out"), "--from", "csv", "--to", "xsv", "--set", "delim=;"]) == 0
    parts = sorted(p for p in (tmp_path / "out").iterdir() if p.name.startswith("part"))
    text = "".join(p.read_text() for p in parts)
    assert '<Rec k="x" v="1" />\n<Rec k="y" v="2" />' in text and text.startswith("<Xsv>") and text.rstrip().endswith("</Xsv>")


def test_edits_keep_a_tree(spark):
    """Inserted and wrapped nodes serialize where they belong, in every document, with numbers of their own."""
    page = "<a><b>x</b><c lang='fr'><b>y</b></c></a>"
    nodes = tree.shred(spark.createDataFrame([(1, page), (2, "<b>z</b>")], "id long, html string"), "id", "html")
    plain = {1: "<a><b>x</b><c lang=\"fr\"><b>y</b></c></a>", 2: "<b>z</b>"}
    shown = lambda df: {r["doc_id"]: r["markup"] for r in tree.serialized(df).collect()}
    assert shown(tree.inserted_sibling(nodes, F.col("name") == "b", "z")) == {1: '<a><b>x</b><z></z><c lang="fr"><b>y</b><z></z></c></a>', 2: "<b>z</b><z></z>"}
    assert shown(tree.inserted_sibling(nodes, F.col("name") == "c", "z", after=False)) == {1: '<a><b>x</b><z></z><c lang="fr"><b>y</b></c></a>', 2: plain[2]}
    wrapped = tree.wrapped_in_parent(nodes, F.col("name").isin("b", "c"), "w")
    assert shown(wrapped) == {1: '<a><w><b>x</b></w><w><c lang="fr"><w><b>y</b></w></c></w></a>', 2: "<w><b>z</b></w>"}
    rows = wrapped.filter("doc_id = 1").collect()
    assert sorted(r["pre"] for r in rows) == sorted(r["post"] for r in rows) == list(range(len(rows)))
    by = {r["pointer"]: r for r in rows}
    assert (by["1/2/1/1/1"]["path"], by["1/2/1/1/1"]["lang"], by["1/2/1/1/1"]["depth"]) == ("a/w/c/w/b", "fr", 5)
    assert by["1/2/1/1"]["parent"] == by["1/2/1"]["pre"] and by["1"]["parent"] is None
    again = tree.renumbered(tree._placed(nodes))
    key = ["doc_id", "pre", "post", "parent", "depth", "sib_no", "path", "pointer", "lang"]
    assert sorted(map(str, again.select(*key).collect())) == sorted(map(str, nodes.select(*key).collect()))


def test_programs_are_not_escaped(spark):
    page = "<p>1 &lt; 2</p><script>if (a < b && c) x();</script><style>p > b {}</style>"
    nodes = tree.shred(spark.createDataFrame([(1, page)], "id long, html string"), "id", "html")
    assert names(tree.serialized(nodes).select("markup")) == [(page,)]
