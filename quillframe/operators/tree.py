"""XML and HTML trees as node tables, and the tree operators as joins and windows over them.

``shred`` turns each document into rows (doc_id, pre, post, parent, depth, sib_no, kind,
name, attrs, text, path, pointer). All structure lies in the numbers: x is a descendant
of y if y.pre < x.pre and x.post < y.post in one document. Documents are independent, so
every join and window is keyed by doc_id and parallel over documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.operators import sweep

NODE = (
    "doc_id long, pre int, post int, parent int, depth int, sib_no int, kind string, name string, "
    "attrs map<string,string>, text string, path string, pointer string, lang string"
)
#: Elements that have no end tag (fixed values).
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
#: Stands for an ampersand that the parser shall pass over: a surrogate on its own, which no text of a table can hold.
_AMPERSAND = "\udc26"


class _Shredder(HTMLParser):
    """One document's nodes in document order. Unclosed elements end with their parents; stray end tags are passed over."""

    def __init__(self, doc_id, names_case: bool = False):
        super().__init__(convert_charrefs=True)
        self.doc_id, self.rows, self.open, self.post = doc_id, [], [], 0
        self.children = [0]

    def _add(self, kind: str, name: str, attrs: dict, text: str | None) -> dict:
        parent = self.open[-1] if self.open else None
        self.children[-1] += 1
        path = (parent["path"] + "/" if parent else "") + name
        pointer = (parent["pointer"] + "/" if parent else "") + str(self.children[-1])
        lang = attrs.get("lang") or attrs.get("xml:lang") or (parent["lang"] if parent else None)
        row = {
            "doc_id": self.doc_id, "pre": len(self.rows), "post": -1, "parent": parent["pre"] if parent else None, "depth": len(self.open) + 1,
            "sib_no": self.children[-1], "kind": kind, "name": name, "attrs": attrs, "text": text, "path": path, "pointer": pointer, "lang": lang,
        }
        self.rows.append(row)
        return row

    def _close(self) -> None:
        self.open.pop()["post"] = self.post
        self.children.pop()
        self.post += 1

    def _leaf(self, kind: str, name: str, text: str | None, attrs: dict | None = None) -> None:
        self._add(kind, name, attrs or {}, text)["post"] = self.post
        self.post += 1

    def handle_starttag(self, tag, attrs):
        found = {k: v if v is not None else "" for k, v in attrs}
        if tag in VOID:
            self._leaf("element", tag, None, found)
        else:
            self.open.append(self._add("element", tag, found, None))
            self.children.append(0)

    def handle_startendtag(self, tag, attrs):
        self._leaf("element", tag, None, {k: v if v is not None else "" for k, v in attrs})

    def handle_endtag(self, tag):
        if any(n["name"] == tag for n in self.open):
            while self.open[-1]["name"] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        last = self.rows[-1] if self.rows else None
        if last and last["kind"] == "text" and last["parent"] == (self.open[-1]["pre"] if self.open else None):
            last["text"] += data
        else:
            self._leaf("text", "#text", data)

    def handle_comment(self, data):
        self._leaf("comment", "#comment", data)

    def handle_pi(self, data):
        self._leaf("pi", "#pi", data)

    def handle_decl(self, decl):
        self._leaf("doctype", "#doctype", decl)

    def unknown_decl(self, data):
        self._leaf("cdata", "#text", data.removeprefix("CDATA["))

    def nodes(self, text: str, references: bool = True) -> list[dict]:
        self.feed(text if references else text.replace("&", _AMPERSAND))
        self.close()
        while self.open:
            self._close()
        if not references and "&" in text:
            put_back = lambda v: v and v.replace(_AMPERSAND, "&")
            for row in self.rows:
                row |= {k: put_back(row[k]) for k in ("name", "text", "path", "lang")}
                row["attrs"] = {put_back(k): put_back(v) for k, v in row["attrs"].items()}
        return self.rows


def shred(df: DataFrame, doc_id: str, markup: str, references: bool = True) -> DataFrame:
    """Node table of every document; null markup gives no nodes. Without ``references``, entities and numbers stay in texts and attributes as they are written."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[dict] = []
            for key, text in zip(batch["doc_id"], batch["markup"], strict=True):
                if isinstance(text, str):
                    rows += _Shredder(key).nodes(text, references)
                if len(rows) > 50_000:
                    yield _frame(rows)
                    rows = []
            if rows:
                yield _frame(rows)

    return df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(markup).alias("markup")).mapInPandas(run, NODE)


def _frame(rows: list[dict]) -> pd.DataFrame:
    out = pd.DataFrame(rows)
    out["parent"] = out["parent"].astype("Int32")
    return out


def matches(name: str = "*", attribute: str | None = None, value: str | None = None, prefix: str = "") -> Column:
    """Node test: a name, ``*`` for any element or '' for any node; an attribute that is there, or equals a value."""
    c = lambda n: F.col(prefix + n)
    ok = F.lit(True) if name == "" else (c("kind") == "element") if name == "*" else (c("name") == name)
    if attribute is not None:
        got = F.element_at(c("attrs"), F.lit(attribute))
        ok = ok & (got.isNotNull() if value is None else F.coalesce(got == value, F.lit(False)))
    return ok


#: Directions in which nodes are looked for.
AXES = ("ancestor", "child", "descendant", "following", "following-sibling", "parent", "preceding", "preceding-sibling")


def select(context: DataFrame, nodes: DataFrame, axis: str, n: int = 1, test: Column | None = None) -> DataFrame:
    """The n-th node on the axis that passes the test, for each context node: (from_pre, and the node). Nearest first.

    One sweep of each document finds the pairs; the nodes are fetched by their numbers.
    """
    if axis not in AXES or n < 1:
        raise ValueError(f"no axis {axis!r}, or none of its nodes is number {n}")
    test = F.lit(True) if test is None else test
    if axis == "parent":
        found = context.filter("parent is not null").select("doc_id", F.col("pre").alias("from_pre"), F.col("parent").alias("pre"))
        return found.join(nodes.filter(test), ["doc_id", "pre"]).select("from_pre", *nodes.columns) if n == 1 else nodes.limit(0).select(F.col("pre").alias("from_pre"), "*")
    asked = context.select("doc_id", "pre").distinct().withColumn("_asked", F.lit(True))
    # context nodes need not be among the nodes that are looked at
    rows = nodes.select("doc_id", "pre", "post", "depth", "parent", F.coalesce(test, F.lit(False)).alias("_match"))
    rows = rows.unionByName(context.select("doc_id", "pre", "post", "depth", "parent", F.lit(False).alias("_match")))
    rows = rows.groupBy("doc_id", "pre").agg(F.max("post").alias("post"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.max("_match").alias("_match"))
    rows = rows.join(asked, ["doc_id", "pre"], "left").withColumn("_context", F.coalesce("_asked", F.lit(False)))
    pairs = sweep.swept(rows, list(sweep.Axis.COLUMNS), lambda doc: sweep.Axis(doc, axis, n), sweep.Axis.SCHEMA)
    return pairs.join(nodes, ["doc_id", "pre"]).select("from_pre", *nodes.columns)


def steps(nodes: DataFrame) -> DataFrame:
    """Adds the neighbours of each node: previous and next in document order, and among siblings."""
    doc, sib = W.partitionBy("doc_id").orderBy("pre"), W.partitionBy("doc_id", "parent").orderBy("sib_no")
    return nodes.withColumns(
        {
            "previous": F.lag("pre").over(doc),
            "next": F.lead("pre").over(doc),
            "left_sibling": F.lag("pre").over(sib),
            "right_sibling": F.lead("pre").over(sib),
        }
    )


def branches(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, left_leaf, right_leaf): the nodes at the ends of each element's subtree, of whole trees: their numbers follow from the element's."""
    ends = nodes.filter("kind = 'element' and post + depth - 1 > pre").select("doc_id", "pre", (F.col("pre") - F.col("depth") + 1).alias("_first"), (F.col("post") + F.col("depth") - 1).alias("right_leaf"))
    firsts = nodes.select("doc_id", F.col("post").alias("_first"), F.col("pre").alias("left_leaf"))
    return ends.join(firsts, ["doc_id", "_first"]).select("doc_id", "pre", "left_leaf", "right_leaf")


def pointer_array(pointer: Column) -> Column:
    """A child-sequence pointer as an array, which compares in document order."""
    return F.transform(F.split(pointer, "/"), lambda p: p.cast("int"))


def resolve(nodes: DataFrame, pointer: str) -> DataFrame:
    return nodes.filter(F.col("pointer") == pointer)


def within(nodes: DataFrame, name: str) -> DataFrame:
    """Nodes inside (not at) an element of the name, by their paths."""
    return nodes.filter(F.array_contains(F.slice(F.split("path", "/"), 1, F.col("depth") - 1), name))


def inherited(nodes: DataFrame, attribute: str, alias: str = "inherited") -> DataFrame:
    """Adds the attribute of the nearest ancestor-or-self that has it, by one sweep of each document."""
    rows = nodes.withColumn("_value", F.try_element_at("attrs", F.lit(attribute)))
    found = sweep.swept(rows, list(sweep.Inherited.COLUMNS), sweep.Inherited, f"doc_id long, pre int, {alias} string")
    return nodes.join(found, ["doc_id", "pre"], "left")


def without_blank_texts(nodes: DataFrame) -> DataFrame:
    return nodes.filter(~((F.col("kind") == "text") & F.col("text").rlike(r"^\s*$")))


def normalized_texts(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("text", F.when(F.col("kind") == "text", F.trim(F.regexp_replace("text", r"\s+", " "))).otherwise(F.col("text")))


def with_references(text: Column, names: dict[str, str]) -> Column:
    """The named references, each up to its semicolon, by what they stand for; what they give is not read again. Others stay as they are."""
    for name, value in sorted(names.items(), key=lambda item: item[0] == "amp"):  # last, so that no reference comes of another
        text = F.replace(text, F.lit(f"&{name};"), F.lit(value))
    return text


def without_elements(nodes: DataFrame, name: str) -> DataFrame:
    """Drops elements of the name with all that is in them."""
    return nodes.filter(~F.array_contains(F.split("path", "/"), name))


def untagged(nodes: DataFrame, name: str) -> DataFrame:
    """Drops elements of the name but keeps what is in them, at the place of the element; all numbers and paths follow."""
    rows = nodes.withColumn("_gone", (F.col("name") == name) & (F.col("kind") == "element"))
    places = sweep.swept(rows, list(sweep.Kept.COLUMNS), sweep.Kept, sweep.Kept.SCHEMA)
    return renumbered(nodes.join(places, ["doc_id", "pre"]))


def contiguous_groups(df: DataFrame, by: list[str], order: str, key: Column, name: str = "group_no") -> DataFrame:
    """Numbers runs of neighbours with one key (gaps and islands)."""
    w = W.partitionBy(*by).orderBy(order)
    change = (~F.coalesce(key.eqNullSafe(F.lag(key).over(w)), F.lit(False))).cast("int")
    return df.withColumn("_new", change).withColumn(name, F.sum("_new").over(w)).drop("_new")


def _placed(nodes: DataFrame) -> DataFrame:
    """Nodes with _at, their pointers as arrays of numbers between which others fit."""
    return nodes.withColumn("_at", F.transform(F.split("pointer", "/"), lambda p: p.cast("double")))


def renumbered(rows: DataFrame) -> DataFrame:
    """A node table from rows with kind, name, attrs, text and _at, the place in the document; all numbers, paths and languages are made anew.

    One sweep in order of the places; nodes stand in those whose place begins theirs.
    """
    return sweep.swept(rows, list(sweep.Numbers.COLUMNS), sweep.Numbers, NODE, ["_at"])


def inserted_sibling(nodes: DataFrame, target: Column, name: str, after: bool = True) -> DataFrame:
    """Adds an empty element before or after each target node."""
    rows = _placed(nodes)
    last = F.size("_at")
    beside = F.concat(F.slice("_at", F.lit(1), last - 1), F.array(F.element_at("_at", last) + F.lit(0.5 if after else -0.5)))
    new = rows.filter(target).select("doc_id", F.lit("element").alias("kind"), F.lit(name).alias("name"), F.create_map().cast("map<string,string>").alias("attrs"), F.lit(None).cast("string").alias("text"), beside.alias("_at"))
    return renumbered(rows.select(*new.columns).unionByName(new))


def wrapped_in_parent(nodes: DataFrame, target: Column, name: str) -> DataFrame:
    """Puts an element of the name around each target node; targets may lie in one another."""
    rows = _placed(nodes)
    targets = rows.filter(target).select(F.col("doc_id").alias("_doc"), F.col("_at").alias("_top"), F.size("_at").alias("_deep"))
    ups = rows.select("doc_id", "pre", F.explode(F.transform(F.sequence(F.lit(1), F.size("_at")), lambda k: F.slice("_at", F.lit(1), k))).alias("_up"))
    deep = ups.join(targets, (F.col("doc_id") == F.col("_doc")) & (F.col("_up") == F.col("_top"))).groupBy("doc_id", "pre").agg(F.collect_list("_deep").alias("_cuts"))
    rows = rows.join(deep, ["doc_id", "pre"], "left")
    # a step down more behind every target on the way
    steps = F.transform("_at", lambda x, i: F.when(F.array_contains("_cuts", i + 1), F.array(x, F.lit(1.0))).otherwise(F.array(x)))
    rows = rows.withColumns({"_own": F.coalesce(F.array_contains("_cuts", F.size("_at")), F.lit(False)), "_at": F.when(F.col("_cuts").isNull(), F.col("_at")).otherwise(F.flatten(steps))})
    wrapper = rows.filter("_own").select("doc_id", F.lit("element").alias("kind"), F.lit(name).alias("name"), F.create_map().cast("map<string,string>").alias("attrs"), F.lit(None).cast("string").alias("text"), F.slice("_at", F.lit(1), F.size("_at") - 1).alias("_at"))
    return renumbered(rows.select(*wrapper.columns).unionByName(wrapper))


def merged_sibling_texts(nodes: DataFrame) -> DataFrame:
    """Joins text nodes that are neighbours among their siblings."""
    runs = contiguous_groups(nodes, ["doc_id", "parent"], "sib_no", F.col("kind") == "text", "run")
    texts = runs.filter("kind = 'text'").groupBy("doc_id", "parent", "run").agg(
        F.min("pre").alias("pre"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda s: s["text"]), "").alias("joined")
    )
    rows = runs.join(texts.select("doc_id", "pre", "joined"), ["doc_id", "pre"], "left")
    rows = rows.filter("kind <> 'text' or joined is not null").withColumn("text", F.coalesce("joined", "text"))
    return renumbered(_placed(rows))


def promoted_children(nodes: DataFrame, name: str) -> DataFrame:
    return untagged(nodes, name)


def collected_text(nodes: DataFrame, delimiter: str = "") -> DataFrame:
    """(doc_id, content): the texts of each document in order, without script and style."""
    texts = without_elements(without_elements(nodes.filter("kind in ('text', 'cdata')"), "script"), "style")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("pre", "text"))), lambda s: s["text"])
    return texts.groupBy("doc_id").agg(F.array_join(parts, delimiter).alias("content"))


def attribute_index(nodes: DataFrame, attribute: str) -> DataFrame:
    """(doc_id, value, pre): the last element with each value of the attribute."""
    value = F.element_at("attrs", F.lit(attribute))
    return nodes.filter(value.isNotNull()).groupBy("doc_id", value.alias("value")).agg(F.max("pre").alias("pre"))


def serialized(nodes: DataFrame) -> DataFrame:
    """(doc_id, markup): the tree written again, from start, end and text events in order."""
    from quillframe.functions.scalars import escape_xml_attribute, escape_xml_content

    pairs = F.transform(F.array_sort(F.map_entries("attrs")), lambda e: F.concat(F.lit(" "), e["key"], F.lit('="'), escape_xml_attribute(e["value"]), F.lit('"')))
    start = F.concat(F.lit("<"), F.col("name"), F.array_join(pairs, ""), F.lit(">"))
    content = (
        F.when(F.col("kind") == "element", start)
        .when(F.col("kind") == "comment", F.concat(F.lit("<!--"), "text", F.lit("-->")))
        .when(F.col("kind") == "pi", F.concat(F.lit("<?"), "text", F.lit(">")))
        .when(F.col("kind") == "doctype", F.concat(F.lit("<!"), "text", F.lit(">")))
        .when(F.col("path").rlike("(^|/)(script|style)/#text$"), F.col("text"))  # not markup: escapes would change the program
        .otherwise(escape_xml_content(F.col("text")))
    )
    # an end tag comes after all inside it: sort by pointer, with the end behind every child
    place = pointer_array(F.col("pointer"))
    opens = nodes.select("doc_id", place.alias("at"), content.alias("piece"))
    ends = nodes.filter("kind = 'element'").select("doc_id", F.concat(place, F.array(F.lit(2**31 - 1))).alias("at"), F.concat(F.lit("</"), "name", F.lit(">")).alias("piece"))
    pieces = F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda s: s["piece"])
    return opens.unionByName(ends).groupBy("doc_id").agg(F.array_join(pieces, "").alias("markup"))


def visited(nodes: DataFrame, order: str = "pre", name_pattern: str | None = None) -> DataFrame:
    """Nodes in visiting order: ``pre`` or ``post``; elements whose name matches, if a pattern is given."""
    picked = nodes if name_pattern is None else nodes.filter((F.col("kind") == "element") & F.col("name").rlike(name_pattern))
    return picked.orderBy("doc_id", order)


def admissible(edges: DataFrame, models: DataFrame) -> DataFrame:
    """(parent, child, n) of observed nestings that the content models (parent, child) do not admit."""
    return edges.groupBy("parent", "child").agg(F.count("*").alias("n")).join(models, ["parent", "child"], "left_anti")


def nestings(nodes: DataFrame) -> DataFrame:
    """(doc_id, parent, child) names of every element in an element, from the path alone."""
    return nodes.filter("kind = 'element' and depth > 1").select("doc_id", F.element_at(F.split("path", "/"), -2).alias("parent"), F.col("name").alias("child"))
