"""Element properties, entity definitions and their expansion, namespaces and duplicate identifiers."""

from __future__ import annotations

import html
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions.udfs import _each

PROPERTIES = ("display", "subs", "content", "description", "pre_space", "post_space")


def element_properties(nodes: DataFrame, properties: DataFrame, most: int = 100_000) -> DataFrame:
    """Joins the property table (name, display, subs, content, ...) to elements by name; broadcast up to ``most`` counted rows."""
    small = properties.limit(most + 1).count() <= most
    return nodes.join(F.broadcast(properties) if small else properties, "name", "left")


def declared_elements(dtd: str) -> list[tuple[str, str]]:
    """(name, content model) of the element declarations of a document type."""
    return [(n, " ".join(m.split())) for n, m in re.findall(r"<!ELEMENT\s+([^\s>]+)\s+([^>]+?)\s*>", dtd)]


def declared_attributes(dtd: str) -> list[tuple[str, str, str, str]]:
    """(element, attribute, declared type, default) of the attribute lists of a document type."""
    out = []
    for element, body in re.findall(r"<!ATTLIST\s+([^\s>]+)\s+((?:[^>\"']|\"[^\"]*\"|'[^']*')+)>", dtd):
        for name, kind, default in re.findall(r"([^\s\"']+)\s+(\([^)]*\)|[A-Z]+)\s+(#FIXED\s+(?:\"[^\"]*\"|'[^']*')|#[A-Z]+|\"[^\"]*\"|'[^']*')", body):
            out.append((element, name, kind, default))
    return out


def is_kind(properties: DataFrame, name: str, kind: str) -> Column:
    """Whether an element's display categories hold the kind."""
    return F.array_contains(F.split(F.col("display"), r"\s+"), kind)


class Entities:
    """General entity definitions, flattened on the driver; a definition that leads back to itself is refused."""

    def __init__(self, definitions: dict[str, str] | None = None, default: str | None = None, depth: int = 16):
        self.definitions, self.default, self.depth = dict(definitions or {}), default, depth

    @classmethod
    def of_dtd(cls, dtd: str, default: str | None = None) -> Entities:
        return cls({n: v[1:-1] for n, v in re.findall(r"<!ENTITY\s+([^\s%>]+)\s+(\"[^\"]*\"|'[^']*')\s*>", dtd)}, default)

    def define(self, name: str, value: str) -> None:
        self.definitions.setdefault(name, value)  # the first definition binds

    def flat(self, name: str, seen: tuple[str, ...] = ()) -> str:
        if name in seen or len(seen) > self.depth:
            raise ValueError(f"entity {name!r} leads back to itself")
        value = self.definitions[name]
        return re.sub(r"&([A-Za-z_:][\w.:-]*);", lambda m: self.flat(m[1], (*seen, name)) if m[1] in self.definitions else m[0], value)

    def expanded(self, x: Column) -> Column:
        """Defined names first, then numeric references and the HTML names; unknown ones become the default, or stay."""
        table = {n: self.flat(n) for n in self.definitions}
        default = self.default

        def one(m: re.Match) -> str:
            name = m[1]
            if name in table:
                return table[name]
            known = html.unescape(m[0])
            return known if known != m[0] else m[0] if default is None else default

        return _each(lambda v: re.sub(r"&(#\d+|#[xX][0-9A-Fa-f]+|[A-Za-z_:][\w.:-]*);", one, v))(x)


def duplicate_identifiers(nodes: DataFrame, attribute: str = "id") -> DataFrame:
    """(doc_id, id, n) of identifiers that stand more than once in a document."""
    value = F.element_at("attrs", F.lit(attribute))
    return nodes.filter(value.isNotNull()).groupBy("doc_id", value.alias("id")).agg(F.count("*").alias("n")).filter("n > 1")


def namespaces(nodes: DataFrame) -> DataFrame:
    """(doc_id, pre, prefix, uri) of the namespace declarations on elements."""
    rows = nodes.filter("kind = 'element'").select("doc_id", "pre", F.explode("attrs").alias("name", "uri"))
    return rows.filter("name = 'xmlns' or name like 'xmlns:%'").select("doc_id", "pre", F.regexp_replace("name", "^xmlns:?", "").alias("prefix"), "uri")
