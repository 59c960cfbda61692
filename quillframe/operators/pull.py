"""Tables as parse events and as node trees, callable from SQL as table functions.

    SELECT * FROM table_events(TABLE(t) PARTITION BY (source) ORDER BY (rec_no), 'source', 'rec_no')

Both functions find the fields in the schema of the table that they are given. Each
partition is a table of its own, read record by record in its order; nothing but the
numbers of the last record is held.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, LongType, MapType, StringType, StructField, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

#: Behind every record.
LAST = 2**62


def _schema(**fields: Any) -> StructType:
    return StructType([StructField(n, t) for n, t in fields.items()])


EVENT = _schema(src=StringType(), rec_no=LongType(), fld_no=IntegerType(), ev_no=IntegerType(), event=StringType(), arg=StringType())
TREE = _schema(
    doc_id=LongType(), pre=IntegerType(), post=IntegerType(), parent=IntegerType(), depth=IntegerType(), sib_no=IntegerType(), kind=StringType(), name=StringType(),
    attrs=MapType(StringType(), StringType()), text=StringType(), path=StringType(), pointer=StringType(), lang=StringType(),
)


@dataclass
class Fields(AnalyzeResult):
    names: list[str] = field(default_factory=list)
    source: str = ""
    order: str = ""


def _fields(schema: StructType, table: AnalyzeArgument, source: AnalyzeArgument, order: AnalyzeArgument) -> Fields:
    if not table.isTable:
        raise ValueError("the first argument is a TABLE(...)")
    names = table.dataType.names
    for given in (source, order):
        if not given.isConstantExpression or given.value not in names:
            raise ValueError(f"source and order name columns of the table, not {given.value!r}")
    return Fields(schema, names=[n for n in names if n not in (source.value, order.value)], source=source.value, order=order.value)


@udtf
class TableEvents:
    """(src, rec_no, fld_no, ev_no, event, arg): Start and End of the table, its records and fields, Text of fields, Init and Fin around all."""

    def __init__(self, fields: Fields):
        self.fields, self.src, self.begun = fields, None, False

    @staticmethod
    def analyze(table: AnalyzeArgument, source: AnalyzeArgument, order: AnalyzeArgument) -> Fields:
        return _fields(EVENT, table, source, order)

    def eval(self, row: Row, source: str, order: str) -> Iterator[tuple]:
        src, rec = row[self.fields.source], row[self.fields.order]
        src = None if src is None else str(src)
        if not self.begun:
            self.src, self.begun = src, True
            yield src, 0, 0, 0, "Init", ""
            yield src, 0, 0, 1, "Start", "table"
        yield src, rec, 0, 0, "Start", "tr"
        for k, name in enumerate(self.fields.names, 1):
            value = row[name]
            yield src, rec, k, 0, "Start", "td"
            yield src, rec, k, 1, "Text", "" if value is None else str(value)
            yield src, rec, k, 2, "End", "td"
        yield src, rec, len(self.fields.names) + 1, 0, "End", "tr"

    def terminate(self) -> Iterator[tuple]:
        if self.begun:
            yield self.src, LAST, 0, 0, "End", "table"
            yield self.src, LAST, 0, 1, "Fin", ""


@udtf
class TableNodes:
    """A node table of each partition: a table element, a tr for each record, a td for each field with its name as class, and its text; missing values have none."""

    def __init__(self, fields: Fields):
        self.fields, self.doc, self.begun, self.pre, self.post, self.records = fields, None, False, 1, 0, 0

    @staticmethod
    def analyze(table: AnalyzeArgument, source: AnalyzeArgument, order: AnalyzeArgument) -> Fields:
        return _fields(TREE, table, source, order)

    def eval(self, row: Row, source: str, order: str) -> Iterator[tuple]:
        self.doc, self.begun = row[self.fields.source], True
        self.records += 1
        tr, pointer = self.pre, f"1/{self.records}"
        self.pre += 1
        for k, name in enumerate(self.fields.names, 1):
            td, value = self.pre, row[name]
            self.pre += 1
            if value is not None:
                yield self.doc, self.pre, self.post, td, 4, 1, "text", "#text", {}, str(value), "table/tr/td/#text", f"{pointer}/{k}/1", None
                self.pre += 1
                self.post += 1
            yield self.doc, td, self.post, tr, 3, k, "element", "td", {"class": name}, None, "table/tr/td", f"{pointer}/{k}", None
            self.post += 1
        yield self.doc, tr, self.post, 0, 2, self.records, "element", "tr", {}, None, "table/tr", pointer, None
        self.post += 1

    def terminate(self) -> Iterator[tuple]:
        if self.begun:
            yield self.doc, 0, self.post, None, 1, 1, "element", "table", {}, None, "table", "1", None


def register(spark: SparkSession) -> None:
    """Makes ``table_events`` and ``table_nodes`` known to SQL."""
    spark.udtf.register("table_events", TableEvents)
    spark.udtf.register("table_nodes", TableNodes)
