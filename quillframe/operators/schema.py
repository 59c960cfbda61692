"""Table schemas: field definitions, naming, order, defaults, sub-fields, layouts, post-processing and event views.

A ``TableSchema`` lives on the driver and turns into projections; it never touches rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions import scalars


@dataclass
class FieldDef:
    name: str
    start: int = 0
    width: int = 0
    align: str = "L"
    truncate: bool = False
    default: str | None = None
    nil_out: str = ""
    datatype: str = "string"
    splitter: str | None = None
    joiner: str | None = None
    callback: Callable[[Column], Column] | None = None

    def metadata(self) -> dict:
        return {k: v for k, v in vars(self).items() if k not in ("name", "callback") and v not in (None, 0, "", False)}


#: Which header names each syntax allows; other syntaxes take the first.
NAME_RULES = {
    "default": r"^[A-Za-z]\w*$",
    "json": r"^[A-Za-z_][-\w.:]*$",
    "xml": r"^[A-Za-z_][-\w.:]*$",
    "xsv": r"^[A-Za-z_][-\w.:]*$",
    "sexp": r"^[A-Za-z_][-\w.:]*$",
    "mime": r"^[!-9;-~]+$",
}


def is_ok_field_name(name: str, syntax: str = "default") -> bool:
    return bool(re.match(NAME_RULES.get(syntax, NAME_RULES["default"]), name))


def clean_field_name(name: str) -> str:
    name = re.sub(r"\W", "_", name.strip())
    return name if re.match(r"[^\W\d_]", name) else "A_" + name


def clean_name_column(name: Column) -> Column:
    name = F.regexp_replace(F.trim(name), r"[^\p{L}\p{M}\p{N}_]", "_")
    return F.when(name.rlike(r"^\p{L}"), name).otherwise(F.concat(F.lit("A_"), name))


def header_names(cells: list[str], syntax: str = "default") -> list[str]:
    """Column names of a header record: blank names get F_i, bad ones are cleaned, repeated ones numbered."""
    if len(cells) < 2:
        raise ValueError("a header needs more than one field")
    out: list[str] = []
    for k, cell in enumerate(cells, 1):
        name = cell.strip() or f"F_{k}"
        name = name if is_ok_field_name(name, syntax) else clean_field_name(name)
        out.append(name if name not in out else f"{name}_{k}")
    return out


@dataclass
class TableSchema:
    fields: list[FieldDef] = field(default_factory=list)

    @classmethod
    def of(cls, df: DataFrame) -> TableSchema:
        return cls([FieldDef(f.name, **{k: v for k, v in f.metadata.items() if k in FieldDef.__dataclass_fields__}) for f in df.schema.fields])

    @property
    def names(self) -> list[str]:
        return [f.name for f in self.fields]

    def __len__(self) -> int:
        return len(self.fields)

    def number(self, which: str | int) -> int:
        """1-based number of a field given by name or number."""
        if isinstance(which, int) or which.isdigit():
            return int(which)
        if which in self.names:
            return self.names.index(which) + 1
        raise KeyError(which)

    def get(self, which: str | int, create: bool = False) -> FieldDef:
        n = self.number(which)
        if create:
            self.ensure(n)
        if not 1 <= n <= len(self.fields):
            raise KeyError(which)
        return self.fields[n - 1]

    def append(self, name: str | None = None, **options) -> FieldDef:
        name = name or f"F_{len(self.fields) + 1}"
        if name in self.names:
            raise ValueError(f"field {name!r} is there already")
        self.fields.append(FieldDef(name, **options))
        return self.fields[-1]

    def ensure(self, count: int) -> None:
        while len(self.fields) < count:
            self.append()

    def rename(self, which: str | int, name: str) -> None:
        if name in self.names and self.number(name) != self.number(which):
            raise ValueError(f"field {name!r} is there already")
        self.get(which).name = name

    def rename_all(self, names: list[str | None]) -> None:
        """By position; nil entries are skipped, extra names append fields."""
        self.ensure(len(names))
        for f, name in zip(self.fields, names, strict=False):
            if name:
                f.name = name

    def move(self, which: str | int, to: int) -> None:
        f = self.fields.pop(self.number(which) - 1)
        self.fields.insert(to - 1, f)

    def order_by_position(self) -> None:
        self.fields.sort(key=lambda f: f.start)

    # fixed-column layout

    def set_positions(self, starts: list[int], last_width: int = 8) -> None:
        self.ensure(len(starts))
        for f, start, stop in zip(self.fields, starts, [*starts[1:], starts[-1] + last_width], strict=False):
            f.start, f.width = start, stop - start

    def set_position(self, which: str | int, start: int, width: int) -> None:
        for f in self.fields:
            if f is not self.get(which) and f.width and start < f.start + f.width and f.start < start + width:
                raise ValueError(f"overlaps {f.name!r}")
        self.get(which).start, self.get(which).width = start, width

    def following(self, which: str | int) -> FieldDef | None:
        after = [f for f in self.fields if f.start > self.get(which).start]
        return min(after, key=lambda f: f.start, default=None)

    def available_width(self, which: str | int) -> int | None:
        nxt = self.following(which)
        return None if nxt is None else nxt.start - self.get(which).start

    # projections

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(f.name, T.StringType(), True, f.metadata()) for f in self.fields])

    def project(self, df: DataFrame, missing: str = "") -> DataFrame:
        """Schema order; columns that df lacks get the field's default or the fill value."""
        have = set(df.columns)
        return df.select(*[F.col(f.name) if f.name in have else F.lit(missing if f.default is None else f.default).alias(f.name) for f in self.fields])

    def with_defaults(self, df: DataFrame, general: str | None = None) -> DataFrame:
        """Nil values take the field's default, and where it has none the format's."""
        def fill(f: FieldDef) -> Column:
            options = [F.lit(v) for v in (f.default, general) if v is not None]
            return F.coalesce(F.col(f.name), *options).alias(f.name) if options else F.col(f.name)

        return df.select(*[fill(f) for f in self.fields])

    def post_process(self, df: DataFrame, strip: bool = True) -> DataFrame:
        """Strip, then callback, then split into sub-fields, in that order."""
        def one(f: FieldDef) -> Column:
            x = F.col(f.name)
            x = scalars.trim(x) if strip else x
            x = f.callback(x) if f.callback else x
            return (F.split(x, f.splitter) if f.splitter else x).alias(f.name)

        return df.select(*[one(f) for f in self.fields])

    def joined(self, df: DataFrame) -> DataFrame:
        """Sub-field arrays back to text by their joiners."""
        kinds = dict(df.dtypes)
        return df.select(*[(F.array_join(f.name, f.joiner or " ") if kinds[f.name].startswith("array") else F.col(f.name)).alias(f.name) for f in self.fields])

    def aligned(self, df: DataFrame) -> DataFrame:
        return df.select(*[scalars.align(F.col(f.name), f.width, f.align, f.truncate, f.nil_out).alias(f.name) for f in self.fields])

    def copy(self) -> TableSchema:
        return TableSchema([replace(f) for f in self.fields])


def sub_fields(x: Column, splitter: str) -> Column:
    return F.split(x, splitter)


def as_map(df: DataFrame, columns: list[str] | None = None) -> Column:
    """A record as name-value map."""
    pairs: list[Column] = []
    for c in columns or df.columns:
        pairs += [F.lit(c), F.col(c).cast("string")]
    return F.create_map(*pairs)


def as_array(columns: list[str], missing: str = "") -> Column:
    """A record as array in schema order, missing values filled."""
    return F.array(*[F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns])


def without_comments(df: DataFrame, column: str = "value", mark: str = "#") -> DataFrame:
    """Drops records that are blank or start with the comment mark."""
    return df.filter(~F.col(column).startswith(mark) & ~F.col(column).rlike(r"^\s*$"))


def event_stream(df: DataFrame, order: str, columns: list[str] | None = None) -> DataFrame:
    """A table as parse events (rec_no, fld_no, ev_no, event, arg); ``order`` is the record number from 1.

    Per record Start tr, then Start td, Text, End td for each field, then End tr; the
    table's own Init, Start, End and Fin are one-row frames before and after.
    """
    columns = columns or [c for c in df.columns if c != order]
    rows = []
    event = lambda f, e, name, arg: F.struct(F.lit(f).alias("fld_no"), F.lit(e).alias("ev_no"), F.lit(name).alias("event"), arg.alias("arg"))
    rows.append(event(0, 0, "Start", F.lit("tr")))
    for k, c in enumerate(columns, 1):
        rows += [event(k, 0, "Start", F.lit("td")), event(k, 1, "Text", F.coalesce(F.col(c).cast("string"), F.lit(""))), event(k, 2, "End", F.lit("td"))]
    rows.append(event(len(columns) + 1, 0, "End", F.lit("tr")))
    body = df.select(F.col(order).cast("long").alias("rec_no"), F.explode(F.array(*rows)).alias("e")).select("rec_no", "e.*")
    spark = df.sparkSession
    edge = "rec_no long, fld_no int, ev_no int, event string, arg string"
    head = spark.createDataFrame([(0, 0, 0, "Init", ""), (0, 0, 1, "Start", "table")], edge)
    tail = spark.createDataFrame([(2**62, 0, 0, "End", "table"), (2**62, 0, 1, "Fin", "")], edge)
    return head.unionByName(body).unionByName(tail)
