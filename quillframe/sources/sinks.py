"""Writers: each syntax turns a row into a record Column, with header and trailer texts around them.

``records`` gives the text column, ``write_table`` the files: record lines are written in
parallel; header and trailer go into files that sort before and after them.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.functions import scalars, udfs
from quillframe.operators.schema import TableSchema
from quillframe.sources import committed
from quillframe.sources import options as opts

NUMBER = r"^[-+]?\d+(\.\d+)?([Ee][-+]?\d+)?$"


def _text(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit(""))


def _concat(parts: list[Column], sep: str = "") -> Column:
    return F.concat_ws(sep, *parts)


def csv_field(x: Column, o: dict[str, Any]) -> Column:
    """Quotes doubled or escaped; line breaks are escaped where there is an escape character and ``nl_in_quotes`` is off, else they stay within quotes."""
    q, e = o["quote"], o["escape"]
    special = x.contains(o["field_sep"]) | x.rlike(r"[\r\n]") | (x.contains(q) if q else F.lit(False)) | x.rlike(r"^\s|\s$")
    body = x
    if e:
        body = F.replace(body, F.lit(e), F.lit(e + e))
        body = F.replace(body, F.lit(q), F.lit(e + q)) if q else F.replace(body, F.lit(o["field_sep"]), F.lit(e + o["field_sep"]))
        body = body if o["nl_in_quotes"] else F.replace(F.replace(body, F.lit("\n"), F.lit(e + "n")), F.lit("\r"), F.lit(e + "r"))
    elif o["qdouble"]:
        body = F.replace(body, F.lit(q), F.lit(q + q))
    else:
        body = F.replace(body, F.lit(q), F.lit(""))
    return F.when(special, F.concat(F.lit(q), body, F.lit(q))).otherwise(body if e else x)


def csv_record(columns: list[str], o: dict[str, Any]) -> Column:
    return _concat([csv_field(_text(c), o) for c in columns], o["field_sep"])


def arff_field(x: Column) -> Column:
    """A value in quotes if need be, its line breaks as escapes: a record is one line."""
    body = F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    quoted = F.concat(F.lit("'"), F.replace(F.replace(body, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("'"))
    return F.when(x.isNull(), "?").when(x.rlike(r"[?,\s{}%'\"\\]") | (x == ""), quoted).otherwise(x)


def arff_record(columns: list[str], o: dict[str, Any]) -> Column:
    return _concat([arff_field(F.col(c).cast("string")) for c in columns], ",")


def columns_record(schema: TableSchema, o: dict[str, Any]) -> Column:
    """Fields at their start columns, aligned and cut to their widths."""
    parts, at = [], 0
    for f in sorted(schema.fields, key=lambda f: f.start):
        if f.start > at:
            parts.append(F.lit(" " * (f.start - at)))
        parts.append(scalars.align(F.col(f.name), f.width, f.align, True, f.nil_out))
        at = f.start + f.width
    return scalars.rtrim(F.concat(*parts))


def json_record(columns: list[str], o: dict[str, Any]) -> Column:
    """An object; numbers bare, arrays as arrays, missing values null."""
    kinds = o["_kinds"]

    def value(c: str) -> Column:
        x = F.col(c).cast("string")
        if kinds[c].startswith("array"):
            return F.coalesce(F.to_json(F.col(c)), F.lit("null"))
        text = F.concat(F.lit('"'), scalars.escape_json(F.coalesce(x, F.lit(""))), F.lit('"'))
        return F.when(x.isNull(), "null").when(x.rlike(r"^-?(0|[1-9]\d*)(\.\d+)?([Ee][-+]?\d+)?$"), x).otherwise(text)

    fields = [F.concat(F.lit(f'"{c}": '), value(c)) for c in columns]
    return F.concat(F.lit("{ "), _concat(fields, ", "), F.lit(" }"))


def quoted_printable(x: Column) -> Column:
    """Bytes that are not printable ASCII as =XX, over UTF-8."""
    import quopri

    return udfs._each(lambda v: quopri.encodestring(v.encode("utf-8"), quotetabs=False).decode("ascii").replace("=\n", ""))(x)


def mime_record(columns: list[str], o: dict[str, Any]) -> Column:
    """``name: value`` lines, folded, and a blank line; missing values are left out."""
    def one(c: str) -> Column:
        x = F.regexp_replace(F.col(c).cast("string"), r"\s*\n\s*", " ")
        x = quoted_printable(x) if o["quoted_printable"] else x
        line = F.concat(F.lit(c + ": "), x)
        folded = F.regexp_replace(F.rtrim(F.regexp_replace(F.concat(line, F.lit(" ")), rf"(.{{1,{o['line_length'] - 1}}}) ", "$1\n ")), r"\s+$", "")
        return F.when(F.length(line) > o["line_length"], folded).otherwise(line)

    return F.concat(_concat([one(c) for c in columns], "\n"), F.lit("\n"))


def _double_quoted(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.replace(x, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))


def manchester_record(columns: list[str], o: dict[str, Any]) -> Column:
    """An Individual frame; the first column names it, one without a label where it is missing."""
    shown = lambda x: F.when(x.rlike(r"['()\s,\"\\]|^_:|^[A-Za-z]+:$") | (x == ""), _double_quoted(x)).otherwise(x)
    facts = [F.concat(F.lit(f"{c} "), shown(F.col(c).cast("string"))) for c in columns[1:]]
    return F.concat(F.lit("Individual: "), F.coalesce(shown(F.col(columns[0]).cast("string")), F.lit("_:")), F.lit("\n    Facts: "), _concat(facts, ",\n        "), F.lit("\n"))


def perl_record(columns: list[str], o: dict[str, Any]) -> Column:
    def value(c: str) -> Column:
        x = F.col(c).cast("string")
        return F.when(x.isNull(), "undef").when(x.rlike(NUMBER), x).otherwise(_double_quoted(x))

    return F.concat(F.lit("  { "), _concat([F.concat(F.lit(f'"{c}"\t=> '), value(c)) for c in columns], ", "), F.lit(" },"))


def sexp_record(columns: list[str], o: dict[str, Any]) -> Column:
    def one(c: str) -> Column:
        x = F.col(c).cast("string")
        return F.concat(F.lit(f"({c} "), F.when(x.rlike(r"^\d+$"), x).otherwise(_double_quoted(x)), F.lit(")"))

    return F.concat(F.lit(f"({o['tr_tag']} "), _concat([one(c) for c in columns], " "), F.lit(")"))


def xml_record(columns: list[str], o: dict[str, Any]) -> Column:
    """A ``tr`` with a ``td`` per field, named by class; sub-fields as paragraphs; an id from a field or the record number."""
    kinds, cls = o["_kinds"], o["class_attr"] or "class"

    def content(c: str) -> Column:
        if kinds[c].startswith("array"):
            return F.array_join(F.transform(F.col(c), lambda p: F.concat(F.lit("<p>"), scalars.escape_xml_content(p), F.lit("</p>"))), "")
        body = scalars.escape_xml_content(_text(c))
        return udfs.ascii_references(body) if o["ascii_only"] else body

    cells = [F.concat(F.lit(f'<{o["td_tag"]} {cls}="{c}">'), content(c), F.lit(f"</{o['td_tag']}>")) for c in columns]
    rec_id = F.concat(F.lit(' id="'), scalars.escape_xml_attribute(_text(o["id_attr"])), F.lit('"')) if o["id_attr"] else F.lit("")
    return F.concat(F.lit(f"<{o['tr_tag']}"), rec_id, F.lit(">"), *cells, F.lit(f"</{o['tr_tag']}>"))


def xsv_record(columns: list[str], o: dict[str, Any], defaults: dict[str, str] | None = None) -> Column:
    """``<Rec a="..." />``; nil and, if asked for, default values are left out."""
    def one(c: str) -> Column:
        x = F.col(c).cast("string")
        shown = F.concat(F.lit(f' {c}="'), scalars.escape_xml_attribute(x), F.lit('"'))
        skip = x.isNull()
        if o["omit_defaults"] and defaults and c in defaults:
            skip = skip | (x == defaults[c])
        return F.when(skip, "").otherwise(shown)

    return F.concat(F.lit(f"<{o['rec_name']}"), *[one(c) for c in columns], F.lit(" />"))


def header(fmt: str, columns: list[str], o: dict[str, Any], datatypes: dict[str, str] | None = None) -> str | None:
    kinds = datatypes or {}
    if fmt == "csv":
        quote = lambda c: f'{o["quote"]}{c}{o["quote"]}' if o["field_sep"] in c or o["quote"] in c else c
        return o["field_sep"].join(map(quote, columns)) if o["header"] else None
    if fmt == "arff":
        return "\n".join([f"@RELATION {o['relation']}", "", *[f"@ATTRIBUTE {c} {kinds.get(c, 'STRING')}" for c in columns], "", "@DATA"])
    if fmt == "xsv":
        return f'<{o["xsv_name"]}>\n<{o["head_name"]} ' + " ".join(f'{c}="{kinds.get(c, "#string#")}"' for c in columns) + ">"
    return {"json": '{ "Table": [', "perl": f"my @{o['var_name']} = (", "sexp": "(SEXP", "xml": f"<{o['table_tag']}>", "manchester": "Prefix: : <http://example.org/>\n"}.get(fmt)


def trailer(fmt: str, o: dict[str, Any]) -> str | None:
    return {"json": "] }", "perl": ");", "sexp": ")", "xml": f"</{o['table_tag']}>", "xsv": f"</{o['head_name']}>\n</{o['xsv_name']}>"}.get(fmt)


def comment(fmt: str, text: str, o: dict[str, Any] | None = None) -> str | None:
    marks = {"arff": "% {}", "json": "// {}", "perl": "# {}", "sexp": "; {}", "xml": "<!-- {} -->", "xsv": "<!-- {} -->", "manchester": "# {}"}
    if fmt == "csv" and o and o["comment"]:
        return o["comment"] + " " + text
    return marks[fmt].format(text.replace("--", "- -") if fmt in ("xml", "xsv") else text) if fmt in marks else None


RECORDS: dict[str, Callable[..., Column]] = {
    "arff": arff_record, "csv": csv_record, "json": json_record, "manchester": manchester_record, "mime": mime_record,
    "perl": perl_record, "sexp": sexp_record, "xml": xml_record, "xsv": xsv_record,
}


def record(df: DataFrame, fmt: str, columns: list[str] | None = None, **options: Any) -> Column:
    """The record text of each row."""
    columns = columns or [c for c in df.columns if c not in ("src", "rec_no")]
    o = opts.resolve(**options) | {"_kinds": dict(df.dtypes)}
    if fmt == "columns":
        layout = TableSchema()
        layout.set_positions(o["positions"])
        layout.rename_all(columns)
        return columns_record(layout, o)
    return RECORDS[fmt](columns, o)


def records(df: DataFrame, fmt: str, order: str | None = None, columns: list[str] | None = None, **options: Any) -> DataFrame:
    """(part, ord, value): header (0), records (1) and trailer (2), to be sorted by part and ord. JSON records carry their commas."""
    columns = columns or [c for c in df.columns if c not in ("src", "rec_no")]
    o = opts.resolve(**options)
    place = F.col(order).cast("long") if order else F.lit(0).cast("long")
    value = record(df, fmt, columns, **options)
    rows = df.select(F.lit(1).alias("part"), place.alias("ord"), value.alias("value"))
    if fmt == "json":
        last = rows.agg(F.max("ord").alias("_last"))
        rows = rows.crossJoin(F.broadcast(last)).withColumn("value", F.when(F.col("ord") < F.col("_last"), F.concat("value", F.lit(","))).otherwise(F.col("value"))).drop("_last") if order else rows
    edges = [(p, 0, t) for p, t in ((0, header(fmt, columns, o)), (2, trailer(fmt, o))) if t is not None]
    return rows.unionByName(df.sparkSession.createDataFrame(edges, "part int, ord long, value string")) if edges else rows


def assembled(df: DataFrame, fmt: str, order: str, **options: Any) -> DataFrame:
    """One row, one text: the whole table as a document. For tables that fit one text; files go through ``write_table``."""
    parts = records(df, fmt, order, **options)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "ord", "value"))), lambda s: s["value"]), "\n")
    return parts.agg(F.concat(text, F.lit("\n")).alias("value"))


def write_table(df: DataFrame, path: str, fmt: str, order: str, **options: Any) -> None:
    """Text files whose names sort in record order; header and trailer at the ends, records range-partitioned between."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    records(df, fmt, order, **options).repartitionByRange(n, "part", "ord").sortWithinPartitions("part", "ord").select("value").write.text(path)


def write_document(df: DataFrame, path: str, fmt: str, order: str, overwrite: bool = False, **options: Any) -> None:
    """One document of many parts, committed whole: header, records in order (numbers, each once), trailer; a failed write leaves nothing.

    ``read_table`` takes it as one document with ``one_document=True``. Records are range-partitioned; the driver sees
    the greatest order, behind which no separator stands.
    """
    columns = [c for c in df.columns if c not in ("src", "rec_no")]
    o = opts.resolve(**options)
    rows = df.select(F.col(order).cast("long").alias("ord"), record(df, fmt, columns, **options).alias("value"))
    last = df.agg(F.max(F.col(order).cast("long"))).first()[0]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    given = {"header": header(fmt, columns, o) or "", "trailer": trailer(fmt, o) or "", "separator": "," if fmt == "json" else "", "suffix": "." + fmt, "last": last}
    writer = rows.repartitionByRange(n, "ord").sortWithinPartitions("ord").write.format(committed.register(df.sparkSession))
    for name, value in given.items():
        writer = writer.option(name, json.dumps(value))
    writer.option("path", path).mode("overwrite" if overwrite else "append").save()


def to_xml_document(df: DataFrame, path: str, row_tag: str = "tr", root_tag: str = "table") -> None:
    """Through the built-in writer, nested columns included."""
    df.write.format("xml").option("rowTag", row_tag).option("rootTag", root_tag).save(path)


# --- element streams -----------------------------------------------------------------


def _fold_columns(parts: list[Column]) -> Column:
    return reduce(lambda a, b: F.concat(a, b), parts)


def start_tag(name: Column | str, attributes: dict[str, Column] | None = None, empty: bool = False) -> Column:
    name = F.lit(name) if isinstance(name, str) else name
    pairs = [F.when(v.isNull(), "").otherwise(F.concat(F.lit(f' {k}="'), scalars.escape_xml_attribute(v.cast("string")), F.lit('"'))) for k, v in (attributes or {}).items()]
    return _fold_columns([F.lit("<"), name, *pairs, F.lit(" />" if empty else ">")])


def end_tag(name: Column | str) -> Column:
    return F.concat(F.lit("</"), F.lit(name) if isinstance(name, str) else name, F.lit(">"))


def element(name: Column | str, content: Column, attributes: dict[str, Column] | None = None, normalize: bool = False) -> Column:
    content = scalars.normalize_space(content) if normalize else content
    return F.concat(start_tag(name, attributes), scalars.escape_xml_content(content), end_tag(name))


def xml_comment(text: Column) -> Column:
    return F.concat(F.lit("<!--"), scalars.escape_xml_comment(text), F.lit("-->"))


def instruction(target: str, text: Column) -> Column:
    return F.concat(F.lit(f"<?{target} "), scalars.escape_xml_pi(text), F.lit("?>"))


def doctype(name: str, public: str = "", system: str = "") -> str:
    ids = f' PUBLIC "{public}" "{system}"' if public else f' SYSTEM "{system}"' if system else ""
    return f"<!DOCTYPE {name}{ids}>"


def character_reference(code_point: Column) -> Column:
    return F.concat(F.lit("&#x"), F.hex(code_point.cast("long")), F.lit(";"))


def generated_id(prefix: str, number: Column) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def ranked_outline(df: DataFrame, order: str, rank: str, by: list[str] | None = None) -> DataFrame:
    """Adds opens and closes: how many divisions each heading opens and closes before it, by its rank."""
    from pyspark.sql import Window as W

    w = W.partitionBy(*(by or [])).orderBy(order)
    before = F.coalesce(F.lag(rank).over(w), F.lit(0))
    return df.withColumns({"opens": F.greatest(F.col(rank) - before, F.lit(0)), "closes": F.greatest(before - F.col(rank), F.lit(0))})
