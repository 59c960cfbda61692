"""Readers of ten record syntaxes, from paths or from texts in memory.

Each syntax is a function from a frame of texts (src, value) to a frame of records: lines
for csv, columns, arff and xsv; whole texts for the others. ``read_table`` binds them to
files. CSV, JSON and XML also go to the built-in readers where these do the same.

Every record frame has ``src`` and ``rec_no``, its number within its source, so order
survives any later shuffle.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from functools import reduce
from html.entities import name2codepoint
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.functions import datatypes, scalars
from quillframe.operators import schema as S
from quillframe.sources import options as opts
from quillframe.sources import scanner, splits


def texts(spark: SparkSession, source: str | list[str], whole: bool, path: bool) -> DataFrame:
    """(src, value) from a path (whole files or lines) or from texts in memory."""
    if not path:
        given = [source] if isinstance(source, str) else list(source)
        return spark.createDataFrame([(str(k), t) for k, t in enumerate(given)], "src string, value string")
    return spark.read.text(source, wholetext=whole).select(F.col("_metadata.file_path").alias("src"), "value")


def lines(df: DataFrame, strip: bool = False) -> DataFrame:
    """(src, rec_no, value): physical lines of whole texts; a last line break ends a line and starts none."""
    body = F.regexp_replace(F.regexp_replace("value", r"\r\n?", "\n"), r"\n\z", "")
    rows = df.select("src", F.posexplode(F.split(body, "\n")).alias("pos", "value"))
    value = scalars.trim(F.col("value")) if strip else F.col("value")
    return rows.select("src", (F.col("pos") + 1).cast("long").alias("rec_no"), value.alias("value"))


def real_lines(rows: DataFrame, comment: str = "#") -> DataFrame:
    return S.without_comments(rows, "value", comment) if comment else rows.filter(~F.col("value").rlike(r"^\s*$"))


def named(rows: DataFrame, cells: Column, names: list[str]) -> DataFrame:
    """An array of cells as columns; missing cells are null."""
    rows = rows.select("src", "rec_no", cells.alias("_c"))
    return rows.select("src", "rec_no", *[F.get("_c", F.lit(k)).alias(n) for k, n in enumerate(names)])


def from_pairs(rows: DataFrame, pairs: Column, names: list[str]) -> DataFrame:
    """A name-value map as columns."""
    rows = rows.select("src", "rec_no", pairs.alias("_m"))
    return rows.select("src", "rec_no", *[F.try_element_at("_m", F.lit(n)).alias(n) for n in names])


def mapped(entries: Column) -> Column:
    """A map from an array of (name, value) structures; of entries with one name the last counts."""
    names = F.array_distinct(F.transform(entries, lambda e: e["col1"]))
    last = F.transform(names, lambda n: F.element_at(F.filter(entries, lambda e: e["col1"] == n), -1))
    return F.map_from_entries(F.when(F.size(names) == F.size(entries), entries).otherwise(last))


def by_header(rows: DataFrame, cells: Column, heads: DataFrame, names_of: Callable[[list[str]], list[str]], given: list[str] | None = None) -> DataFrame:
    """Cells as columns by the header of their own source, records counted behind it.

    ``heads``: (src, _h, _head), the number of a source's last header record and its cells; a source without one has no
    records. Sources may name other fields or in another order: columns are all names, as they first appear; a field that
    a source does not have is null. Names that are ``given`` stand for the cells by position. The driver sees each
    different header once.
    """
    kinds = [r["_head"] for r in heads.groupBy("_head").agg(F.min("src").alias("_first")).orderBy("_first").collect()]
    lists = [given or names_of(k) for k in kinds]
    names = list(dict.fromkeys(n for names in lists for n in names))
    rows = rows.join(heads, "src").filter("rec_no > _h").withColumn("rec_no", F.col("rec_no") - F.col("_h"))
    if len(set(map(tuple, lists))) < 2:
        return named(rows, cells, names)
    which = F.coalesce(*[F.when(F.col("_head") == F.array(*map(F.lit, k)), k_no) for k_no, k in enumerate(kinds)])
    rows = rows.select("src", "rec_no", cells.alias("_c"), which.alias("_k"))
    place = lambda n: F.get(F.array(*[F.lit(x.index(n) if n in x else -1) for x in lists]), F.col("_k"))
    return rows.select("src", "rec_no", *[F.get("_c", place(n)).alias(n) for n in names])


def discovered(rows: DataFrame, pairs: Column) -> list[str]:
    """Field names in order of first appearance: the pass that fixes a dynamic schema. One row per distinct name comes back."""
    names = rows.select("src", "rec_no", F.posexplode(F.map_keys(pairs)).alias("pos", "name"))
    first = names.groupBy("name").agg(F.min(F.struct("rec_no", "pos", "src")).alias("at")).orderBy("at")
    return [r["name"] for r in first.collect()]


# --- CSV -----------------------------------------------------------------------------


def quotes_balanced(x: Column, quote: str = '"', escape: str = "", qdouble: bool = True) -> Column:
    """Whether the record's quotes are even; doubled quotes and escaped ones do not count."""
    if escape:
        x = F.regexp_replace(x, rf"\{escape}.", "")
    count = F.length(x) - F.length(F.replace(x, F.lit(quote), F.lit("")))
    return count % 2 == 0


#: What letters stand for behind an escape character (fixed values).
MNEMONICS = {"a": "\a", "b": "\b", "e": "\x1b", "f": "\f", "n": "\n", "r": "\r", "t": "\t"}


def unescaped(x: Column, escape: str) -> Column:
    """Escapes decoded: letters for control characters, octal, xFF, x{F...}, uFFFF and UFFFFFFFF for code points; any other character stands for itself."""
    e = re.escape(escape)
    pieces = F.regexp_extract_all(x, F.lit(rf"({e}(?:x\{{[0-9A-Fa-f]{{1,8}}\}}|x[0-9A-Fa-f]{{2}}|u[0-9A-Fa-f]{{4}}|U[0-9A-Fa-f]{{8}}|[0-7]{{1,3}}|[\s\S])|[^{e}]+|{e})"), F.lit(1))
    point = lambda digits: F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")

    def decoded(p: Column) -> Column:
        body = F.substr(p, F.lit(2), F.length(p))
        return (
            F.when(~p.startswith(escape) | (body == ""), p)
            .when(body.rlike(r"^[xuU]\{?[0-9A-Fa-f]{2,}\}?$|^x\{"), point(F.regexp_replace(body, "[^0-9A-Fa-f]", "")))
            .when(body.rlike("^[0-7]+$"), point(F.conv(body, 8, 16)))
            .when(body.isin(*MNEMONICS), F.translate(body, "".join(MNEMONICS), "".join(MNEMONICS.values())))
            .otherwise(body)
        )

    return F.when(F.instr(x, escape) > 0, F.array_join(F.transform(pieces, decoded), "")).otherwise(x)


def csv_cells(x: Column, o: dict[str, Any]) -> Column:
    """Cells of a record. Without quotes and escapes in it the record is plainly split; otherwise cells are matched one by one."""
    sep, quote, escape = (re.escape(o[k]) if o[k] else "" for k in ("field_sep", "quote", "escape"))
    plain = F.split(x, sep, -1)
    if not quote:
        cells = plain
    else:
        inner = (rf"(?:[^{quote}{escape}]|{escape}.|{quote}{quote})*+" if escape else rf"(?:[^{quote}]|{quote}{quote})*+") if o["qdouble"] or not escape else rf"(?:[^{quote}{escape}]|{escape}.)*+"
        bare = rf"(?:(?!{sep})[\s\S])*+" if not escape else rf"(?:{escape}[\s\S]|(?!{sep})[\s\S])*+"
        blank = r"[^\S\n]*+" if o["field_sep"] != "\t" else " *+"
        cell = rf"(?:\A|(?<={sep}))({blank}{quote}{inner}{quote}{blank}(?={sep}|\z)|{bare})(?={sep}|\z)"
        quoted = rf"^\s*{quote}([\s\S]*){quote}\s*$"

        def clean(c: Column) -> Column:
            body = F.regexp_extract(c, quoted, 1)
            body = F.replace(body, F.lit(o["quote"] * 2), F.lit(o["quote"])) if o["qdouble"] else body
            loose = scalars.trim(c) if o["strip_fields"] else c
            out = F.when(c.rlike(quoted), body).otherwise(loose)
            return unescaped(out, o["escape"]) if escape else out

        special = F.instr(x, o["quote"]) > 0
        if o["escape"]:
            special = special | (F.instr(x, o["escape"]) > 0)
        cells = F.when(special, F.transform(F.regexp_extract_all(x, F.lit(cell), 1), clean)).otherwise(F.transform(plain, lambda c: scalars.trim(c)) if o["strip_fields"] else plain)
        return cells
    return F.transform(cells, lambda c: scalars.trim(c)) if o["strip_fields"] else cells


def csv_records(df: DataFrame, o: dict[str, Any]) -> DataFrame:
    """Logical records of whole texts: lines, or with ``nl_in_quotes`` lines joined until their quotes are even."""
    rows = lines(df, o["strip_records"])
    if o["nl_in_quotes"]:
        odd = (~quotes_balanced(F.col("value"), o["quote"], o["escape"])).cast("int")
        w = W.partitionBy("src").orderBy("rec_no")
        before = w.rowsBetween(W.unboundedPreceding, -1)
        # behind a comment with an odd quote the state is outside, whatever it was: quotes count from there
        note = F.col("value").startswith(o["comment"]) if o["comment"] else F.lit(False)
        rows = rows.withColumns({"_odd": F.sum(odd).over(w), "_reset": note & (odd == 1)})
        opened = (F.coalesce(F.lag("_odd").over(w), F.lit(0)) - F.coalesce(F.max(F.when(F.col("_reset"), F.col("_odd"))).over(before), F.lit(0))) % 2
        rows = rows.withColumn("_start", (opened == 0).cast("int")).withColumn("_no", F.sum("_start").over(w))
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rec_no", "value"))), lambda s: s["value"]), "\n")
        rows = rows.groupBy("src", F.col("_no").alias("rec_no")).agg(joined.alias("value"))
    return real_lines(rows, o["comment"])


def read_csv(df: DataFrame, o: dict[str, Any]) -> DataFrame:
    rows = csv_records(df, o)
    cells = csv_cells(F.col("value"), o)
    return _csv_fields(rows, o, rows.groupBy("src").agg(F.min("rec_no").alias("_h"), F.min_by(cells, "rec_no").alias("_head")))


def csv_files(spark: SparkSession, path: str | list[str], o: dict[str, Any]) -> DataFrame:
    """The same from files of any size, by blocks."""
    rows, heads = splits.logical_records(spark, path, o, one_document=o["one_document"])
    found = spark.createDataFrame([(src, no, text) for src, (no, text) in heads.items()], "src string, _h long, value string")
    return _csv_fields(real_lines(rows, o["comment"]), o, found.select("src", "_h", csv_cells(F.col("value"), o).alias("_head")))


def _csv_fields(rows: DataFrame, o: dict[str, Any], heads: DataFrame) -> DataFrame:
    cells, names = csv_cells(F.col("value"), o), o["field_names"]
    if o["header"]:
        return by_header(rows, cells, heads, S.header_names, names)
    if not names:
        widest = rows.agg(F.max(F.size(cells))).first()[0] or 0
        names = [f"F_{k:03d}" for k in range(1, widest + 1)]
    return named(rows, cells, names)


#: Candidates in order of preference (fixed values).
DELIMITERS = (",", "\t", ":", ";", r"\s+", "|", "!", "@", "#", "/")


def sniff_delimiter(x: Column, quote: str = '"', escape: str = "\\") -> Column:
    """The separator that cuts the record into most pieces, the first of equals; quoted spans and escapes do not count."""
    clean = F.regexp_replace(F.regexp_replace(x, rf"\{escape}.", ""), rf"{quote}[^{quote}]*{quote}", "")
    scores = [F.struct(F.size(F.split(clean, d if d == r"\s+" else re.escape(d), -1)).alias("n"), F.lit(-k).alias("k"), F.lit(d).alias("d")) for k, d in enumerate(DELIMITERS)]
    return F.array_max(F.array(*scores))["d"]


def sniff_format(head: Column, path: Column | None = None) -> Column:
    """The syntax of a text by its path's extension, then by its first lines."""
    path = F.lower(path if path is not None else F.lit(""))
    sep = F.when(F.regexp_count(head, F.lit("\t")) >= 3, "csv").when(F.regexp_count(head, F.lit(",")) >= 3, "csv")
    sep = sep.when(F.regexp_count(head, F.lit(":")) >= 3, "csv").when(F.regexp_count(head, F.lit(";")) >= 3, "csv").when(F.regexp_count(head, F.lit(r"\|")) >= 3, "csv")
    return (
        F.when(path.rlike(r"\.csv$"), "csv").when(path.rlike(r"\.tsv$"), "tsv").when(path.rlike(r"\.(gz|bz2|zip|z|tar|tgz|7z)$"), "compressed")
        .when(path.rlike(r"\.xlsx?$"), "xlsx").when(path.rlike(r"\.x?html?$"), "html").when(path.rlike(r"\.mbox$"), "mime")
        .when(head.rlike(r"(?im)^\s*@RELATION\b"), "arff").when(head.rlike(r"<!--\s*XSV"), "xsv").when(head.rlike(r"(?i)<Xsv\b"), "xsv")
        .when(head.rlike(r"(?i)<!DOCTYPE\s+html|<html\b"), "html").when(head.rlike(r"^\s*<\?xml|<!DOCTYPE"), "xml")
        .when(head.rlike(r"^\s*\("), "sexp").when(head.rlike(r"^\s*[{\[]"), "json").when(head.rlike(r"^\s*my\s+@"), "perl")
        .when(head.rlike(r"(?m)^Individual:"), "manchester").when(head.rlike(r"^[!-9;-~]+:[ \t].*\n([!-9;-~]+:[ \t]|[ \t])"), "mime").when(head.rlike(r"^\s*<"), "xml")
        .otherwise(F.coalesce(sep, F.lit("unknown")))
    )


# --- fixed columns, ARFF -------------------------------------------------------------


def read_columns(df: DataFrame, o: dict[str, Any]) -> DataFrame:
    return _fixed_fields(lines(df), o)


def columns_files(spark: SparkSession, path: str | list[str], o: dict[str, Any]) -> DataFrame:
    return _fixed_fields(splits.read_lines(spark, path, o["one_document"]), o)


def _fixed_fields(rows: DataFrame, o: dict[str, Any]) -> DataFrame:
    rows = real_lines(rows, o["comment"])
    layout = S.TableSchema()
    layout.set_positions(o["positions"])
    layout.rename_all(o["field_names"] or [f"F_{k}" for k in range(1, len(layout) + 1)])
    cells = []
    for f in layout.fields:
        cell = F.substring("value", f.start + 1, f.width)
        cell = scalars.trim(cell) if o["strip_fields"] else cell
        cells.append(F.when(F.length("value") > f.start, cell).alias(f.name))
    return rows.select("src", "rec_no", *cells)


_ARFF = r"(?im)^\s*@ATTRIBUTE\s+('[^']*'|\"[^\"]*\"|\S+)\s+(\{[^}]*\}|\S+)"


def read_arff(df: DataFrame, o: dict[str, Any]) -> DataFrame:
    """Each text's own header on the driver, data rows in the plan: dense records, and sparse ones whose missing fields are 0."""
    data = r"(?is)^.*?^?\s*@DATA\b[ \t]*(\r?\n|$)"
    heads = df.select("src", F.lit(0).cast("long").alias("_h"), F.array(F.regexp_extract("value", r"(?is)^(.*?)^?\s*@DATA\b", 1)).alias("_head"))
    return _arff_fields(lines(df.withColumn("value", F.regexp_replace("value", data, ""))), heads)


def arff_files(spark: SparkSession, path: str | list[str], o: dict[str, Any]) -> DataFrame:
    """The same from files of any size, by blocks."""
    plain = o | {"nl_in_quotes": False, "comment": "%", "strip_records": False}
    rows, heads = splits.logical_records(spark, path, plain, r"(?i)\s*@DATA\b", o["one_document"])
    found = spark.createDataFrame([(src, no, [text]) for src, (no, text) in heads.items()], "src string, _h long, _head array<string>")
    return _arff_fields(rows, found)


def _arff_fields(rows: DataFrame, heads: DataFrame) -> DataFrame:
    rows = real_lines(rows, "%")
    cell = r"\s*('(?:[^'\\]|\\.)*+'|\"(?:[^\"\\]|\\.)*+\"|[^,]*+)\s*(?:,|$)"

    def value(c: Column) -> Column:
        bare = F.regexp_replace(scalars.trim(c), r"^(['\"])([\s\S]*)\1$", "$2")
        return F.when(scalars.trim(c) == "?", F.lit(None)).otherwise(unescaped(bare, "\\"))

    body = F.regexp_replace(scalars.trim(F.col("value")), r"^\{\s*|\s*\}$", "")
    sparse = F.col("value").rlike(r"^\s*\{")
    entries = F.filter(F.regexp_extract_all(body, F.lit(cell), 1), lambda c: scalars.trim(c) != "")
    index = lambda e: F.regexp_extract(scalars.trim(e), r"^(\d+)\s", 1).cast("int")
    pairs = F.map_from_entries(F.transform(entries, lambda e: F.struct(index(e), value(F.regexp_replace(scalars.trim(e), r"^\d+\s+", "")))))
    fields = F.regexp_count(F.get("_head", F.lit(0)), F.lit(_ARFF))
    from_sparse = F.transform(F.sequence(F.lit(0), F.greatest(fields - 1, F.lit(0))), lambda k: F.when(F.map_contains_key(pairs, k), F.try_element_at(pairs, k)).otherwise(F.lit("0")))
    dense = F.transform(F.regexp_extract_all(F.col("value"), F.lit(cell), 1), value)
    names_of = lambda head: [n.strip("'\"") for n, _ in re.findall(_ARFF, head[0] or "")]
    # split by kind: sparse index parsing never sees dense rows
    return by_header(rows.filter(~sparse), dense, heads, names_of).unionByName(by_header(rows.filter(sparse), from_sparse, heads, names_of))


# --- whole-text syntaxes -------------------------------------------------------------


def read_json(df: DataFrame, o: dict[str, Any]) -> DataFrame:
    """Objects of an array, of ``{"Table": [...]}``, or one after another; comments allowed."""
    whole = df.select("src", F.col("value"))
    bare = F.regexp_replace("value", r"(?m)^\s*//.*$", "")
    listed = F.coalesce(F.from_json(F.get_json_object(bare, "$.Table"), "array<string>"), F.from_json(bare, "array<string>"))
    rows = whole.select("src", F.posexplode(listed).alias("pos", "value")).select("src", (F.col("pos") + 1).cast("long").alias("rec_no"), "value")
    loose = scanner.balanced_records(whole.filter(listed.isNull()), openers="{", closers="}", quotes='"', comment="//")
    rows = rows.unionByName(loose)
    pairs = F.from_json("value", "map<string,string>")
    return from_pairs(rows, pairs, o["field_names"] or discovered(rows, pairs))


def read_mime(df: DataFrame, o: dict[str, Any]) -> DataFrame:
    """Blank-line separated blocks of ``Name: value``, continuation lines joined."""
    clean = F.regexp_replace("value", r"\r\n?", "\n")
    blocks = F.filter(F.split(clean, r"\n[ \t]*(?:\n[ \t]*)+"), lambda b: ~b.rlike(r"^\s*$"))
    rows = df.select("src", F.posexplode(blocks).alias("pos", "value")).select("src", (F.col("pos") + 1).cast("long").alias("rec_no"), "value")
    folded = F.regexp_replace(F.regexp_replace("value", r"\n[ \t]+", " "), r"\s+\z", "")
    heads = F.filter(F.split(folded, "\n"), lambda h: h.rlike(r"^[!-9;-~]+:"))
    pairs = mapped(F.transform(heads, lambda h: F.struct(F.regexp_extract(h, r"^([!-9;-~]+):", 1), F.regexp_extract(h, r"^[!-9;-~]+:\s*(.*)$", 1))))
    return from_pairs(rows, pairs, o["field_names"] or discovered(rows, pairs))


def read_manchester(df: DataFrame, o: dict[str, Any]) -> DataFrame:
    """Individual frames; each fact ``name value`` is a field, Id is the individual."""
    clean = F.regexp_replace("value", r"(?m)^\s*#.*$", "")
    frames = F.filter(F.split(clean, r"(?m)^(?=\s*(?:Individual|Datatype|Class|ObjectProperty|DataProperty|AnnotationProperty|Prefix|Ontology):)"), lambda f: f.rlike(r"^\s*Individual:"))
    rows = df.select("src", F.posexplode(frames).alias("pos", "value")).select("src", (F.col("pos") + 1).cast("long").alias("rec_no"), "value")
    facts = F.regexp_extract_all(F.regexp_replace("value", r"(?s)^.*?Facts:", ""), F.lit(r"(\w[-\w.]*\s+(?:\"(?:[^\"\\]|\\.)*+\"|'(?:[^'\\]|\\.)*+'|[^,\s]+))"), 1)
    has = F.col("value").rlike("Facts:")
    quoted = r"(?s)^([\"'])(.*)\1$"
    value = lambda v: F.when(v.rlike(quoted), F.regexp_replace(F.regexp_replace(v, quoted, "$2"), r"(?s)\\(.)", "$1")).otherwise(v)
    # an individual without a label is one without a name
    label = F.regexp_extract("value", r"(?s)Individual:[ \t]*(\"(?:[^\"\\]|\\.)*+\"|\S+)", 1)
    name = F.when(label != "_:", value(label))
    entries = F.transform(facts, lambda f: F.struct(F.regexp_extract(f, r"^(\S+)", 1), value(F.regexp_extract(f, r"^\S+\s+(?s)(.*)$", 1))))
    kinds = F.regexp_extract("value", r"Types:\s*([^\n]*\S)", 1)
    own = F.array(F.struct(F.lit("Id"), name), F.struct(F.lit("Types"), kinds))
    pairs = mapped(F.concat(own, F.when(has, entries).otherwise(F.slice(own, 1, 0))))
    return from_pairs(rows, pairs, o["field_names"] or discovered(rows, pairs))


def read_sexp(df: DataFrame, o: dict[str, Any]) -> DataFrame:
    """Association lists ``((name 'value') ...)``, or plain lists in the order of the field names."""
    # the list of records may itself stand in one list
    inner = F.regexp_replace(F.regexp_replace("value", r"^\s*\(\s*[A-Za-z]\w*\s+(?=\(\s*(?:tr\s+)?[('\"])", ""), r"(?m)^\s*;.*$", "")
    rows = scanner.balanced_records(df.withColumn("value", inner), openers="(", closers=")", quotes="\"'")
    atom = r"(?:'(?:[^'\\]|\\.)*+'|\"(?:[^\"\\]|\\.)*+\"|[^\s()]++)"
    strip = lambda a: F.regexp_replace(F.regexp_replace(a, r"^(['\"])([\s\S]*)\1$", "$2"), r"\\(.)", "$1")
    found = F.regexp_extract_all("value", F.lit(rf"(\(\s*[^\s()'\"]+\s+\.?\s*{atom}\s*\))"), 1)
    pairs = mapped(F.transform(found, lambda p: F.struct(F.regexp_extract(p, r"^\(\s*([^\s()]+)", 1), strip(F.regexp_extract(p, rf"^\(\s*[^\s()]+\s+(?:\.\s+)?({atom})\s*\)$", 1)))))
    if o["field_names"]:
        plain = F.transform(F.regexp_extract_all(F.regexp_replace("value", r"^\(\s*(?:tr\s+)?", ""), F.lit(f"({atom})"), 1), strip)
        keyed = F.map_from_arrays(F.slice(F.array(*[F.lit(n) for n in o["field_names"]]), F.lit(1), F.least(F.size(plain), F.lit(len(o["field_names"])))), F.slice(plain, 1, len(o["field_names"])))
        return from_pairs(rows, F.when(F.size(found) > 0, pairs).otherwise(keyed), o["field_names"])
    return from_pairs(rows, pairs, discovered(rows, pairs))


def read_perl(df: DataFrame, o: dict[str, Any]) -> DataFrame:
    """Anonymous hashes ``{ "name" => value, ... }`` of a list."""
    rows = scanner.balanced_records(df, openers="{", closers="}", quotes="\"'", comment="#")
    value = r"(?:'(?:[^'\\]|\\.)*+'|\"(?:[^\"\\]|\\.)*+\"|[^,\s}]++)"
    found = F.regexp_extract_all("value", F.lit(rf"({value}\s*=>\s*{value})"), 1)
    strip = lambda a: F.regexp_replace(F.regexp_replace(a, r"^(['\"])([\s\S]*)\1$", "$2"), r"\\(.)", "$1")
    part = lambda p, k: strip(F.regexp_extract(p, rf"^({value})\s*=>\s*({value})$", k))
    given = lambda p: F.when(~p.rlike(rf"^{value}\s*=>\s*undef$"), part(p, 2))
    pairs = mapped(F.transform(found, lambda p: F.struct(part(p, 1), given(p))))
    return from_pairs(rows, pairs, o["field_names"] or discovered(rows, pairs))


def _decoded(x: Column) -> Column:
    """Character references and the entity names of HTML 4 decoded; texts without an ampersand are left alone, unknown names stay."""
    names = F.create_map(*[F.lit(v) for name, point in sorted(name2codepoint.items()) for v in (name, chr(point))], F.lit("apos"), F.lit("'"))
    pieces = F.regexp_extract_all(x, F.lit(r"(&(?:#[0-9]{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]*);|[^&]+|&)"), F.lit(1))
    point = lambda digits: F.decode(F.unhex(F.lpad(digits, 8, "0")), "UTF-32")

    def piece(p: Column) -> Column:
        body = F.substr(p, F.lit(2), F.length(p) - 2)
        return (
            F.when(~p.startswith("&") | (p == "&"), p)
            .when(body.rlike("^#[0-9]"), point(F.conv(F.substr(body, F.lit(2)), 10, 16)))
            .when(body.rlike("^#"), point(F.substr(body, F.lit(3))))
            .otherwise(F.coalesce(F.try_element_at(names, body), p))
        )

    return F.when(F.instr(x, "&") > 0, F.array_join(F.transform(pieces, piece), "")).otherwise(x)


def read_xml(df: DataFrame, o: dict[str, Any]) -> DataFrame:
    """Records are ``tr_tag`` elements; a field is named by its class, or else its tag. Chosen record attributes are fields too."""
    tr, cls = re.escape(o["tr_tag"]), re.escape(o["class_attr"] or "class")
    found = F.regexp_extract_all("value", F.lit(rf"(?s)(<{tr}\b[^>]*>.*?</{tr}\s*>)"), 1)
    rows = df.select("src", F.posexplode(found).alias("pos", "value")).select("src", (F.col("pos") + 1).cast("long").alias("rec_no"), "value")
    inside = F.regexp_replace(F.regexp_replace("value", rf"^<{tr}\b[^>]*>", ""), rf"</{tr}\s*>$", "")
    cells = F.regexp_extract_all(inside, F.lit(r"(?s)(<([A-Za-z][-\w.:]*)\b[^>]*>.*?</\2\s*>)"), 1)
    tag = lambda c: F.regexp_extract(c, r"^<([A-Za-z][-\w.:]*)", 1)
    by_class = lambda c: F.regexp_extract(c, rf"^<[^>]*?\s{cls}\s*=\s*[\"']([^\"']*)[\"']", 1)
    content = lambda c: F.regexp_replace(F.regexp_replace(c, r"(?s)^<[^>]*>|</[^>]*>\s*$", ""), r"<[^>]*>", "")
    entries = F.transform(cells, lambda c: F.struct(F.when(by_class(c) != "", by_class(c)).otherwise(tag(c)), scalars.trim(content(c))))
    opening = F.regexp_extract("value", rf"^<{tr}\b([^>]*)>", 1)
    for name in o["attr_fields"] or []:
        got = F.regexp_extract(opening, rf"\b{re.escape(name)}\s*=\s*[\"']([^\"']*)[\"']", 1)
        entries = F.concat(F.array(F.struct(F.lit(name), got)), entries)
    pairs = mapped(entries)
    out = from_pairs(rows, pairs, o["field_names"] or discovered(rows, pairs))
    return out.select("src", "rec_no", *[_decoded(F.col(c)).alias(c) for c in out.columns[2:]])


# --- typed tuples --------------------------------------------------------------------

_ATTR = r"([A-Za-z_:][-\w.:]*)\s*=\s*(\"[^\"]*\"|'[^']*')"


def declarations(head: str) -> dict[str, tuple[str, str, str | None]]:
    """Attributes of a Head to (type, repetition, default): ``#type(arg)rep#default``, ``##default`` or a plain default."""
    out = {}
    for name, quoted in re.findall(_ATTR, head):
        value = html.unescape(quoted[1:-1])
        m = re.fullmatch(r"#([^#]*?)([!?*+]?)#(.*)", value, re.S)
        if m:
            kind, repetition, default = m[1].strip(), m[2], m[3].removeprefix("#") if m[1] == "" else m[3]
            out[name] = (kind or "string", repetition, default or None)
        else:
            out[name] = ("string", "", value)
    return out


def read_xsv(df: DataFrame, o: dict[str, Any]) -> DataFrame:
    """Typed tuples by their text's own Head: declared fields in order, defaults filled, and ``_errors`` (code, field) for what is wrong with a record.

    Codes: UNKATTR for undeclared attributes, REQATTR for missing required ones, ATTRTYPE for values not of their type,
    DUPID for identifiers that an earlier tuple of the text has.
    """
    plain = F.regexp_replace("value", r"(?s)<!--.*?-->", "")
    heads = df.select("src", "value", F.regexp_extract(plain, rf"(?s)<{o['head_name']}\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", 1).alias("_head"))
    kinds = [r["_head"] for r in heads.groupBy("_head").agg(F.min("src").alias("_first")).orderBy("_first").collect()]
    parts = [_xsv_records(heads.filter(F.col("_head") == k).select("src", "value"), plain, declarations(k), o) for k in kinds]
    if not parts:
        return df.select("src", F.lit(0).cast("long").alias("rec_no"), F.array().cast("array<struct<code:string,field:string>>").alias("_errors"))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*[c for c in out.columns if c != "_errors"], "_errors")


def _xsv_records(df: DataFrame, plain: Column, fields: dict[str, tuple[str, str, str | None]], o: dict[str, Any]) -> DataFrame:
    """The tuples of texts with one Head."""
    found = F.regexp_extract_all(plain, F.lit(rf"(?s)<{o['rec_name']}\b((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"), 1)
    rows = df.select("src", F.posexplode(found).alias("pos", "value")).select("src", (F.col("pos") + 1).cast("long").alias("rec_no"), "value")
    attrs = F.regexp_extract_all("value", F.lit(f"({_ATTR.replace('([A-Za-z_:][-\\w.:]*)', '[A-Za-z_:][-\\w.:]*').replace('(\\\"', '(?:\\\"')})"), 1)
    entry = lambda a: F.struct(F.regexp_extract(a, r"^([^=\s]+)", 1), F.regexp_replace(F.regexp_extract(a, r"(?s)=\s*(.*)$", 1), r"(?s)^['\"]|['\"]$", ""))
    rows = rows.select("src", "rec_no", mapped(F.transform(attrs, entry)).alias("_m"))
    errors, columns = [], []
    known = F.array(*[F.lit(n) for n in fields]) if fields else F.array().cast("array<string>")
    stray = F.transform(F.array_except(F.map_keys("_m"), known), lambda n: F.struct(F.lit("UNKATTR").alias("code"), n.alias("field")))
    bad = lambda test, code, name: F.when(test, F.struct(F.lit(code).alias("code"), F.lit(name).alias("field")))
    for name, (kind, _, _) in fields.items():
        if kind == "ID":  # in order of the records, all but the first of one text
            again = F.row_number().over(W.partitionBy("src", F.try_element_at("_m", F.lit(name))).orderBy("rec_no")) > 1
            rows = rows.withColumn(f"_again_{name}", again & F.try_element_at("_m", F.lit(name)).isNotNull())
            errors.append(bad(F.col(f"_again_{name}"), "DUPID", name))
    for name, (kind, repetition, default) in fields.items():
        raw = F.try_element_at("_m", F.lit(name))
        if kind == "BASE":
            columns.append(F.when(raw != "", F.concat(F.lit(default or ""), raw)).otherwise(raw).alias(name))
            continue
        required = kind == "REQUIRED" or repetition in ("!", "+")
        value = F.coalesce(raw, F.lit(default))
        columns.append(value.alias(name))
        if required:
            errors.append(bad(F.coalesce(raw, F.lit("")) == "", "REQATTR", name))
        if o["type_check"] and kind not in ("REQUIRED", "string"):
            errors.append(bad(raw.isNotNull() & ~datatypes.conforms(raw, kind + (repetition or "?")), "ATTRTYPE", name))
    wrong = F.concat(stray, F.filter(F.array(*errors), lambda e: e.isNotNull())) if errors else stray
    out = rows.select("src", "rec_no", *columns, wrong.alias("_errors"))
    decode = [(_decoded(F.col(c)) if c not in ("src", "rec_no", "_errors") else F.col(c)).alias(c) for c in out.columns]
    return out.select(*decode)


def xsv_metadata(text: str, xsv_name: str = "Xsv") -> dict[str, str]:
    """Attributes of the outer element: its Dublin Core metadata."""
    m = re.search(rf"<{xsv_name}\b([^>]*)>", text)
    return {n: html.unescape(v[1:-1]) for n, v in re.findall(_ATTR, m[1])} if m else {}


READERS = {
    "arff": read_arff, "columns": read_columns, "csv": read_csv, "json": read_json, "manchester": read_manchester,
    "mime": read_mime, "perl": read_perl, "sexp": read_sexp, "xml": read_xml, "xsv": read_xsv,
}


#: Syntaxes whose files are read by blocks; of the others each file is one text.
FILES = {"arff": arff_files, "columns": columns_files, "csv": csv_files}


def parse_table(df: DataFrame, fmt: str, **options: Any) -> DataFrame:
    """Records of a frame of whole texts (src, value)."""
    return READERS[fmt](df, opts.resolve(**options))


def read_table(spark: SparkSession, fmt: str, source: str | list[str], path: bool = True, **options: Any) -> DataFrame:
    """Records of files (any path Spark reads, compressed or not), or of texts in memory with ``path=False``."""
    if fmt not in READERS:
        raise ValueError(f"unknown format {fmt!r}")
    o = opts.resolve(**options)
    if path and fmt in FILES:
        return FILES[fmt](spark, source, o)
    if path and o["one_document"]:
        return _parts(texts(spark, source, whole=True, path=True), fmt, options)
    return parse_table(texts(spark, source, whole=True, path=path), fmt, **options)


def _parts(files: DataFrame, fmt: str, options: dict[str, Any]) -> DataFrame:
    """The records of folders whose files, in order of their names, are one document; files hold whole records.

    Files are parsed on their own and their records numbered on. What stands around the records is told from them:
    brackets of a JSON list are left out, and tuples get the Head of their document.
    """
    folder = F.regexp_replace("src", "/[^/]*$", "")
    if fmt == "json":
        body = F.regexp_replace("value", r"^\s*\{\s*\"Table\":\s*\[|\]\s*\}\s*$|,\s*$", "")
        files = files.select("src", F.concat(F.lit("["), F.regexp_replace(body, r",\s*$", ""), F.lit("]")).alias("value"))
    if fmt == "xsv":
        o = opts.resolve(**options)
        head = F.regexp_extract("value", rf"(?s)(<{o['head_name']}\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*>)", 1)
        heads = files.filter(head != "").groupBy(folder.alias("_doc")).agg(F.min_by(head, "src").alias("_head"))
        files = files.join(heads, folder == F.col("_doc")).select("src", F.when(head != "", F.col("value")).otherwise(F.concat("_head", F.lit("\n"), "value")).alias("value"))
    rows = parse_table(files, fmt, **{k: v for k, v in options.items() if k != "one_document"})
    before = W.partitionBy("_doc").orderBy("src").rowsBetween(W.unboundedPreceding, -1)
    counts = rows.groupBy("src").agg(F.max("rec_no").alias("_n")).withColumn("_doc", folder)
    shifts = counts.select("src", "_doc", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rows = rows.join(shifts, "src").withColumns({"src": F.col("_doc"), "rec_no": F.col("rec_no") + F.col("_before")})
    return rows.drop("_doc", "_before")


def scan_csv(spark: SparkSession, path: str, **options: Any) -> DataFrame:
    """Large CSV files through the built-in reader, which splits them: pushdown and column pruning included."""
    o = opts.resolve(**options)
    reader = spark.read.option("header", o["header"]).option("sep", o["field_sep"]).option("quote", o["quote"]).option("escape", o["escape"] or o["quote"])
    reader = reader.option("encoding", o["charset"]).option("multiLine", o["nl_in_quotes"]).option("emptyValue", "").option("nullValue", "\x00")
    reader = reader.option("ignoreLeadingWhiteSpace", o["strip_fields"]).option("ignoreTrailingWhiteSpace", o["strip_fields"])
    return (reader.option("comment", o["comment"][:1]) if o["comment"] else reader).csv(path)


def scan_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True) -> DataFrame:
    """(path, length, content) of every file below a folder, filtered by glob."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path).select("path", "length", "content")


def archive_members(files: DataFrame) -> DataFrame:
    """(path, member, value): texts of the members of zip, tar and compressed files, a file at a time."""
    import bz2
    import gzip
    import io
    import tarfile
    import zipfile

    import pandas as pd

    def run(batches):
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                raw, out = bytes(content), []
                if zipfile.is_zipfile(io.BytesIO(raw)):
                    with zipfile.ZipFile(io.BytesIO(raw)) as z:
                        out = [(n, z.read(n)) for n in z.namelist() if not n.endswith("/")]
                elif path.endswith((".tar", ".tgz", ".tar.gz", ".tar.bz2")):
                    with tarfile.open(fileobj=io.BytesIO(raw)) as t:
                        out = [(m.name, t.extractfile(m).read()) for m in t.getmembers() if m.isfile()]
                else:
                    out = [("", gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else bz2.decompress(raw) if raw[:3] == b"BZh" else raw)]
                if out:
                    yield pd.DataFrame({"path": path, "member": [n for n, _ in out], "value": [b.decode("utf-8", "replace") for _, b in out]})

    return files.select("path", "content").mapInPandas(run, "path string, member string, value string")
