"""Tables written as files of a syntax and opened again by the public functions: every row of the table, many files or parts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.plans.registry import query
from quillframe.plans.session import scratch, table
from quillframe.sources import options, readers, seeks, sinks, splits

#: White space at the ends of a field is the field's own in these syntaxes.
EXACT = ("csv", "json", "xsv", "arff", "perl", "sexp", "manchester")


@query("SELECT doc_id, text, source FROM documents")
def csv_files_by_header(spark, sf_dir):
    """Two kinds of CSV files with other fields in another order, line breaks in their quotes: each file by its own header."""
    docs, path = table(spark, sf_dir, "documents").select("doc_id", "text", "source"), scratch(spark)
    for kind, columns in enumerate((["doc_id", "text", "source"], ["source", "doc_id", "lang", "text"])):
        part = docs.filter(F.crc32(F.col("doc_id").cast("string")) % 2 == kind).withColumn("lang", F.lit("x"))
        lines = part.repartition(3, "doc_id").select(sinks.record(part, "csv", columns).alias("line"))
        headed = lines.mapInPandas(_with_header(",".join(columns)), "value string")
        headed.write.mode("append").text(path)
    rows = readers.read_table(spark, "csv", path)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source")


def _with_header(header: str):
    def run(batches):
        first = True
        for batch in batches:
            out = batch.rename(columns={"line": "value"})
            if first:
                out.loc[-1] = [header]
                out = out.sort_index()
                first = False
            yield out

    return run


def _document_query(fmt: str) -> None:
    def plan(spark, sf_dir):
        path = scratch(spark)
        docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").alias("rec_no"), F.lit("x").alias("mark"), "text")
        sinks.write_document(docs.select("rec_no", "doc_id", "mark", "text"), path, fmt, "rec_no")
        rows = readers.read_table(spark, fmt, path, one_document=True, **({"field_names": ["Id", "mark", "text"]} if fmt == "manchester" else {}))
        key = "Id" if fmt == "manchester" else "doc_id"
        return rows.select("rec_no", F.col(key).cast("long").alias("doc_id"), "mark", "text")

    plan.__name__ = f"document_of_parts_{fmt}"
    text = "text" if fmt in EXACT else "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"
    query(f"SELECT row_number() OVER (ORDER BY doc_id) AS rec_no, doc_id, 'x' AS mark, {text} AS text FROM documents")(plan)


for _fmt in ("arff", "csv", "json", "xml", "xsv"):
    _document_query(_fmt)


@query("SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '\\n$', ''), chr(10)), lambda l: true))::BIGINT AS n FROM documents WHERE text <> ''")
def lines_of_files(spark, sf_dir):
    """Lines in eight files, each line with its document's number before it, numbered and counted again from the files."""
    path = scratch(spark)
    docs = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id", F.regexp_replace("text", r"\n\z", "").alias("text"))
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("no", "line"))
    rows = lines.repartitionByRange(8, "doc_id").sortWithinPartitions("doc_id", "no")
    rows.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.regexp_replace("line", r"[\r\t]", " ")).alias("value")).write.text(path)
    numbered = splits.read_lines(spark, path)
    counts = numbered.groupBy(F.split("value", "\t")[0].cast("long").alias("doc_id")).agg(F.count_distinct("src", "rec_no").alias("n"))
    return counts


@query("SELECT doc_id, '\"' || doc_id || '\",\"' || replace(text, '\"', '\"\"') || '\"' AS value, true AS near FROM documents WHERE doc_id IN (SELECT c_custkey FROM customer)")
def seek_records(spark, sf_dir):
    """Documents in eight CSV files; those that have a customer's number are asked for by file and record number, and each is read behind a stored index of every eighth record."""
    path, side, o = scratch(spark), scratch(spark), options.resolve(comment="")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    quoted = lambda c: F.concat(F.lit('"'), F.replace(F.col(c).cast("string"), F.lit('"'), F.lit('""')), F.lit('"'))
    lines = docs.select("doc_id", F.concat_ws(",", quoted("doc_id"), quoted("text")).alias("value"))
    lines.repartitionByRange(8, "doc_id").select("value").write.text(path)
    seeks.record_index(spark, path, o, 8).write.parquet(side)
    key = F.regexp_extract("value", r'^"(\d+)"', 1).cast("long").alias("doc_id")
    records = splits.logical_records(spark, path, o)[0].select("src", "rec_no", key)
    asked = records.join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id")), "doc_id", "left_semi")
    found = seeks.records_at(spark.read.parquet(side), asked, o, 8)
    return found.select(key, "value", (F.col("bytes_read") < 400_000).alias("near"))


_TUPLE_HEAD = '<Xsv>\n<Head id="#ID!#" cust="#positiveInteger#7" status="#ENUM(F O)#" page="#BASE#http://x/" note="none">\n'


@query("""
WITH o AS (SELECT o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rec_no, o_custkey AS src, o_orderstatus AS s FROM orders),
r AS (SELECT *, CASE WHEN k % 7 > 0 THEN 'o' || (rec_no // 2) END AS id, CASE WHEN k % 5 > 0 THEN (k % 4)::VARCHAR END AS cust FROM o),
d AS (SELECT *, id IS NOT NULL AND row_number() OVER (PARTITION BY src, id ORDER BY rec_no) > 1 AS again FROM r)
SELECT src, rec_no, id, coalesce(cust, '7') AS cust, s AS status, 'http://x/' || k AS page, 'none' AS note,
  array_to_string(list_filter([CASE WHEN k % 3 = 0 THEN 'UNKATTR odd' END, CASE WHEN again THEN 'DUPID id' END, CASE WHEN id IS NULL THEN 'REQATTR id' END, CASE WHEN cust = '0' THEN 'ATTRTYPE cust' END, CASE WHEN s NOT IN ('F', 'O') THEN 'ATTRTYPE status' END], lambda e: e IS NOT NULL), ',') AS errors FROM d
""")
def declared_tuples(spark, sf_dir):
    """Each customer's orders as a text of typed tuples: defaults, required and unknown attributes, types, bases and repeated identifiers."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("src"), F.col("o_orderstatus").alias("s"))
    rows = rows.withColumn("rec_no", F.row_number().over(W.partitionBy("src").orderBy("k")))
    attribute = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f' {name}="'), value, F.lit('"'))).otherwise("")
    given = {
        "id": F.when(F.col("k") % 7 > 0, F.concat(F.lit("o"), F.floor(F.col("rec_no") / 2).cast("string"))), "cust": F.when(F.col("k") % 5 > 0, (F.col("k") % 4).cast("string")),
        "status": F.col("s"), "page": F.col("k").cast("string"), "odd": F.when(F.col("k") % 3 == 0, F.lit("x")),
    }
    tuples = rows.select("src", "k", F.concat(F.lit("<Rec"), *[attribute(n, v) for n, v in given.items()], F.lit(" />")).alias("line"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "line"))), lambda s: s["line"]), "\n")
    texts = tuples.groupBy("src").agg(F.concat(F.lit(_TUPLE_HEAD), lines, F.lit("\n</Head>\n</Xsv>")).alias("value"))
    errors = F.array_join(F.transform("_errors", lambda e: F.concat_ws(" ", e["code"], e["field"])), ",")
    return readers.parse_table(texts, "xsv").select("src", "rec_no", "id", "cust", "status", "page", "note", errors.alias("errors"))


@query("SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders")
def csv_by_library_names(spark, sf_dir):
    """Orders as CSV files read by Spark's own reader, with options named as in the common CSV libraries."""
    path = scratch(spark)
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")).alias("o_orderpriority"), "o_totalprice")
    given = {"sep_char": ";", "quote_char": "'", "escape_char": "\\", "undef_str": "none"}
    orders.write.options(**options.csv_reader_options(**given, always_quote=True)).csv(path)
    found = spark.read.schema("o_orderkey long, o_orderpriority string, o_totalprice double").options(**options.csv_reader_options(**given, allow_whitespace=True)).csv(path)
    return found.withColumn("o_orderpriority", F.trim("o_orderpriority"))


@query("SELECT doc_id, n_chars FROM documents")
def members_of_archives(spark, sf_dir):
    """Documents in compressed JSON files in folders by source, found again below the top folder, opened and parsed."""
    path = scratch(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    docs.repartition(4, "source").write.partitionBy("source").option("compression", "gzip").json(path)
    members = readers.archive_members(readers.scan_files(spark, path, "*.json.gz"))
    lines = members.select(F.explode(F.split(F.trim("value"), "\n")).alias("line")).filter("line <> ''")
    return lines.select(F.from_json("line", "doc_id long, n_chars long").alias("r")).select("r.*")
