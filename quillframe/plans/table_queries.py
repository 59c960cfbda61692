"""Records, schemas, keys, statistics and writers over the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.operators import partial, pull, records, schema, stats, tree
from quillframe.plans.registry import query
from quillframe.plans.session import scratch, table
from quillframe.sources import readers, sinks


@query("SELECT d.doc_id, coalesce(quality::VARCHAR, 'none') AS quality, quality IS NULL AS missing FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
def default_and_required(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    s = schema.TableSchema([schema.FieldDef("doc_id"), schema.FieldDef("quality", default="none"), schema.FieldDef("missing")])
    return s.with_defaults(rows.select("doc_id", F.col("quality").cast("string").alias("quality"), F.col("quality").isNull().alias("missing")))


@query("""
SELECT user_id::VARCHAR || '#' || event_type AS key, event_id, value FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS rk FROM events) WHERE rk = 1
""")
def key_index_first_wins(spark, sf_dir):
    return records.key_index(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id").select("key", "event_id", "value")


@query("SELECT user_id::VARCHAR || '#' || event_type AS key, count(*) AS n FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY user_id, event_type HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return records.duplicate_keys(table(spark, sf_dir, "events"), ["user_id", "event_type"])


@query("SELECT n_name AS key, n_regionkey AS value FROM nation")
def key_value_map(spark, sf_dir):
    return records.key_value_map(table(spark, sf_dir, "nation"), "n_name", "n_regionkey", "n_nationkey")


@query("SELECT DISTINCT o_custkey::VARCHAR AS ref FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def unresolved_refs(spark, sf_dir):
    ids = table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0")
    return records.unresolved_references(table(spark, sf_dir, "orders"), "o_custkey", ids, "c_custkey")


@query("SELECT conv_id AS id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) > 1")
def dup_ids(spark, sf_dir):
    return records.duplicate_ids(table(spark, sf_dir, "conversations"), "conv_id")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS rec_no FROM orders")
def record_numbers(spark, sf_dir):
    return records.numbered(table(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


@query("SELECT o_orderkey, o_custkey, rec_no FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS rec_no FROM orders) WHERE rec_no BETWEEN 10 AND 19")
def record_range(spark, sf_dir):
    rows = records.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), ["o_orderkey"])
    return records.record_range(rows, 19, 10)


@query("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey DESC LIMIT 1")
def last_record(spark, sf_dir):
    return records.last_record(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")


@query("""
SELECT doc_id, (sum(strlen(text) + 1) OVER (ORDER BY doc_id) - strlen(text) - 1)::BIGINT AS "offset", strlen(text) AS len FROM documents
""")
def record_offsets(spark, sf_dir):
    return records.with_offsets(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text").select("doc_id", "offset", "len")


@query("SELECT strlen(text) AS len, doc_id AS rec_no FROM documents ORDER BY len DESC, doc_id LIMIT 1")
def longest_record(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("len"))
    return records.longest_record(docs, "len", "doc_id")


@query("""
WITH o AS (SELECT row_number() OVER (ORDER BY doc_id) AS rec_no, (sum(strlen(text) + 1) OVER (ORDER BY doc_id) - strlen(text) - 1)::BIGINT AS "offset" FROM documents),
p AS (SELECT DISTINCT o_orderkey * 97 AS probe FROM orders)
SELECT p.probe, max(o.rec_no) AS rec_no FROM p JOIN o ON o."offset" <= p.probe GROUP BY p.probe
""")
def record_at_offset(spark, sf_dir):
    docs = records.with_offsets(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text").select("doc_id", "offset")
    offsets = records.numbered(docs, ["doc_id"]).select("rec_no", "offset")
    probes = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 97).alias("probe")).distinct()
    return records.record_at_offset(offsets, probes)


@query("SELECT 0::BIGINT AS out_of_order")
def offset_check(spark, sf_dir):
    docs = records.with_offsets(table(spark, sf_dir, "documents").select("doc_id", "text"), ["doc_id"], "text").select("doc_id", "offset")
    return records.offsets_ordered(records.numbered(docs, ["doc_id"]))


@query("""
SELECT e.event_id, p.value AS prior_value FROM (SELECT * FROM events WHERE event_type = 'purchase') e
ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts
""")
def nearest_prior_record(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    left = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    right = events.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return records.nearest_prior(left, right, ["user_id"], "ts", "ts", "value", "prior_value").select("event_id", "prior_value")


@query("""
SELECT n.n_nationkey, n.n_name, r.r_name FROM nation n LEFT JOIN region r ON n.n_regionkey = r.r_regionkey
""")
def alias_lookup(spark, sf_dir):
    entries = table(spark, sf_dir, "region").withColumn("short", F.concat(F.lit("Region "), F.col("r_regionkey")))
    aliases = records.alias_table(entries, ["short", "r_name"])
    probes = table(spark, sf_dir, "nation").withColumn("probe", F.concat(F.lit(" REGION "), F.col("n_regionkey")))
    return records.lookup(probes, "probe", aliases).select("n_nationkey", "n_name", "r_name")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def group_sizes(spark, sf_dir):
    return records.group_sizes(table(spark, sf_dir, "nation"), "n_regionkey")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 2")
def group_members(spark, sf_dir):
    return records.group_members(table(spark, sf_dir, "nation"), "n_regionkey", 2, "n_nationkey").select("n_nationkey", "n_name")


@query("SELECT n_nationkey, 'Gen.' || (n_nationkey + 1)::VARCHAR || '.' || (n_regionkey + 1)::VARCHAR || '.a' AS first_ref, 2::BIGINT AS n FROM nation")
def parse_references(spark, sf_dir):
    ref = F.concat((F.col("n_nationkey") + 1).cast("string"), F.lit(":"), (F.col("n_regionkey") + 1).cast("string"), F.lit("a, 21:1-20"))
    refs = records.parse_references(ref, F.lit("Gen"))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.get(refs, F.lit(0)).alias("first_ref"), F.size(refs).cast("long").alias("n"))


@query("""
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high,
  arg_min(event_id, ts || lpad(event_id::VARCHAR, 12, '0')) AS first_id, arg_max(event_id, ts || lpad(event_id::VARCHAR, 12, '0')) AS last_id FROM events GROUP BY event_type
""")
def stat_log_rollup(spark, sf_dir):
    order = F.struct("ts", "event_id")
    log = stats.StatLog().create("n", stats.count()).create("total", F.round(stats.total("value"), 4)).create("low", F.min("value")).create("high", F.max("value"))
    log.create("first_id", stats.first("event_id", order)).create("last_id", stats.last("event_id", order))
    return log.collect(table(spark, sf_dir, "events"), ["event_type"])


@query("""
SELECT 0 AS ord, 'Events' AS label, '' AS value UNION ALL SELECT 1, rpad('count', 30, '.'), count(*)::VARCHAR FROM events
UNION ALL SELECT 2, rpad('users', 30, '.'), count(DISTINCT user_id)::VARCHAR FROM events
""")
def stat_report(spark, sf_dir):
    log = stats.StatLog().heading("Events").create("n", stats.count(), "count").create("users", F.count_distinct("user_id"), "users")
    return log.report(table(spark, sf_dir, "events"))


@query("SELECT user_id, array_to_string(list(event_id ORDER BY event_id), ',') AS ids FROM events GROUP BY user_id")
def append_statistic(spark, sf_dir):
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(stats.appended("event_id", "event_id").alias("x"))
    return rows.select("user_id", F.array_join(F.transform("x", lambda v: v.cast("string")), ",").alias("ids"))


@query("SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id FROM events GROUP BY user_id, event_type")
def set_key_statistic(spark, sf_dir):
    maps = stats.keyed(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id", "event_id")
    return maps.select("user_id", F.explode("stat").alias("event_type", "event_id"))


@query("SELECT event_type, count(*) AS n, max(event_id) AS top FROM events GROUP BY event_type")
def merge_statistics(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    parts = [events.filter(f"event_id % 2 = {k}").groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("top")) for k in (0, 1)]
    return stats.merged(parts, ["event_type"], {"n": "count", "top": "max"})


@query("SELECT l_returnflag, count(*) AS n, count(*) * 100.0::DOUBLE / (SELECT count(*) FROM lineitem) AS percent FROM lineitem GROUP BY l_returnflag")
def grouped_percent_report(spark, sf_dir):
    return stats.percent_report(table(spark, sf_dir, "lineitem"), ["l_returnflag"], F.count("*"), "n")


@query("""
SELECT user_id, group_no, count(*) AS n, min(event_type) AS event_type FROM (
  SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS group_no FROM (
    SELECT *, CASE WHEN event_type IS NOT DISTINCT FROM lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AND row_number() OVER (PARTITION BY user_id ORDER BY event_id) > 1 THEN 0 ELSE 1 END AS new FROM events))
GROUP BY user_id, group_no
""")
def contiguous_groups(spark, sf_dir):
    from quillframe.operators.tree import contiguous_groups as runs

    return runs(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("event_type")).groupBy("user_id", "group_no").agg(F.count("*").alias("n"), F.min("event_type").alias("event_type"))


@query("SELECT p_partkey, p_brand AS brand, '' AS colour, p_name AS title FROM part")
def reorder_rename(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    s = schema.TableSchema.of(df)
    s.rename("p_name", "title")
    s.rename(3, "brand")
    s.move("brand", 2)
    renamed = df.toDF(*[{"p_name": "title", "p_brand": "brand"}.get(c, c) for c in df.columns])
    s.fields = [f for f in s.fields if f.name in ("p_partkey", "brand", "title")]
    s.append("colour")
    s.move("colour", 3)
    return s.project(renamed)


@query("SELECT p_partkey, pos - 1 AS pos, word FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part)")
def sub_fields(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(schema.sub_fields(F.col("p_name"), " ")).alias("pos", "word"))
    return rows.withColumn("pos", F.col("pos").cast("long"))


@query("SELECT p_partkey, upper(trim(p_name)) AS title, array_to_string(string_split(p_type, ' '), '/') AS kinds FROM part")
def post_process(spark, sf_dir):
    s = schema.TableSchema([schema.FieldDef("p_partkey"), schema.FieldDef("title", callback=F.upper), schema.FieldDef("kinds", splitter=" ", joiner="/")])
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), F.concat(F.lit("  "), "p_name", F.lit("\t")).alias("title"), F.col("p_type").alias("kinds"))
    return s.joined(s.post_process(rows)).withColumn("p_partkey", F.col("p_partkey").cast("long"))


@query("SELECT n_nationkey, 'n_name' AS name, n_name AS value FROM nation UNION ALL SELECT n_nationkey, 'n_regionkey', n_regionkey::VARCHAR FROM nation")
def records_as_maps(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    return df.select("n_nationkey", F.explode(schema.as_map(df, ["n_name", "n_regionkey"])).alias("name", "value"))


@query("""
SELECT rec_no, fld_no, ev_no, event, arg FROM (
  SELECT n_nationkey + 1 AS rec_no, 0 AS fld_no, 0 AS ev_no, 'Start' AS event, 'tr' AS arg FROM nation
  UNION ALL SELECT n_nationkey + 1, 1, 0, 'Start', 'td' FROM nation UNION ALL SELECT n_nationkey + 1, 1, 1, 'Text', n_name FROM nation UNION ALL SELECT n_nationkey + 1, 1, 2, 'End', 'td' FROM nation
  UNION ALL SELECT n_nationkey + 1, 2, 0, 'Start', 'td' FROM nation UNION ALL SELECT n_nationkey + 1, 2, 1, 'Text', n_regionkey::VARCHAR FROM nation UNION ALL SELECT n_nationkey + 1, 2, 2, 'End', 'td' FROM nation
  UNION ALL SELECT n_nationkey + 1, 3, 0, 'End', 'tr' FROM nation
  UNION ALL SELECT 0, 0, 0, 'Init', '' UNION ALL SELECT 0, 0, 1, 'Start', 'table' UNION ALL SELECT 4611686018427387904, 0, 0, 'End', 'table' UNION ALL SELECT 4611686018427387904, 0, 1, 'Fin', '')
""")
def event_stream(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).alias("rec_no"), "n_name", "n_regionkey")
    return schema.event_stream(df, "rec_no")


# --- writers -------------------------------------------------------------------------


@query("""
SELECT c_custkey, c_custkey::VARCHAR || ',' || c_name || ',' || CASE WHEN c_mktsegment LIKE '%,%' THEN '"' || c_mktsegment || '"' ELSE c_mktsegment END AS line FROM customer
""")
def csv_assemble(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", sinks.record(df, "csv", ["c_custkey", "c_name", "c_mktsegment"]).alias("line"))


@query("""
SELECT doc_id, '"' || replace(text, '"', '""') || '"' AS line FROM documents WHERE contains(text, ',') OR contains(text, '"') OR contains(text, chr(10)) OR regexp_matches(text, '^\\s|\\s$')
""")
def csv_quoting(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    return df.filter("contains(text, ',') or contains(text, '\"') or contains(text, '\n')").select("doc_id", sinks.record(df, "csv", ["text"]).alias("line"))


@query("""
SELECT n_nationkey, '<tr><td class="n_name">' || n_name || '</td><td class="n_regionkey">' || n_regionkey || '</td></tr>' AS xml,
  '<Rec n_name="' || n_name || '" n_regionkey="' || n_regionkey || '" />' AS xsv,
  '(tr (n_name "' || n_name || '") (n_regionkey ' || n_regionkey || '))' AS sexp,
  '  { "n_name"' || chr(9) || '=> "' || n_name || '", "n_regionkey"' || chr(9) || '=> ' || n_regionkey || ' },' AS perl,
  'n_name: ' || n_name || chr(10) || 'n_regionkey: ' || n_regionkey || chr(10) AS mime,
  '{ "n_name": "' || n_name || '", "n_regionkey": ' || n_regionkey || ' }' AS json,
  CASE WHEN contains(n_name, ' ') THEN '''' || n_name || '''' ELSE n_name END || ',' || n_regionkey AS arff FROM nation
""")
def assemble_all(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    columns = ["n_name", "n_regionkey"]
    return df.select("n_nationkey", *[sinks.record(df, f, columns).alias(f) for f in ("xml", "xsv", "sexp", "perl", "mime", "json", "arff")])


@query("SELECT n_nationkey, rtrim(rpad(n_nationkey::VARCHAR, 4, ' ') || rpad(n_name, 16, ' ') || rpad(n_regionkey::VARCHAR, 4, ' ')) AS line FROM nation")
def columns_assemble(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    return df.select("n_nationkey", sinks.record(df, "columns", ["n_nationkey", "n_name", "n_regionkey"], positions=[0, 4, 20]).alias("line"))


# --- readers, on texts made from the tables ------------------------------------------


def _round_trip(spark, sf_dir, fmt, **options):
    df = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 1).cast("long").alias("rec_no"), F.col("n_nationkey").cast("string").alias("id"), "n_name", F.col("n_regionkey").cast("string").alias("region"))
    doc = sinks.assembled(df, fmt, "rec_no", **options).select(F.lit("nation").alias("src"), "value")
    extra = {"field_names": ["id", "n_name", "region"]} if fmt == "columns" else {}
    return readers.parse_table(doc, fmt, **options, **extra).select(F.col("id").cast("int").alias("id"), "n_name", F.col("region").cast("int").alias("region"))


def _reader_query(fmt, **options):
    def plan(spark, sf_dir):
        return _round_trip(spark, sf_dir, fmt, **options)

    plan.__name__ = f"read_{fmt}"
    query("SELECT n_nationkey AS id, n_name, n_regionkey AS region FROM nation")(plan)


for _fmt, _options in (
    ("arff", {}), ("columns", {"positions": [0, 6, 40]}), ("csv", {}), ("json", {}), ("manchester", {}), ("mime", {}), ("perl", {}), ("sexp", {}), ("xml", {}), ("xsv", {}),
):
    _reader_query(_fmt, **_options)


@query("SELECT 'html' AS format, count(*) AS n FROM pages UNION ALL SELECT 'json', count(*) FROM events")
def sniff_format(spark, sf_dir):
    heads = table(spark, sf_dir, "pages").select(F.substring("html", 1, 2000).alias("head")).unionByName(table(spark, sf_dir, "events").select(F.col("props").alias("head")))
    return heads.select(readers.sniff_format(F.col("head")).alias("format")).groupBy("format").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, ';' AS delimiter FROM customer")
def sniff_delimiter(spark, sf_dir):
    line = F.concat_ws(";", F.col("c_custkey").cast("string"), F.lit('"a,b,c,d,e"'), F.col("c_mktsegment"), F.lit("x"), F.lit("y"))
    return table(spark, sf_dir, "customer").select("c_custkey", readers.sniff_delimiter(line).alias("delimiter"))


@query("SELECT doc_id, (length(text) - length(replace(text, '\"', ''))) % 2 = 0 AS balanced FROM documents")
def quotes_balanced(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", readers.quotes_balanced(F.col("text")).alias("balanced"))


@query(r"SELECT doc_id, len(list_filter(string_split(regexp_replace(text, '\n$', ''), chr(10)), lambda l: NOT regexp_matches(l, '^\s*$'))) AS n FROM documents WHERE text <> ''")
def physical_lines(spark, sf_dir):
    rows = readers.lines(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("src"), F.col("text").alias("value")))
    counts = readers.real_lines(rows, "").groupBy(F.col("src").alias("doc_id")).agg(F.count("*").alias("n"))
    docs = table(spark, sf_dir, "documents").filter("text <> ''").select("doc_id")
    return docs.join(counts, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT o_orderkey, 'k' || (o_orderkey % 7) AS k, o_orderkey % 5 AS v FROM orders")
def balanced_scan(spark, sf_dir):
    text = F.concat(F.lit("x (a (k"), (F.col("o_orderkey") % 7).cast("string"), F.lit(") ')' "), (F.col("o_orderkey") % 5).cast("string"), F.lit(") y"))
    from quillframe.sources.scanner import balanced_records

    rows = balanced_records(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("src"), text.alias("value")), openers="(", closers=")")
    return rows.select(F.col("src").cast("long").alias("o_orderkey"), F.regexp_extract("value", r"\((k\d)\)", 1).alias("k"), F.regexp_extract("value", r"(\d)\)$", 1).cast("long").alias("v"))


# --- every text of documents, written as a record of a syntax and read again ----------


def _text_round_trip(fmt, head="", tail="", sql="text", **options):
    def plan(spark, sf_dir):
        df = table(spark, sf_dir, "documents").select("doc_id", "text")
        written = df.select(F.col("doc_id").cast("string").alias("src"), F.concat(F.lit(head), sinks.record(df, fmt, ["doc_id", "text"], **options), F.lit(tail)).alias("value"))
        names = {} if fmt in ("xsv", "arff") else {"field_names": ["Id", "text"] if fmt == "manchester" else ["doc_id", "text"]}
        rows = readers.parse_table(written, fmt, **options, **names)
        return rows.select(F.col("src").cast("long").alias("doc_id"), "text")

    plan.__name__ = f"text_through_{fmt}"
    query(f"SELECT doc_id, {sql} AS text FROM documents")(plan)


for _fmt, _around in (
    ("csv", {"escape": "\\", "header": False, "comment": ""}), ("json", {}), ("manchester", {}), ("perl", {"head": "my @x = (\n", "tail": "\n);"}), ("sexp", {}),
    ("arff", {"head": "@RELATION r\n@ATTRIBUTE doc_id STRING\n@ATTRIBUTE text STRING\n@DATA\n"}), ("xml", {"sql": "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"}),
    ("mime", {"sql": "regexp_replace(regexp_replace(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g'), '^\\s+', ''), '\\s+$', '')", "line_length": 1_000_000}),
    ("xsv", {"head": '<Xsv>\n<Head doc_id="" text="">\n', "tail": "\n</Head>\n</Xsv>"}),
):
    _text_round_trip(_fmt, **_around)


#: Countries by region as tables of two fields, in SQL: the events of each record and of each table.
_FIELDS = "SELECT n_regionkey::VARCHAR AS src, (n_nationkey + 1)::BIGINT AS rec_no, n_name, n_nationkey::VARCHAR AS n_comment FROM nation"


@query(f"""
SELECT src, rec_no, fld_no, ev_no, event, arg FROM (
  SELECT src, rec_no, 0 AS fld_no, 0 AS ev_no, 'Start' AS event, 'tr' AS arg FROM ({_FIELDS}) UNION ALL SELECT src, rec_no, 3, 0, 'End', 'tr' FROM ({_FIELDS})
  UNION ALL SELECT src, rec_no, unnest([1, 1, 1, 2, 2, 2]), unnest([0, 1, 2, 0, 1, 2]), unnest(['Start', 'Text', 'End', 'Start', 'Text', 'End']), unnest(['td', n_name, 'td', 'td', n_comment, 'td']) FROM ({_FIELDS})
  UNION ALL SELECT DISTINCT src, 0, 0, unnest([0, 1]), unnest(['Init', 'Start']), unnest(['', 'table']) FROM (SELECT DISTINCT src FROM ({_FIELDS}))
  UNION ALL SELECT DISTINCT src, 4611686018427387904, 0, unnest([0, 1]), unnest(['End', 'Fin']), unnest(['table', '']) FROM (SELECT DISTINCT src FROM ({_FIELDS})))
""")
def table_events_sql(spark, sf_dir):
    """The pull view called from SQL: each region is a table of its countries."""
    pull.register(spark)
    nation = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("string").alias("src"), (F.col("n_nationkey") + 1).cast("long").alias("rec_no"), "n_name", "n_nationkey")
    return spark.sql("SELECT * FROM table_events(TABLE({rows}) PARTITION BY (src) ORDER BY (rec_no), 'src', 'rec_no')", rows=nation)


@query("""
SELECT c_nationkey AS doc_id, '<table>' || string_agg('<tr><td class="c_name">' || c_name || '</td><td class="c_mktsegment">' || c_mktsegment || '</td></tr>', '' ORDER BY c_custkey) || '</table>' AS markup
FROM customer GROUP BY c_nationkey
""")
def table_nodes_sql(spark, sf_dir):
    """The tree view called from SQL: the customers of each country as a table, written as markup."""
    pull.register(spark)
    rows = table(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("doc"), "c_custkey", "c_name", "c_mktsegment")
    return tree.serialized(spark.sql("SELECT * FROM table_nodes(TABLE({rows}) PARTITION BY (doc) ORDER BY (c_custkey), 'doc', 'c_custkey')", rows=rows))


@query("""
SELECT event_type, count(*) AS n, round(sum(value), 4) AS total, min(value) AS low, max(value) AS high, arg_min(user_id, event_id) AS first_user, arg_max(user_id, event_id) AS last_user,
  round(avg(value), 6) AS mean, true AS users_near, true AS median_near FROM events GROUP BY event_type
""")
def stored_statistics(spark, sf_dir):
    """States of eight batches and each type of event, stored, read and merged by type; the sketches are held against exact figures."""
    events, path = table(spark, sf_dir, "events"), scratch(spark)
    log = partial.PartialLog().create("n", partial.count()).create("total", partial.total("value")).create("low", partial.least("value")).create("high", partial.greatest("value"))
    log.create("first_user", partial.first("user_id", "event_id")).create("last_user", partial.last("user_id", "event_id")).create("mean", partial.mean("value"))
    log.create("users", partial.distinct("user_id")).create("median", partial.quantile("value", 0.5))
    log.states(events.withColumn("batch", F.col("event_id") % 8), ["batch", "event_type"]).write.parquet(path)
    got = log.finished(log.merged(spark.read.parquet(path), ["event_type"]))
    exact = events.groupBy("event_type").agg(F.count_distinct("user_id").alias("_users"))
    below = events.join(got.select("event_type", "median"), "event_type").groupBy("event_type").agg(F.avg((F.col("value") <= F.col("median")).cast("int")).alias("_rank"))
    rows = got.join(exact, "event_type").join(below, "event_type")
    near = (F.abs(F.col("users") / F.col("_users") - 1) < 0.07).alias("users_near"), (F.abs(F.col("_rank") - 0.5) < 0.03).alias("median_near")
    return rows.select("event_type", "n", F.round("total", 4).alias("total"), "low", "high", "first_user", "last_user", F.round("mean", 6).alias("mean"), *near)
