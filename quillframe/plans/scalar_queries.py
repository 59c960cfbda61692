"""Scalar functions and type checks over table columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillframe.functions import datatypes, scalars
from quillframe.plans.registry import query
from quillframe.plans.session import table


@query("SELECT p_partkey, upper(p_name[1:1]) || lower(p_name[2:]) AS shown FROM part")
def sentence_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.sentence_case(F.col("p_name"), True).alias("shown"))


@query("""
SELECT p_partkey, array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || w[2:]), ' ') AS shown FROM part
""")
def title_case(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.title_case(F.col("p_name")).alias("shown"))


@query("""
SELECT c_custkey, CASE WHEN length(c_custkey::VARCHAR) < 4 THEN lpad(c_custkey::VARCHAR, 4, '0') ELSE c_custkey::VARCHAR END AS left_padded,
  CASE WHEN length(c_name) < 24 THEN rpad(c_name, 24, '.') ELSE c_name END AS right_padded,
  repeat(' ', greatest(0, floor((24 - length(c_name)) / 2))::INT) || c_name || repeat(' ', greatest(0, ceil((24 - length(c_name)) / 2))::INT) AS centred FROM customer
""")
def pad(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", scalars.lpad(F.col("c_custkey"), 4).alias("left_padded"), scalars.rpad(F.col("c_name"), 24, ".").alias("right_padded"), scalars.cpad(F.col("c_name"), 24).alias("centred")
    )


@query("""
SELECT doc_id, CASE WHEN n >= 1048576 THEN 'M' WHEN n >= 1024 THEN 'K' ELSE '' END AS unit,
  round(CASE WHEN n >= 1048576 THEN n / 1048576.0 WHEN n >= 1024 THEN n / 1024.0 ELSE n END, 6)::DOUBLE AS amount FROM (SELECT doc_id, strlen(text) AS n FROM documents)
""")
def human_number(spark, sf_dir):
    value, unit = scalars.human_scale(F.octet_length("text"))
    return table(spark, sf_dir, "documents").select("doc_id", unit.alias("unit"), F.round(value, 6).alias("amount"))


@query(r"""
SELECT event_id, regexp_matches(v, '^\s*[-+]?\d+(\.\d+)?([Ee][-+]?\d+)?\s*$') AS is_number, regexp_matches(v, '^\s*[-+]?\d+\s*$') AS is_whole,
  regexp_matches(event_type, '^\p{Lu}') AS is_upper, regexp_matches(event_type, '^\p{Ll}') AS is_lower FROM (SELECT *, json_extract_string(props, '$.k') AS v FROM events)
""")
def value_tests(spark, sf_dir):
    v = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.is_numeric(v).alias("is_number"), scalars.is_integer(v).alias("is_whole"), scalars.is_upper(F.col("event_type")).alias("is_upper"), scalars.is_lower(F.col("event_type")).alias("is_lower")
    )


@query(r"""
SELECT 'byte' AS type, count(*) FILTER (WHERE TRY_CAST(v AS INT) BETWEEN -128 AND 127) AS good, count(*) AS n FROM (SELECT json_extract_string(props, '$.k') AS v FROM events)
UNION ALL SELECT 'positiveInteger', count(*) FILTER (WHERE TRY_CAST(v AS INT) >= 1), count(*) FROM (SELECT json_extract_string(props, '$.k') AS v FROM events)
UNION ALL SELECT 'anyURI', count(*) FILTER (WHERE regexp_matches(url, '^[^\s<>"{}|\\^`]*$')), count(*) FROM pages
UNION ALL SELECT 'ENUM', count(*) FILTER (WHERE event_type IN ('click', 'view')), count(*) FROM events
""")
def type_check_report(spark, sf_dir):
    events, pages = table(spark, sf_dir, "events").withColumn("v", F.get_json_object("props", "$.k")), table(spark, sf_dir, "pages")
    checks = ((events, "v", "byte!"), (events, "v", "positiveInteger!"), (pages, "url", "anyURI!"), (events, "event_type", "ENUM(click view)!"))
    out = None
    for df, column, spec in checks:
        name = datatypes.parse_spec(spec).name
        row = df.agg(F.count_if(datatypes.conforms(F.col(column), spec)).alias("good"), F.count("*").alias("n")).select(F.lit(name).alias("type"), "good", "n")
        out = row if out is None else out.unionByName(row)
    return out


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '0' ELSE '1' END AS flag, p_size::VARCHAR AS size_text FROM part
""")
def normalize_types(spark, sf_dir):
    flag = F.when(F.col("p_size") % 3 == 0, "false").otherwise("true")
    size = F.concat(F.lit("0x"), F.hex("p_size"))
    return table(spark, sf_dir, "part").select("p_partkey", datatypes.normalized(flag, "boolean").alias("flag"), datatypes.normalized(size, "BASEINT").alias("size_text"))


@query("""
SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), ']]>', ']]&gt;') AS content,
  replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '"', '&quot;') AS attribute FROM pages
""")
def xml_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.escape_xml_content(F.col("html")).alias("content"), scalars.escape_xml_attribute(F.col("url")).alias("attribute"))


@query("""
SELECT page_id, replace(replace(replace(replace(replace(html, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&apos;', ''''), '&amp;', '&') AS plain FROM pages
""")
def xml_unescape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.unescape_xml(F.col("html")).alias("plain"))


@query(r"SELECT page_id, regexp_replace(url, '([().?*+\\\[\]{}^$|])', '\\\1', 'g') AS pattern FROM pages")
def regex_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.escape_regex(F.col("url")).alias("pattern"))


@query("SELECT page_id, url_decode(replace(url, '+', '%2B')) AS plain FROM pages")
def uri_unescape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.unescape_uri(F.col("url")).alias("plain"))


@query("SELECT page_id, url_encode(url) AS coded FROM pages")
def uri_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.escape_uri(F.col("url")).alias("coded"))


@query(r"""
SELECT page_id, regexp_extract(url, '^(.*/)?([^/]*?)(?:\.([^/.]*))?$', 1) AS dir, regexp_extract(url, '^(.*/)?([^/]*?)(?:\.([^/.]*))?$', 2) AS base,
  regexp_extract(url, '^(.*/)?([^/]*?)(?:\.([^/.]*))?$', 3) AS ext FROM pages
""")
def path_split(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", scalars.split_path(F.col("url")).alias("p")).select("page_id", "p.*")


@query("""
SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%Y-%m-%d') AS day,
  printf('%02d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS since_midnight FROM (SELECT *, floor(epoch(ts))::BIGINT % 86400 AS s FROM events)
""")
def date_formats(spark, sf_dir):
    at = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        "event_id", scalars.iso_time(at).alias("iso"), scalars.iso_date(at).alias("day"), scalars.elapsed(F.lit(0), at % 86400).alias("since_midnight")
    )


@query("SELECT p_partkey, coalesce(p_name[2:5], '') AS part_of FROM part")
def safe_substring(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.safe_substring(F.col("p_name"), 1, 4).alias("part_of"))


@query("SELECT p_partkey, printf('%%%02x', 33 + p_size % 90) AS bytes FROM part")
def utf8_bytes(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.utf8_bytes(33 + F.col("p_size") % 90).alias("bytes"))


@query("SELECT doc_id, text AS plain, length(text) AS n FROM documents")
def uncolor(spark, sf_dir):
    colored = scalars.colorize(F.col("text"), "red/blue/bold")
    return table(spark, sf_dir, "documents").select("doc_id", scalars.uncolored(colored).alias("plain"), scalars.uncolored_length(colored).cast("long").alias("n"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")
def json_field(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""
SELECT c_custkey, rpad(c_mktsegment, 12, ' ') AS l, lpad(c_mktsegment, 12, ' ') AS r, lpad(c_custkey::VARCHAR, 12, ' ') AS a FROM customer
""")
def align_fields(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey", scalars.align(F.col("c_mktsegment"), 12, "L").alias("l"), scalars.align(F.col("c_mktsegment"), 12, "R").alias("r"), scalars.align(F.col("c_custkey"), 12, "A").alias("a")
    )


@query(r"SELECT p_partkey, CASE WHEN regexp_matches(n, '^[\p{L}_:]') THEN n ELSE '_' || n END AS name FROM (SELECT p_partkey, regexp_replace(p_name, '[^\p{L}\p{M}\p{N}_:.-]', '_', 'g') AS n FROM part)")
def make_xml_name(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.make_xml_name(F.col("p_name")).alias("name"))


@query("SELECT p_partkey, p_size BETWEEN 0 AND 1114111 AND p_size NOT BETWEEN 128 AND 159 AS ok, CASE WHEN p_size < 48 THEN 0 ELSE 95 END AS level FROM part")
def code_point_test(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", scalars.is_code_point(F.col("p_size")).alias("ok"), scalars.nearest_cube_level(F.col("p_size")).alias("level"))
