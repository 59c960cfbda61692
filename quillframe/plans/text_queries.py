"""Tokenizing, folding and counting text."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.functions import scalars, udfs
from quillframe.operators import entities, stats, tokens
from quillframe.plans.registry import query
from quillframe.plans.session import table


@query(r"""
SELECT lang, token, n FROM (
  SELECT lang, token, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, token) AS rk FROM (
    SELECT lang, token, count(*) AS n FROM (
      SELECT lang, unnest(string_split_regex(
        regexp_replace(regexp_replace(regexp_replace(text, '\p{Pd}', '-', 'g'), '[\p{Pi}\p{Pf}]', '''', 'g'), '\s+', ' ', 'g'), ' ')) AS token
      FROM documents) WHERE length(token) >= 2 GROUP BY lang, token)) WHERE rk <= 20
""")
def word_count_top(spark, sf_dir):
    """The 20 most frequent tokens of each language, dashes and quotes folded."""
    clean = F.col("text")
    for pattern, into in ((r"\p{Pd}", "-"), (r"[\p{Pi}\p{Pf}]", "'"), (r"\s+", " ")):
        clean = F.regexp_replace(clean, pattern, into)
    counts = stats.token_counts(table(spark, sf_dir, "documents"), F.filter(F.split(clean, " "), lambda t: F.length(t) >= 2), ["lang"])
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "token"))
    return counts.withColumn("rk", rank).filter("rk <= 20").drop("rk")


@query(r"""
SELECT lang, sum(length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')))::BIGINT AS upper_letters,
  sum(length(text) - length(regexp_replace(text, '\p{Ll}', '', 'g')))::BIGINT AS lower_letters,
  sum(length(text) - length(regexp_replace(text, '\p{Nd}', '', 'g')))::BIGINT AS digits,
  sum(length(text) - length(regexp_replace(text, '\p{P}', '', 'g')))::BIGINT AS marks,
  sum(length(text) - length(regexp_replace(text, '\p{Z}', '', 'g')))::BIGINT AS blanks FROM documents GROUP BY lang
""")
def char_class_profile(spark, sf_dir):
    count = lambda p: F.sum(F.length("text") - F.length(F.regexp_replace("text", p, "")))
    names = {"upper_letters": r"\p{Lu}", "lower_letters": r"\p{Ll}", "digits": r"\p{Nd}", "marks": r"\p{P}", "blanks": r"\p{Z}"}
    return table(spark, sf_dir, "documents").groupBy("lang").agg(*[count(p).cast("long").alias(n) for n, p in names.items()])


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS clean FROM documents")
def normalize_space(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", scalars.normalize_space(F.col("text")).alias("clean"))


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\p{Pd}', '-', 'g'), '[‘’‚‛‹›]', '''', 'g'), '[\p{Pi}\p{Pf}„‟]', '"', 'g'), '\p{Z}', ' ', 'g') AS folded
FROM documents
""")
def fold_dashes_quotes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokens.simplify(F.col("text"), accents="keep", ligatures=False).alias("folded"))


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def strip_accents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", udfs.stripped_marks(F.col("text")).alias("plain"))


def _nested(start: str, steps: list[str]) -> str:
    """One SQL call around another."""
    for step in steps:
        start = step.format(start)
    return start


_PAIRS = [f"replace({{}}, '{whole}', '{parts}')" for whole, parts in tokens.LETTER_PAIRS.items()]
_MARKS = [f"regexp_replace({{}}, '{p}', '{r}', 'g')" for p, r in ((r"\p{{Pd}}", "-"), ("[‘’‚‛‹›]", "''"), (r"[\p{{Pi}}\p{{Pf}}„‟]", '"'), (r"\p{{Z}}", " "))]
#: Letters and digits whose runs the SQL shortens one after another; it has no references back.
_RUNS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_áéíóúñäöüßçèêàùâîôûëïœæÁÉÍÓÚÑÄÖÜÇÈÊÀ"


@query(f"SELECT doc_id, {_nested('strip_accents(text)', _PAIRS + _MARKS)} AS plain FROM documents")
def simplify_unicode(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokens.simplify(F.col("text")).alias("plain"))


@query(f"SELECT doc_id, {_nested('text', [f"regexp_replace({{}}, '{c}{{{{3,}}}}', '{c}{c}', 'g')" for c in _RUNS] + [r"regexp_replace({}, '[ \t\n\r\f\v]{{2,}}', ' ', 'g')"])} AS short FROM documents")
def shorten_runs(spark, sf_dir):
    o = tokens.TokenOptions(n_char=2, n_space=2)
    return table(spark, sf_dir, "documents").select("doc_id", tokens.shorten(F.col("text"), o).alias("short"))


_TIMES = r"\b[0-2]?[0-9]:[0-5][0-9](?::[0-5][0-9])?(?: ?[ap]\.?m\.?)?(?: ?[ECMP][SD]T)?"


@query(r"""
SELECT doc_id,
  len(regexp_extract_all(text, '\b[0-2]?[0-9]:[0-5][0-9](?::[0-5][0-9])?(?: ?[ap]\.?m\.?)?(?: ?[ECMP][SD]T)?')) AS times,
  len(regexp_extract_all(text, '\b(?:[0-9]+-)?[0-9]+/[0-9]+\b|[\x{00BC}-\x{00BE}\x{2150}-\x{215F}\x{2189}]')) AS fractions,
  len(regexp_extract_all(text, '\b[0-9]+(?:\.[0-9]+)?[%\x{2030}\x{2031}\x{066A}\x{FE6A}\x{FF05}]')) AS percents,
  len(regexp_extract_all(text, '[-:;]+[(){}<>]')) AS emoticons,
  len(regexp_extract_all(text, '#[\p{L}]+')) AS hashtags,
  len(regexp_extract_all(text, '\b[0-9A-Za-z_]+@[0-9A-Za-z_]+(?:\.[0-9A-Za-z_]+)+')) AS emails,
  len(regexp_extract_all(text, '\b(?:shttp|https|http|ftp|mailto)://[-~?\[\]()&@+0-9A-Za-z_.:/$#]+[0-9A-Za-z_]')) AS uris
FROM documents
""")
def nonword_extract(spark, sf_dir):
    counts = tokens.non_word_counts(F.col("text"))
    names = {"times": "T_TIME", "fractions": "T_FRACTION", "percents": "T_PERCENT", "emoticons": "T_EMOTICON", "hashtags": "T_HASHTAG", "emails": "T_EMAIL", "uris": "T_URI"}
    return table(spark, sf_dir, "documents").select("doc_id", *[counts[t].cast("long").alias(n) for n, t in names.items()])


@query(r"""
SELECT page_id, regexp_replace(regexp_replace(url, '#[\p{L}]+', '#nine', 'g'), '\b(?:shttp|https|http|ftp|mailto)://[-~?\[\]()&@+0-9A-Za-z_.:/$#]+[0-9A-Za-z_]', 'http://www.example.com', 'g') AS unified FROM pages
""")
def nonword_unify(spark, sf_dir):
    o = tokens.TokenOptions(non_word={"T_HASHTAG": "unify", "T_URI": "unify"})
    return table(spark, sf_dir, "pages").select("page_id", tokens.non_word_tokens(F.col("url"), o).alias("unified"))


@query(r"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\p{Lu}', 'A', 'g'), '\p{Ll}', 'a', 'g'), '\p{Nd}', '9', 'g'), '\p{P}', '', 'g') AS shape FROM documents
""")
def unify_categories(spark, sf_dir):
    o = tokens.TokenOptions(categories={"Lu": "unify", "Ll": "unify", "Nd": "unify", "P": "delete"}, nbsp="keep", soft_hyphen="keep")
    return table(spark, sf_dir, "documents").select("doc_id", tokens.normalize(F.col("text"), o).alias("shape"))


@query(r"""
SELECT conv_id, turn, len(f) AS kept, f[1] AS first FROM (
  SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'),
    lambda t: t <> '' AND length(t) >= 3 AND length(t) <= 12 AND NOT regexp_matches(t, '^\s+$') AND NOT regexp_matches(t, '^\p{Lu}+$') AND NOT regexp_matches(t, '^\p{Lu}\p{Ll}+$')) AS f FROM conversations)
""")
def token_filter_by_case(spark, sf_dir):
    o = tokens.TokenOptions(min_length=3, max_length=12, drop_upper=True, drop_title=True)
    kept = tokens.filter_tokens(F.split("text", r"\s+"), o)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", kept.alias("f")).select("conv_id", "turn", F.size("f").cast("long").alias("kept"), F.get("f", F.lit(0)).alias("first"))


@query(r"""
WITH words AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS token FROM documents),
dict AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS token FROM benchmark)
SELECT token, count(*) AS n FROM words w WHERE token <> '' AND NOT EXISTS (SELECT 1 FROM dict d WHERE d.token = w.token) GROUP BY token
""")
def dict_removal(spark, sf_dir):
    split = lambda t: table(spark, sf_dir, t).select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("token")).filter("token <> ''")
    left = tokens.without_dictionary(split("documents"), "token", split("benchmark"), "token")
    return left.groupBy("token").agg(F.count("*").alias("n"))


@query()
def tokenize_documents(spark, sf_dir):
    """All stages: escapes off, contractions and genitives on."""
    o = tokens.TokenOptions(contractions=True, genitive=True, n_space=2, non_word={"T_EMAIL": "unify", "T_URI": "unify"})
    rows = table(spark, sf_dir, "documents").select("doc_id", tokens.tokenize(F.col("text"), o).alias("tokens"))
    return rows.select("doc_id", F.size("tokens").alias("n_tokens"), F.array_join("tokens", " ").alias("tokens"))


@query(r"""
SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(text, '--+', ' -- ', 'g'), '\s+'), lambda t: t <> '')) AS n_tokens FROM documents
""")
def token_count(spark, sf_dir):
    split = F.split(F.regexp_replace("text", "--+", " -- "), r"\s+")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(split, lambda t: t != "")).cast("long").alias("n_tokens"))


@query("SELECT item_id, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS pos FROM benchmark")
def char_tokens(spark, sf_dir):
    o = tokens.TokenOptions(token_type="chars")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(tokens.split_tokens(F.col("text"), o)).alias("k", "ch"))
    return rows.select("item_id", "ch", (F.col("k") + 1).cast("long").alias("pos"))


_C1 = "".join(chr(0x80 + k) for k in range(32))


@query(f"SELECT doc_id, translate(text, '{_C1}', '{''.join('?' if c == ' ' else c for c in tokens.CP1252)}') AS repaired FROM documents")
def cp1252_repair(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokens.cp1252_repair(F.col("text")).alias("repaired"))


@query(r"""
SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]', '', 'g') AS ascii_text FROM documents
""")
def ascii_only(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", tokens.normalize(F.col("text"), tokens.TokenOptions(ascii_only=True)).alias("ascii_text"))


@query(r"""
SELECT source, count(*) AS n, sum(length(text))::BIGINT AS chars, sum(strlen(text))::BIGINT AS bytes, max(length(text)) AS longest FROM documents GROUP BY source
""")
def source_profile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("source").agg(
        F.count("*").alias("n"), F.sum(scalars.length_in_chars(F.col("text"))).alias("chars"), F.sum(scalars.length_in_bytes(F.col("text"))).alias("bytes"), F.max(F.length("text")).cast("long").alias("longest")
    )


#: A subset with the row's own values: an entity in an entity, a parameter entity that brings a declaration, one defined twice, two in a circle.
_SUBSET = ("<!ENTITY src \"", "\"><!ENTITY % decl '<!ENTITY who \"&src; in &lng;\">'> %decl; <!ENTITY lng \"", "\"><!ENTITY src \"other\"><!ENTITY one \"&two;\"><!ENTITY two \"&one;\">")


@query("""
SELECT doc_id, 'A ' || source || ' in ' || coalesce(lang, 'none') || ' & B ' || CASE WHEN doc_id % 3 = 0 THEN '&one;' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN '&none;' ELSE '' END AS expanded, 2 AS depth,
  CASE WHEN doc_id % 3 = 0 THEN 'CYCLE one,CYCLE two' ELSE '' END || CASE WHEN doc_id % 3 = 0 AND doc_id % 5 = 0 THEN ',' ELSE '' END || CASE WHEN doc_id % 5 = 0 THEN 'UNDEFINED none' ELSE '' END AS errors
FROM documents
""")
def document_entities(spark, sf_dir):
    """Every document with definitions of its own; circles and unknown names are reported."""
    docs = table(spark, sf_dir, "documents")
    subset = F.concat(F.lit(_SUBSET[0]), "source", F.lit(_SUBSET[1]), F.coalesce("lang", F.lit("none")), F.lit(_SUBSET[2]))
    text = F.concat(F.lit("&#65; &who; &amp; B "), F.when(F.col("doc_id") % 3 == 0, "&one;").otherwise(""), F.when(F.col("doc_id") % 5 == 0, "&none;").otherwise(""))
    found = entities.expanded_documents(docs.select("doc_id", subset.alias("subset"), text.alias("text")), "subset", "text")
    return found.withColumn("errors", F.array_join(F.transform("errors", lambda e: F.concat_ws(" ", e["code"], e["name"])), ","))
