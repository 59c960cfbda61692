"""Secret scans: candidate strings, scored by a random forest that removes false positives.

Candidates are parts of words: names with values (also in compact JSON and query strings)
and tokens. Parts of ``LEAST`` characters or more are taken if they look machine-made (they
hold a digit, or capitals within), values of a secret's name from ``NAMED_LEAST`` on. Features: length, shares of character classes, transitions
between classes, the mean log-probability of the candidate's letter pairs and the share
of its letter triples found in dictionary words (both from the distinct plain-letter words
of the whole corpus, folded to 26 letters; no candidate with a digit or capitals within is one), the path (here the source), and the neighbouring words.

The forest learns from labelled findings: a table (doc_id, place, label) if one is given,
else findings labelled by ``by_rule`` (a value assigned to a name for secrets). At most
``TRAIN`` findings are learnt from, in hash order; scoring covers all.

Defined cases: null text has no candidates; a null source is the empty path; findings
are numbered by word and part of the word, so repeated candidates stay apart (a table of
labels without ``part`` labels all parts of a word); repeated rows repeat their
findings; without findings of both labels the score is the rule's label; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillframe.llm.common import saved, table

LEAST, NAMED_LEAST, TRAIN, TREES, DEPTH, SEED, KEEP = 12, 6, 4000, 24, 6, 17, 0.5
#: A letter triple is known if it is in this many of a million distinct dictionary words, and in two at least.
KNOWN = 100
#: A dictionary word: letters only, but for punctuation around it.
PLAIN, CAMEL = r"^[(\[\"'«„“]*\p{L}+[.,;:!?)\]\"'»“”]*$", r"\p{Ll}\p{Lu}"
SPACE = r"[\x20\x09-\x0D]+"
SECRET_NAME = r"(?i)(token|secret|passw|api_?key|access_?key|private_?key|credential|auth|bearer)"
#: Parts of a word: name and value (of any quotes), a token with the quote before it, or what lies between.
NAMED = r"[\"'`]?([A-Za-z_][A-Za-z0-9_.-]*)[\"'`]?[=:]+[\"'`]*([^\"'`&;,?<>{}()\[\]]+)"
PART = NAMED + r"|[\"'`]?[^\"'`&;,?<>{}()\[\]=:]+=*|[\"'`&;,?<>{}()\[\]=:]"
FEATURES = (
    "length", "digits", "capitals", "lower", "other", "hexadecimal", "distinct", "changes", "pair_logp", "known_share",
    "path_depth", "path_length", "path_is_test", "quoted", "assigned", "named", "before_known", "after_known",
)


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, path, place, part, raw, value, two words before, one after) for each candidate; place counts words, part the parts of a word, both from 0."""
    words = F.split(F.coalesce("text", F.lit("")), SPACE)
    machine = lambda w: (F.length(w) >= LEAST) & w.rlike(r"[0-9]|[a-z][A-Z]")
    word_at = lambda i: F.coalesce(F.get("words", i), F.lit(""))
    # a value some words after its name: name = value, name: value
    after_name = lambda b2, b1: b1.rlike("[=:][\"'`]?$") & (b1.rlike(SECRET_NAME) | b2.rlike(SECRET_NAME))
    wanted = lambda i: machine(word_at(i)) | word_at(i).rlike(SECRET_NAME + "[^=:]*[=:]") | ((F.length(word_at(i)) >= NAMED_LEAST) & after_name(word_at(i - 2), word_at(i - 1)))
    at = F.filter(F.sequence(F.lit(0), F.size("words") - 1), wanted)
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("path"), words.alias("words"))
    rows = rows.select("doc_id", "path", "words", F.explode(at).alias("place"))
    near = lambda k: word_at(F.col("place") + k)
    rows = rows.select("doc_id", "path", "place", near(0).alias("word"), near(-2).alias("before2"), near(-1).alias("before1"), near(1).alias("after1"))
    rows = rows.select("doc_id", "path", "place", F.posexplode(F.regexp_extract_all("word", F.lit(PART), F.lit(0))).alias("part", "piece"), "before2", "before1", "after1")
    # name=value and name:value in one word: the name goes to the words before
    name, inner = (F.regexp_extract("piece", "^" + NAMED + "$", k) for k in (1, 2))
    rows = rows.withColumn("name", name).withColumn("raw", F.when(F.col("name") != "", inner).otherwise(F.col("piece")))
    rows = rows.withColumn("before2", F.when(F.col("name") != "", F.col("name")).otherwise(F.col("before2")))
    rows = rows.withColumn("before1", F.when(F.col("name") != "", F.lit("=")).otherwise(F.col("before1")))
    rows = rows.withColumn("value", F.regexp_replace("raw", r"^[^A-Za-z0-9]+|[^A-Za-z0-9=]+$", ""))
    held = machine(F.col("value")) | ((F.length("value") >= NAMED_LEAST) & after_name(F.col("before2"), F.col("before1")))
    return rows.filter(held).drop("name", "piece")


def _fold(word: Column) -> Column:
    """Lower-case ASCII letters, everything else one stop."""
    return F.regexp_replace(F.lower(word), "[^a-z]+", "_")


def corpus_letters(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts of letter pairs, and the known letter triples, over the distinct dictionary words; how often a word occurs does not matter."""
    words = docs.select(F.explode(F.split("text", SPACE)).alias("word")).filter(F.col("word").rlike(PLAIN) & ~F.col("word").rlike(CAMEL))
    words = saved(words.select(F.concat(F.lit("_"), F.regexp_replace(_fold(F.col("word")), "^_+|_+$", ""), F.lit("_")).alias("w")).distinct())
    grams = lambda k: F.transform(F.sequence(F.lit(1), F.length("w") - k + 1), lambda i: F.substr(F.col("w"), i, F.lit(k)))
    pairs = words.filter(F.length("w") >= 2).select(F.explode(grams(2)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    least = max(2, words.count() * KNOWN / 1e6)
    triples = words.filter(F.length("w") >= 3).select(F.explode(F.array_distinct(grams(3))).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    return pairs, triples.filter(F.col("n") >= least).select("gram")


def _literals(docs: DataFrame) -> tuple[Column, Column]:
    """Pair log-probabilities (27 x 27) and known triples (27 x 27 x 27) as literals: bounded by the alphabet."""
    from math import log

    letters = "_abcdefghijklmnopqrstuvwxyz"
    place = {c: k for k, c in enumerate(letters)}
    pairs, triples = corpus_letters(docs)
    logp = [0.0] * 729
    counts = {r["gram"]: r["n"] for r in pairs.collect()}
    for a in letters:
        total = sum(counts.get(a + b, 0) + 1 for b in letters)
        for b in letters:
            logp[place[a] * 27 + place[b]] = log((counts.get(a + b, 0) + 1) / total)
    known = ["0"] * 19683
    for r in triples.collect():
        a, b, c = (place[x] for x in r["gram"])
        known[(a * 27 + b) * 27 + c] = "1"
    return F.lit(logp), F.lit("".join(known))


def featured(found: DataFrame, logp: Column, known: Column) -> DataFrame:
    v, n = F.col("value"), F.length("value")
    share = lambda p: F.regexp_count(v, F.lit(p)) / n
    code = lambda s, i: F.greatest(F.ascii(F.substr(s, i, F.lit(1))) - 96, F.lit(0)) % 27  # noqa: E731  '_' is 95: 0
    w = F.col("letters")
    size = F.length(w)
    pair_sum = F.aggregate(F.sequence(F.lit(1), size - 1), F.lit(0.0), lambda a, i: a + F.get(logp, code(w, i) * 27 + code(w, i + 1)))
    triple = lambda i: F.substr(known, (code(w, i) * 27 + code(w, i + 1)) * 27 + code(w, i + 2) + 1, F.lit(1))
    hits = F.size(F.filter(F.sequence(F.lit(1), size - 2), lambda i: triple(i) == "1"))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(v, "[0-9]", "\u0001"), "[a-zA-Z]", "a"), "[^a\u0001]", "o")
    plain = lambda c: F.col(c).rlike(r"^[\p{L}]+[.,;:!?]?$")
    found = found.withColumn("letters", F.concat(F.lit("_"), F.regexp_replace(_fold(v), "^_+|_+$", ""), F.lit("_")))
    columns = {
        "length": n,
        "digits": share("[0-9]"),
        "capitals": share("[A-Z]"),
        "lower": share("[a-z]"),
        "other": share("[^0-9A-Za-z]"),
        "hexadecimal": share("[0-9a-f]"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "changes": F.regexp_count(classes, F.lit("a(?=[^a])|o(?=[^o])|\u0001(?=[^\u0001])")) / n,
        "pair_logp": pair_sum / F.greatest(size - 1, F.lit(1)),
        "known_share": F.when(size >= 3, hits / F.greatest(size - 2, F.lit(1))).otherwise(F.lit(0.0)),
        "path_depth": F.regexp_count("path", F.lit("/")),
        "path_length": F.length("path"),
        "path_is_test": F.col("path").rlike("(?i)test|spec|example|mock"),
        "quoted": F.col("raw").rlike("^[\"'`]"),
        "assigned": F.col("before1").rlike("[=:]$"),
        "named": F.col("before1").rlike(SECRET_NAME) | F.col("before2").rlike(SECRET_NAME),
        "before_known": plain("before1"),
        "after_known": plain("after1"),
    }
    return found.withColumns({k: c.cast("double") for k, c in columns.items()})


def by_rule() -> Column:
    """Label of a finding where no labels are given: an assigned value of a secret's name, without a run of plain words in it."""
    return ((F.col("assigned") == 1) & (F.col("named") == 1) & (F.col("digits") > 0) & (F.col("known_share") < 0.8)).cast("double")


def scored(docs: DataFrame, labelled: DataFrame | None = None, train: int = TRAIN) -> DataFrame:
    """Findings with score (probability of a secret) and is_secret."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    found = saved(featured(candidates(docs), *_literals(docs)))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found.withColumn("rule", by_rule()))
    known = rows.withColumn("label", F.col("rule")) if labelled is None else rows.join(labelled, ["doc_id", "place", *(["part"] if "part" in labelled.columns else [])])
    order = F.xxhash64("doc_id", "place", "part", "value")
    # half of the bound for either label, so that rare secrets are seen
    halves = [known.filter(F.col("label") == k).orderBy(order, "doc_id", "place", "part").limit(train // 2).select("features", "label") for k in (0.0, 1.0)]
    lesson = saved(halves[0].unionByName(halves[1]).coalesce(1))
    if lesson.select("label").distinct().count() < 2:
        return rows.withColumn("score", F.col("rule")).withColumn("is_secret", F.col("score") >= KEEP).drop("features", "rule")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt").fit(lesson)
    rows = forest.transform(rows).withColumn("score", vector_to_array("probability")[1])
    return rows.withColumn("is_secret", F.col("score") >= KEEP).drop("features", "rule", "rawPrediction", "probability", "prediction")


def op9_secret_scan(spark, sf_dir):
    found = scored(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.col("place").cast("long").alias("place"), F.col("part").cast("long").alias("part"), "value", F.round("score", 6).alias("score"), "is_secret")
