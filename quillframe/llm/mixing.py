"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

``targets`` fills every source in proportion to its weight up to ``max_epochs`` times
its size. Sorting sources by cap / weight makes the repeated clamp-and-reshare rounds
one pass: a source is clamped exactly if the level left for it and all later sources
reaches its cap, which is the fixed point of those rounds.

``mixed`` turns targets into repetitions. Each document is taken floor(target / size of
its source) times whole; the rest of the target is filled by one more repetition in the
order of a seeded hash, of which the last document taken is taken in part. The cut in
hash order is found by two rounds of 4,096-bin sums and an exact running sum over the
few documents of one second-round bin, so no source is ever gathered in one task.

Defined cases: null text has size 0; a null source is a source of its own, last in
order; sources without words get target 0; an empty table gives an empty result; rows
that repeat a doc_id count as separate documents; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.llm.common import saved, table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MAX_EPOCHS = 2
SEED = "mix-1"
#: Source tables up to this many rows are broadcast; larger ones are joined by shuffle.
BROADCAST_SOURCES = 50_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """sources (source, source_size) to (source, source_size, target). One row per source, not per document."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights) + 1).cast("int"))
    every = W.orderBy(F.lit(0)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    order = W.orderBy("ratio", F.col("source").asc_nulls_last())
    return (
        sources.withColumn("weight", weight)
        .withColumn("cap", F.col("source_size") * F.lit(max_epochs))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(every))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("level", (F.col("total") * F.lit(float(budget)) - F.col("capped_before")) / F.col("weight_left"))
        .withColumn("clamped", F.col("level") >= F.col("ratio"))
        .withColumn("open_level", F.max(F.when(~F.col("clamped"), F.col("level"))).over(every))
        .withColumn("target", F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(F.col("open_level") * F.col("weight")))
        .select("source", "source_size", "target")
    )


def _cut(sums: DataFrame, key: str, base: Column) -> DataFrame:
    """Of each source's bins, the one in which its extra words run out."""
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy(key).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return sums.withColumn("base", base + before).filter((F.col("base") <= F.col("extra_words")) & (F.col("extra_words") < F.col("base") + F.col("words")))


def mixed(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: int = MAX_EPOCHS, seed: str = SEED, row: str | None = None) -> DataFrame:
    """docs (doc_id, source, text) to (doc_id, source, size, source_size, target, whole, extra, taken), and the column ``row`` if named."""
    more = [] if row is None else [row]
    digest = F.md5(F.concat_ws("/", F.lit(seed), F.col("doc_id").cast("string")))
    sized = saved(docs.select(*more, "doc_id", "source", word_count(F.col("text")).alias("size"), digest.alias("h")))
    sized = sized.withColumn("bin1", F.substring("h", 1, 3)).withColumn("bin2", F.substring("h", 4, 3))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, budget, max_epochs)
    plan = saved(
        plan.withColumn("whole", whole).withColumn("extra_words", F.floor(F.col("target") - F.col("whole") * F.col("source_size") + 0.5).cast("long"))
    )
    small = plan.count() <= BROADCAST_SOURCES

    def beside(frame: DataFrame, side: DataFrame) -> DataFrame:
        side = side.withColumnRenamed("source", "of")
        return frame.join(F.broadcast(side) if small else side, F.col("source").eqNullSafe(F.col("of")), "left").drop("of")

    sums1 = sized.groupBy("source", "bin1").agg(F.sum("size").alias("words"))
    cut1 = _cut(beside(sums1, plan.select("source", "extra_words")), "bin1", F.lit(0))
    cut1 = saved(cut1.select("source", F.col("bin1").alias("cut1"), F.col("base").alias("base1"), "extra_words"))
    sums2 = beside(sized, cut1).filter("bin1 = cut1").groupBy("source", "bin2", "base1", "extra_words").agg(F.sum("size").alias("words"))
    cut2 = saved(_cut(sums2, "bin2", F.col("base1")).select("source", F.col("bin2").alias("cut2"), F.col("base").alias("base2")))

    cuts = beside(beside(plan, cut1.drop("extra_words")), cut2)
    rows = beside(sized, cuts)
    at_cut = F.coalesce((F.col("bin1") == F.col("cut1")) & (F.col("bin2") == F.col("cut2")), F.lit(False))
    before_cut = F.col("cut1").isNull() | (F.col("bin1") < F.col("cut1")) | ((F.col("bin1") == F.col("cut1")) & (F.col("bin2") < F.col("cut2")))
    clear = rows.filter(~at_cut).withColumn("extra", F.when((F.col("extra_words") > 0) & before_cut, F.col("size")).otherwise(F.lit(0)).cast("long"))
    order = W.partitionBy("source").orderBy("h", "doc_id", "size", *more).rowsBetween(W.unboundedPreceding, -1)
    left = F.col("extra_words") - F.col("base2") - F.coalesce(F.sum("size").over(order), F.lit(0))
    close = rows.filter(at_cut).withColumn("extra", F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left)))
    kept = (*more, "doc_id", "source", "size", "source_size", "target", "whole", "extra")
    return clear.select(*kept).unionByName(close.select(*kept)).withColumn("taken", F.col("whole") * F.col("size") + F.col("extra"))


def mixture(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of docs, a row per repetition; a repetition taken in part holds its first words.

    Rows are numbered first, so those that repeat a doc_id, or have none, are taken as separate documents.
    """
    numbered = saved(docs.withColumn("__qf_row", F.monotonically_increasing_id()))
    taken = mixed(numbered, row="__qf_row", **options).select("__qf_row", "whole", "extra", "size")
    words, size = F.col("__qf_words"), F.col("__qf_size")  # names that no column of docs has
    head = F.array_join(F.slice(F.split("text", r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])"), 1, words.cast("int")), "")
    times = F.array_repeat(F.col("size"), F.col("whole").cast("int"))
    parts = F.concat(times, F.when(F.col("extra") > 0, F.array("extra")).otherwise(F.expr("array()").cast("array<bigint>")))
    taken = taken.filter("whole > 0 or extra > 0").select("__qf_row", F.col("size").alias("__qf_size"), F.explode(parts).alias("__qf_words"))
    rows = numbered.join(taken.hint("merge"), "__qf_row").withColumn("text", F.when(words < size, head).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(words < size, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)


def op8_mix_sources(spark, sf_dir):
    return mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1/' || doc_id::VARCHAR) AS h FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 2 AS cap,
         (sum(source_size) OVER ())::BIGINT AS total FROM per),
levels AS (
  SELECT *, (total * 1.5::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
    / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM weighed),
opened AS (
  SELECT *, level >= cap / weight AS clamped,
         (SELECT max(level) FROM levels WHERE level < cap / weight) AS open_level FROM levels),
plan AS (
  SELECT source, source_size, CASE WHEN clamped THEN cap::DOUBLE ELSE open_level * weight END AS target FROM opened),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM plan),
runs AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, floor(p.target - p.whole * p.source_size + 0.5)::BIGINT AS extra_words,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, extra_words - before)))::BIGINT AS taken FROM runs
"""
