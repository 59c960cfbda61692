"""Preference formatting: the longest common turn prefix as prompt, the rest of both sides as masked completions.

Both sides are tables of turns (pair_id, turn, role, text). A turn is rendered as
``<|role|>\\ntext<|end|>\\n``. The common prefix is the longest run of leading turns that
render alike; it is rendered once. A completion's mask lists the spans to train on, in
characters of the completion: the text and end mark of each assistant turn. Running
offsets come from one window over each conversation, so long conversations stay linear.

Defined cases: null role and text render as empty; rows without pair_id are dropped;
turns are ordered by turn (null first), role, text, so repeated and tied rows have one
order; a pair needs both sides; if one side is a prefix of the other its completion is
empty; an empty table gives no pairs; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillframe.llm.common import table

END = "<|end|>\n"


def _turns(turns: DataFrame) -> DataFrame:
    """One row per conversation: its rendered turns in order, each with its place."""
    order = W.partitionBy("pair_id").orderBy("turn", "role", "text")
    head = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"))
    body = F.concat(F.coalesce("text", F.lit("")), F.lit(END))
    rows = turns.filter(F.col("pair_id").isNotNull()).select(
        "pair_id",
        F.row_number().over(order).alias("pos"),
        F.concat(head, body).alias("shown"),
        F.length(head).alias("head"),
        (F.coalesce("role", F.lit("")) == "assistant").alias("trained"),
        F.sum(F.length(head) + F.length(body)).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("upto"),
    )
    return rows.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("pos", "shown", "head", "trained", "upto"))).alias("turns"))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: t["shown"]), "")


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """(pair_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask); masks are arrays of (start, length)."""
    both = _turns(chosen).withColumnRenamed("turns", "c").join(_turns(rejected).withColumnRenamed("turns", "r"), "pair_id")
    same = F.zip_with("c", "r", lambda a, b: F.coalesce(a["shown"] == b["shown"], F.lit(False)))
    first_off = F.array_position(same, F.lit(False))
    n_common = F.when(first_off > 0, first_off - 1).otherwise(F.size("c")).cast("int")
    both = both.withColumn("n_common", n_common)
    prompt = _joined(F.slice("c", F.lit(1), F.col("n_common")))
    both = both.withColumn("prompt", prompt).withColumn("cut", F.length("prompt"))

    def rest(side: str) -> Column:
        return F.slice(side, F.col("n_common") + 1, F.greatest(F.size(side) - F.col("n_common"), F.lit(0)))

    def mask(side: str) -> Column:
        span = lambda t: F.struct(
            (t["upto"] - F.length(t["shown"]) + t["head"] - F.col("cut")).cast("int").alias("start"), (F.length(t["shown"]) - t["head"]).cast("int").alias("length")
        )
        return F.transform(F.filter(rest(side), lambda t: t["trained"]), span)

    return both.select(
        "pair_id",
        "n_common",
        "prompt",
        _joined(rest("c")).alias("chosen"),
        _joined(rest("r")).alias("rejected"),
        mask("c").alias("chosen_mask"),
        mask("r").alias("rejected_mask"),
    )


def swapped_responses(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from plain conversations: the rejected side is the conversation with the last assistant
    turn of its neighbour (2i and 2i + 1 are neighbours) in place of its own. Conversations without an assistant turn,
    or whose neighbour has none, make no pair."""
    order = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = conversations.filter(F.col("conv_id").isNotNull()).select("conv_id", "turn", "role", "text", F.row_number().over(order).alias("pos"))
    last = F.max(F.when(F.col("role") == "assistant", F.col("pos"))).over(W.partitionBy("conv_id"))
    rows = rows.withColumn("last", last)
    final = rows.filter("pos = last").select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), F.col("text").alias("other"))
    rows = rows.filter("last is not null").join(final, "conv_id")
    text = F.when(F.col("pos") == F.col("last"), F.col("other")).otherwise(F.col("text"))
    pair = F.col("conv_id").alias("pair_id")
    return rows.select(pair, F.col("pos").alias("turn"), "role", "text"), rows.select(pair, F.col("pos").alias("turn"), "role", text.alias("text"))


def op1_preference_pairs(spark, sf_dir):
    pairs = preference_pairs(*swapped_responses(table(spark, sf_dir, "conversations")))
    shown = lambda m: F.array_join(F.transform(m, lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ";")
    return pairs.withColumns({"chosen_mask": shown("chosen_mask"), "rejected_mask": shown("rejected_mask")})


OP1_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(pos) FILTER (WHERE role = 'assistant') AS lp FROM t GROUP BY conv_id),
final AS (SELECT xor(t.conv_id, 1::BIGINT) AS conv_id, t.text FROM t JOIN last USING (conv_id) WHERE pos = lp),
sides AS (
  SELECT t.conv_id, t.pos, t.role, t.text AS c, CASE WHEN t.pos = l.lp THEN f.text ELSE t.text END AS r
  FROM t JOIN last l ON t.conv_id = l.conv_id JOIN final f ON f.conv_id = t.conv_id WHERE l.lp IS NOT NULL),
shown AS (
  SELECT conv_id, pos, role, length('<|' || role || '|>' || chr(10)) AS head,
         '<|' || role || '|>' || chr(10) || c || '<|end|>' || chr(10) AS c, '<|' || role || '|>' || chr(10) || r || '<|end|>' || chr(10) AS r FROM sides),
common AS (SELECT conv_id, coalesce(min(pos) FILTER (WHERE c <> r) - 1, max(pos)) AS n FROM shown GROUP BY conv_id),
placed AS (
  SELECT s.*, n, sum(CASE WHEN pos > n THEN length(c) ELSE 0 END) OVER w - length(c) + head AS cs,
         sum(CASE WHEN pos > n THEN length(r) ELSE 0 END) OVER w - length(r) + head AS rs
  FROM shown s JOIN common USING (conv_id) WINDOW w AS (PARTITION BY conv_id ORDER BY pos))
SELECT conv_id AS pair_id, max(n)::INT AS n_common,
  coalesce(string_agg(c, '' ORDER BY pos) FILTER (WHERE pos <= n), '') AS prompt,
  coalesce(string_agg(c, '' ORDER BY pos) FILTER (WHERE pos > n), '') AS chosen,
  coalesce(string_agg(r, '' ORDER BY pos) FILTER (WHERE pos > n), '') AS rejected,
  coalesce(string_agg(cs::BIGINT || ':' || (length(c) - head), ';' ORDER BY pos) FILTER (WHERE pos > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(rs::BIGINT || ':' || (length(r) - head), ';' ORDER BY pos) FILTER (WHERE pos > n AND role = 'assistant'), '') AS rejected_mask
FROM placed GROUP BY conv_id
"""
