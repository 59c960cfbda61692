"""Record numbers, byte offsets, keyed indexes and reference checks.

Record order is an explicit column or key: nothing here relies on arrival order. Running
numbers over a whole file use ``numbered``, which sums per range partition and shifts, so
no single task ever holds all records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


#: Rows that are looked at for each range's bound.
SAMPLED = 32


def _cuts(df: DataFrame, first: str, n: int) -> list:
    """n - 1 bounds of about equal ranges of a column of any ordered type, from a sample in hash order of SAMPLED rows a range."""
    rows = df.select(F.col(first).alias("_k")).filter("_k is not null").orderBy(F.xxhash64("_k", F.monotonically_increasing_id()), "_k").limit(SAMPLED * n)
    found = sorted(r["_k"] for r in rows.collect())
    return sorted({found[len(found) * k // n] for k in range(1, n)}) if found else []


def _range_of(key: Column, cuts: list, kind: str, low: int = 0) -> Column:
    """Number of bounds below the key, by halving: a row makes as many comparisons as the bounds have bits."""
    if not cuts:
        return F.lit(low)
    mid = len(cuts) // 2
    bound = F.lit(cuts[mid]).cast(kind)
    return F.when(key <= bound, _range_of(key, cuts[:mid], kind, low)).otherwise(_range_of(key, cuts[mid + 1 :], kind, low + mid + 1))


def _by_ranges(df: DataFrame, order: list[str], size: Column) -> DataFrame:
    """Adds _part, and _before: the sum of ``size`` over all earlier rows, without a single-task window."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    first = order[0]
    cuts = _cuts(df, first, n) if n > 1 else []
    part = F.when(F.col(first).isNull(), -1).otherwise(_range_of(F.col(first), cuts, dict(df.dtypes)[first]))
    rows = df.withColumn("_part", part).withColumn("_size", size.cast("long"))
    sums = rows.groupBy("_part").agg(F.sum("_size").alias("_sum"))  # as many rows as partitions
    shift = sums.withColumn("_shift", F.coalesce(F.sum("_sum").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    own = F.coalesce(F.sum("_size").over(W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(shift.select("_part", "_shift")), "_part").withColumn("_before", F.col("_shift") + own).drop("_part", "_shift", "_sum")


def numbered(df: DataFrame, order: list[str], name: str = "rec_no") -> DataFrame:
    """1-based record numbers in the given order, which must be total. The work is spread over ranges of the first key, of whatever type."""
    return _by_ranges(df, order, F.lit(1)).withColumn(name, F.col("_before") + 1).drop("_before", "_size")


def with_offsets(df: DataFrame, order: list[str], text: str, separator_bytes: int = 1) -> DataFrame:
    """Adds offset and len (bytes) of each record as if written one a line."""
    size = F.coalesce(F.octet_length(F.col(text)), F.lit(0))
    rows = _by_ranges(df, order, size + separator_bytes)
    return rows.withColumn("offset", F.col("_before")).withColumn("len", size.cast("long")).drop("_before", "_size")


def nth_record(df: DataFrame, n: int, rec_no: str = "rec_no") -> DataFrame:
    return df.filter(F.col(rec_no) == n)


def record_range(df: DataFrame, first: int, last: int, rec_no: str = "rec_no") -> DataFrame:
    """Records first to last, in either order of the bounds."""
    return df.filter(F.col(rec_no).between(min(first, last), max(first, last)))


def last_record(df: DataFrame, order: str) -> DataFrame:
    """The record with the largest key: a partial-aggregate maximum, no sort."""
    return df.agg(F.max_by(F.struct(*df.columns), order).alias("r")).select("r.*")


def longest_record(df: DataFrame, size: str, rec_no: str) -> DataFrame:
    """(len, rec_no) of the longest record, the earliest of equals."""
    best = F.max(F.struct(F.col(size).alias("len"), (-F.col(rec_no)).alias("minus")))
    return df.agg(best.alias("b")).select(F.col("b.len").alias("len"), (-F.col("b.minus")).alias("rec_no"))


def record_at_offset(offsets: DataFrame, probes: DataFrame, probe: str = "probe") -> DataFrame:
    """The record that contains each probed byte: nearest prior start, by a union sorted within ranges instead of a range join."""
    starts = offsets.select(F.col("offset").alias("_at"), F.col("rec_no"), F.lit(None).cast("long").alias(probe))
    asked = probes.select(F.col(probe).alias("_at"), F.lit(None).cast("long").alias("rec_no"), F.col(probe).cast("long").alias(probe))
    both = starts.unionByName(asked)
    n = int(offsets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = _range_of(F.col("_at"), _cuts(offsets, "offset", n) if n > 1 else [], dict(both.dtypes)["_at"])
    both = both.withColumn("_part", part)
    within = F.max("rec_no").over(W.partitionBy("_part").orderBy("_at", F.col(probe).asc_nulls_first()))
    tops = both.groupBy("_part").agg(F.max("rec_no").alias("_top"))  # as many rows as partitions
    tops = tops.withColumn("_carry", F.max("_top").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))).select("_part", "_carry")
    found = both.withColumn("_within", within).filter(F.col(probe).isNotNull()).join(F.broadcast(tops), "_part")
    return found.select(probe, F.coalesce("_within", "_carry").alias("rec_no"))


def distance(offsets: DataFrame, a: int, b: int) -> DataFrame:
    """Bytes between the starts of two records."""
    at = lambda n: F.max(F.when(F.col("rec_no") == n, F.col("offset")))
    return offsets.agg((at(b) - at(a)).alias("distance"))


def offsets_ordered(offsets: DataFrame) -> DataFrame:
    """Number of records whose offset is not above the record before; 0 for a sound cache."""
    earlier = offsets.select((F.col("rec_no") + 1).alias("rec_no"), F.col("offset").alias("prior"))
    return offsets.join(earlier, "rec_no").agg(F.count_if(F.col("offset") <= F.col("prior")).alias("out_of_order"))


def nearest_prior(left: DataFrame, right: DataFrame, on: list[str], left_time: str, right_time: str, value: str, name: str) -> DataFrame:
    """As-of lookup: for each left row the latest right value at or before it, by one union and one window per key."""
    keep = [c for c in left.columns]
    a = left.select(*keep, F.col(left_time).alias("_at"), F.lit(None).cast(dict(right.dtypes)[value]).alias("_v"), F.lit(1).alias("_side"))
    b = right.select(*[F.col(c) if c in on else F.lit(None).cast(dict(left.dtypes)[c]).alias(c) for c in keep], F.col(right_time).alias("_at"), F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = W.partitionBy(*on).orderBy("_at", "_side")
    return a.unionByName(b).withColumn(name, F.last("_v", ignorenulls=True).over(w)).filter("_side = 1").select(*keep, name)


# --- keyed indexes -------------------------------------------------------------------


def compound_key(columns: list[str], separator: str = "#") -> Column:
    """Key fields joined; null where any of them is."""
    return F.concat_ws(separator, *[F.col(c).cast("string") for c in columns]) if len(columns) == 1 else F.concat(
        F.col(columns[0]).cast("string"), *[x for c in columns[1:] for x in (F.lit(separator), F.col(c).cast("string"))]
    )


def key_index(df: DataFrame, key: list[str], order: str, separator: str = "#") -> DataFrame:
    """One record per key, the first in order; records without a full key are dropped. Map-side combined, so hot keys are cheap."""
    rows = df.filter(" and ".join(f"`{c}` is not null" for c in key)).withColumn("_key", compound_key(key, separator))
    return rows.groupBy("_key").agg(F.min_by(F.struct(*df.columns), order).alias("r")).select(F.col("_key").alias("key"), "r.*")


def duplicate_keys(df: DataFrame, key: list[str], separator: str = "#") -> DataFrame:
    """Keys that occur more than once, with their counts."""
    rows = df.filter(" and ".join(f"`{c}` is not null" for c in key)).withColumn("key", compound_key(key, separator))
    return rows.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")


def nil_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.filter(" or ".join(f"`{c}` is null" for c in key))


def key_value_map(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """key to value, first wins, as rows."""
    return df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min_by(value, order).alias("value"))


def duplicate_ids(df: DataFrame, id_column: str) -> DataFrame:
    return df.filter(F.col(id_column).isNotNull()).groupBy(F.col(id_column).alias("id")).agg(F.count("*").alias("n")).filter("n > 1")


def unresolved_references(refs: DataFrame, ref: str, ids: DataFrame, id_column: str) -> DataFrame:
    """Distinct reference tokens with no id, from a white-space separated list column."""
    tokens = refs.select(F.explode(F.split(F.col(ref).cast("string"), r"\s+")).alias("ref")).filter("ref <> ''").distinct()
    return tokens.join(ids.select(F.col(id_column).cast("string").alias("ref")), "ref", "left_anti")


# --- dictionaries and ordered collections --------------------------------------------

ORDINALS = {"1": ("first", "1st", "i"), "2": ("second", "2nd", "ii"), "3": ("third", "3rd", "iii")}


def alias_probe(x: Column) -> Column:
    """Normal form of a name looked up by alias: lower case, ordinals as digits, no spaces or full stops."""
    x = F.lower(F.trim(x))
    for digit, names in ORDINALS.items():
        x = F.regexp_replace(x, rf"^(?:{'|'.join(names)})\s+", digit)
    return F.regexp_replace(x, r"[\s.]+", "")


def alias_table(entries: DataFrame, names: list[str], lists: list[str] = ()) -> DataFrame:
    """One row per alias of each entry: the named columns, and the comma-separated lists."""
    singles = F.array(*[F.col(c).cast("string") for c in names])
    more = [F.split(F.col(c).cast("string"), r"\s*,\s*") for c in lists]
    every = F.concat(singles, *[F.coalesce(m, F.array().cast("array<string>")) for m in more])
    rows = entries.withColumn("alias", F.explode(every)).filter("alias is not null and alias <> ''")
    return rows.withColumn("alias", alias_probe(F.col("alias"))).dropDuplicates(["alias", names[0]])


def lookup(probes: DataFrame, column: str, aliases: DataFrame, most: int = 200_000) -> DataFrame:
    """Left join by alias. The dictionary is broadcast up to ``most`` rows, which are counted, and shuffled beyond."""
    small = aliases.limit(most + 1).count() <= most
    return probes.withColumn("alias", alias_probe(F.col(column))).join(F.broadcast(aliases) if small else aliases, "alias", "left")


def group_members(entries: DataFrame, group: str, name: str, serial: str) -> DataFrame:
    return entries.filter(F.col(group) == name).orderBy(serial)


def group_sizes(entries: DataFrame, group: str) -> DataFrame:
    return entries.groupBy(group).agg(F.count("*").alias("n"))


def collection_append(items: Column, more: Column) -> Column:
    return F.concat(items, more)


def collection_remove(items: Column, item: Column | str) -> Column:
    return F.array_remove(items, item)


def collection_nth(items: Column, n: int) -> Column:
    return F.get(items, F.lit(n - 1))


def parse_references(ref: Column, book: Column) -> Column:
    """``12:16,21:1a-20`` of a book as references ``Book.chapter.verse.part``; a range stands as first-last."""
    pieces = F.split(F.regexp_replace(ref, r"\s+", ""), ",")

    def one(p: Column) -> Column:
        chapter, verse, part = (F.regexp_extract(p, r"^(\d+)(?::(\d+))?([a-z])?", k) for k in (1, 2, 3))
        tail = F.regexp_extract(p, r"-(\d+(?::\d+)?[a-z]?)$", 1)
        whole = F.concat(book, F.lit("."), chapter, F.when(verse != "", F.concat(F.lit("."), verse)).otherwise(F.lit("")), F.when(part != "", F.concat(F.lit("."), part)).otherwise(F.lit("")))
        stop = F.when(F.instr(tail, ":") > 0, F.replace(tail, F.lit(":"), F.lit("."))).when(verse != "", F.concat(chapter, F.lit("."), tail)).otherwise(tail)
        return F.when(tail == "", whole).otherwise(F.concat(whole, F.lit("-"), book, F.lit("."), stop))

    return F.transform(pieces, one)
