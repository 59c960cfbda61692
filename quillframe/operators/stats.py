"""Named statistics as aggregates: each is mergeable, and none depends on arrival order."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def count() -> Column:
    return F.count("*")


def total(x: Column | str) -> Column:
    return F.sum(x)


def first(x: Column | str, order: Column | str) -> Column:
    return F.min_by(x, order)


def last(x: Column | str, order: Column | str) -> Column:
    return F.max_by(x, order)


def appended(x: Column | str, order: Column | str) -> Column:
    """All values in order."""
    x, order = (F.col(c) if isinstance(c, str) else c for c in (x, order))
    return F.transform(F.array_sort(F.collect_list(F.struct(order.alias("o"), x.alias("x")))), lambda s: s["x"])


def keyed(df: DataFrame, by: list[str], key: str, value: str, order: str, name: str = "stat") -> DataFrame:
    """key to value map per group, the last write winning."""
    latest = df.groupBy(*by, key).agg(F.max_by(value, order).alias("_v"))
    entry = F.struct(F.col(key), F.col("_v"))
    pairs = latest.groupBy(*by) if by else latest.groupBy()
    return pairs.agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias(name))


#: How partial results of each statistic combine.
MERGES = {"count": F.sum, "sum": F.sum, "max": F.max, "min": F.min}


@dataclass
class StatLog:
    """Declared statistics with labels, in order of creation; headings have no value."""

    entries: list[tuple[str, str, Column | None]] = field(default_factory=list)

    def create(self, name: str, value: Column, label: str | None = None) -> StatLog:
        if name in self.names:
            raise ValueError(f"statistic {name!r} is there already")
        self.entries.append((name, label or name, value))
        return self

    def heading(self, label: str) -> StatLog:
        self.entries.append((f"head_{len(self.entries)}", label, None))
        return self

    def delete(self, name: str) -> StatLog:
        self.entries = [e for e in self.entries if e[0] != name]
        return self

    @property
    def names(self) -> list[str]:
        return [n for n, _, v in self.entries if v is not None]

    def collect(self, df: DataFrame, by: list[str] | None = None) -> DataFrame:
        aggregates = [v.alias(n) for n, _, v in self.entries if v is not None]
        return df.groupBy(*by).agg(*aggregates) if by else df.agg(*aggregates)

    def report(self, df: DataFrame, width: int = 30) -> DataFrame:
        """(ord, label, value) rows, labels padded, headings in place."""
        rows = self.collect(df)
        lines = []
        for k, (name, label, value) in enumerate(self.entries):
            shown = F.lit(label) if value is None else F.rpad(F.lit(label), max(width, len(label)), ".")
            lines.append(F.struct(F.lit(k).alias("ord"), shown.alias("label"), (F.lit("") if value is None else F.col(name).cast("string")).alias("value")))
        return rows.select(F.explode(F.array(*lines)).alias("l")).select("l.*")


def merged(parts: list[DataFrame], by: list[str], how: dict[str, str]) -> DataFrame:
    """Partial results to totals, each statistic by its own rule."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return union.groupBy(*by).agg(*[MERGES[h](c).alias(c) for c, h in how.items()])


def percent_report(df: DataFrame, by: list[str], value: Column, name: str = "total") -> DataFrame:
    """A total per group and its share of all in percent: one aggregate, whose one-row sum is joined to it."""
    totals = df.groupBy(*by).agg(value.alias(name))
    whole = totals.agg(F.sum(name).alias("_whole"))
    return totals.crossJoin(F.broadcast(whole)).withColumn("percent", F.col(name) * 100.0 / F.col("_whole")).drop("_whole")


def token_counts(df: DataFrame, tokens: Column, by: list[str] = ()) -> DataFrame:
    return df.select(*by, F.explode(tokens).alias("token")).groupBy(*by, "token").agg(F.count("*").alias("n"))


def structure_counts(nodes: DataFrame, by: list[str]) -> DataFrame:
    """Elements, texts, white-space texts, instructions and comments of a node table."""
    blank = F.col("text").rlike(r"^\s*$")
    return nodes.groupBy(*by).agg(
        F.count_if(F.col("kind") == "element").alias("elements"),
        F.count_if((F.col("kind") == "text") & ~blank).alias("texts"),
        F.count_if((F.col("kind") == "text") & blank).alias("blanks"),
        F.count_if(F.col("kind") == "pi").alias("instructions"),
        F.count_if(F.col("kind") == "comment").alias("comments"),
    )
