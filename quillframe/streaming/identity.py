"""Identifiers and references of tuples that arrive as a stream: duplicates at once, unresolved references when waiting is over.

State is kept by identifier, not by record: where it was first defined, and which references
to it wait. A definition resolves what waits, whichever came first. Timers on event time end
both: a reference that has waited ``wait`` is reported, and an identifier is forgotten
``keep`` after its last use, so state is bounded by what lies within these spans.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
REPORT = "code string, id string, rec_no long, n long"


def tokens(rows: DataFrame, rec_no: str, time: str, identifier: Column | None, references: Column | None) -> DataFrame:
    """(id, kind, rec_no, time): a row for the identifier of each record and for each reference in its white-space separated list."""
    none = F.array().cast("array<string>")
    own = none if identifier is None else F.array(identifier.cast("string"))
    others = none if references is None else F.split(references.cast("string"), r"\s+")
    kind = lambda xs, name: F.transform(F.coalesce(xs, none), lambda x: F.struct(x.alias("id"), F.lit(name).alias("kind")))
    every = F.concat(kind(own, "id"), kind(others, "ref"))
    out = rows.select(F.explode(F.filter(every, lambda t: t["id"].isNotNull() & (t["id"] != ""))).alias("t"), F.col(rec_no).cast("long").alias("rec_no"), F.col(time).alias("time"))
    return out.select("t.id", "t.kind", "rec_no", "time")


class _Identities(StatefulProcessor):
    def __init__(self, wait_ms: int, keep_ms: int | None):
        self.wait, self.keep = wait_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        number = lambda *names: StructType([StructField(n, LongType()) for n in names])
        self.defined = handle.getValueState("defined", number("rec_no", "until"))
        self.waiting = handle.getValueState("waiting", number("rec_no", "n", "since"))

    def _timer(self, at: int) -> None:
        self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        out = self._over(key, timerValues.getCurrentWatermarkInMs())  # rows come before timers that are due
        batch = pd.concat(list(rows)).sort_values(["rec_no", "kind"])
        ids, refs = batch[batch["kind"] == "id"], batch[batch["kind"] == "ref"]
        latest = int(batch["time"].max().timestamp() * 1000)
        first = self.defined.get()[0] if self.defined.exists() else None
        if len(ids):
            numbers = ids["rec_no"].tolist()
            if first is None:
                first = int(numbers.pop(0))
                self.waiting.clear()
            out += [("DUPID", key[0], int(n), 1) for n in numbers]
        if first is not None:
            until = latest + self.keep if self.keep is not None else -1
            self.defined.update((first, until))
            if self.keep is not None:
                self._timer(until)
        elif len(refs):
            if not self.waiting.exists():
                since = int(refs["time"].min().timestamp() * 1000)
                self.waiting.update((int(refs["rec_no"].min()), len(refs), since))
                self._timer(since + self.wait)
            else:
                at, n, since = self.waiting.get()
                self.waiting.update((min(at, int(refs["rec_no"].min())), n + len(refs), since))
        if out:
            yield pd.DataFrame(out, columns=["code", "id", "rec_no", "n"])

    def _over(self, key, now: int) -> list[tuple]:
        """Forgets what is over at a time, and reports references that have waited in vain."""
        if self.defined.exists() and 0 <= self.defined.get()[1] <= now:
            self.defined.clear()
        if self.waiting.exists() and self.waiting.get()[2] + self.wait <= now:
            first, n, _ = self.waiting.get()
            self.waiting.clear()
            return [("IDREF", key[0], first, n)]
        return []

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self._over(key, expiredTimerInfo.getExpiryTimeInMs())
        if out:
            yield pd.DataFrame(out, columns=["code", "id", "rec_no", "n"])

    def close(self) -> None:
        pass


def checked(stream: DataFrame, wait_s: int, keep_s: int | None = None, late: str = "0 seconds") -> DataFrame:
    """(code, id, rec_no, n) from a stream of ``tokens``: DUPID for each later definition, IDREF for references (the first record's number, how many) that no definition met in time.

    The session's state store must be the RocksDB one; ``with_state_store`` sets it.
    """
    rows = stream.withWatermark("time", late)
    processor = _Identities(wait_s * 1000, None if keep_s is None else keep_s * 1000)
    return rows.groupBy("id").transformWithStateInPandas(processor, REPORT, "Append", "EventTime")


def with_state_store(spark) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def checked_batch(rows: DataFrame) -> DataFrame:
    """The same report from a table of ``tokens``, all references waiting for ever."""
    from pyspark.sql import Window as W

    later = F.row_number().over(W.partitionBy("id").orderBy("rec_no")) > 1
    ids = rows.filter("kind = 'id'")
    dups = ids.withColumn("_later", later).filter("_later").select(F.lit("DUPID").alias("code"), "id", "rec_no", F.lit(1).cast("long").alias("n"))
    refs = rows.filter("kind = 'ref'").groupBy("id").agg(F.min("rec_no").alias("rec_no"), F.count("*").alias("n"))
    lost = refs.join(ids.select("id").distinct(), "id", "left_anti").select(F.lit("IDREF").alias("code"), "id", "rec_no", "n")
    return dups.unionByName(lost)
