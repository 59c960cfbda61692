"""A sparse index of record starts beside line-based files, and records read through it by ranges of bytes.

Every n-th record's offset is kept, so the index is small and any table format stores it. A
record is found by arithmetic (the indexed one before it), one equality join, and one read
of the bytes from there to the next indexed record: a few records, whatever the file's size.

Defined cases: numbers below 1 or behind the last record give no row; files must be
uncompressed, with one kind of line break, which the sum of their lines proves; a last line
without a break is allowed for.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.sources import splits
from quillframe.sources.committed import filesystem

INDEX = "src string, rec_no long, offset long, records long, bytes long"


def _lengths(lines: pa.Array) -> np.ndarray:
    return pc.binary_length(lines).to_numpy(zero_copy_only=False).astype(np.int64)


def record_index(spark: SparkSession, path: str | list[str], o: dict[str, Any], every: int = 1000, line_break: int = 1) -> DataFrame:
    """(src, rec_no, offset, records, bytes) of records 1, 1 + every, ... of each file, with the file's numbers of records and bytes.

    ``o``: the options that tell logical records (quote, escape, comment, nl_in_quotes); ``line_break``: bytes of a break.
    """
    states = splits.LineStates(o["quote"] if o["nl_in_quotes"] else "", o["escape"], o["comment"])
    lines = splits.block_lines(spark, path)
    found = lines.mapInArrow(splits._summaries(states, ""), splits._SUMMARY).collect()
    size = F.sum(F.octet_length("value") + line_break).alias("size")
    sizes = {(r["src"], r["block"]): r["size"] for r in lines.groupBy("src", "block").agg(size).collect()}
    whole = {r["src"]: r["bytes"] for r in spark.read.text(path).select(F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_size").alias("bytes")).distinct().collect()}
    rows, _ = splits.composed(found)
    known, at, totals = [], {}, {}
    starts = {(s["src"], s["block"]): (s["starts0"], s["starts1"]) for s in found}
    for src, block, state, records, _ in rows:
        known.append((src, block, state, records, at.get(src, 0)))
        at[src] = at.get(src, 0) + sizes[src, block]
        totals[src] = records + starts[src, block][state]
    for src, end in at.items():
        if end - whole[src] not in (0, line_break):
            raise ValueError(f"{src} has other line breaks than {line_break} byte(s), or is compressed")
    if not known:
        return spark.createDataFrame([], INDEX)
    blocks = spark.createDataFrame(known, "_src string, _block long, state int, before long, at long")
    files = spark.createDataFrame([(src, totals[src], whole[src]) for src in whole], "src string, records long, bytes long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, no, offset = None, 0, 0, 0
        for batch in batches:
            for here, lo, hi in splits._runs(batch):
                if here != key:
                    key, state, no, offset = here, batch.column("state")[lo].as_py(), batch.column("before")[lo].as_py(), batch.column("at")[lo].as_py()
                part = batch.column("value").slice(lo, hi - lo)
                before = states.before(*states.functions(part), state)
                ends = offset + np.cumsum(_lengths(part) + line_break)
                first = np.flatnonzero(before[:-1] == 0)
                numbers = no + 1 + np.arange(len(first))
                kept = numbers % every == 1 % every
                places = np.concatenate([[offset], ends[:-1]])[first[kept]]
                state, no, offset = int(before[-1]), no + len(first), int(ends[-1])
                if kept.any():
                    yield pa.RecordBatch.from_arrays([pa.array([key[0]] * int(kept.sum())), pa.array(numbers[kept]), pa.array(places)], ["src", "rec_no", "offset"])

    placed = lines.join(F.broadcast(blocks), (F.col("src") == F.col("_src")) & (F.col("block") == F.col("_block"))).select("src", "block", "value", "state", "before", "at")
    return placed.mapInArrow(run, "src string, rec_no long, offset long").join(files, "src")


def records_at(index: DataFrame, asked: DataFrame, o: dict[str, Any], every: int = 1000) -> DataFrame:
    """(src, rec_no, value, bytes_read) for the records (src, rec_no) that are asked for, each by one read behind the index."""
    states = splits.LineStates(o["quote"] if o["nl_in_quotes"] else "", o["escape"], o["comment"])
    anchor = (F.floor((F.col("rec_no") - 1) / every) * every + 1).alias("_anchor")
    rows = asked.filter("rec_no >= 1").select("src", F.col("rec_no").cast("long").alias("rec_no"), anchor).distinct()
    starts = index.select("src", F.col("rec_no").alias("_anchor"), "offset", "records", "bytes")
    stops = index.select("src", (F.col("rec_no") - every).alias("_anchor"), F.col("offset").alias("_stop"))
    spans = rows.join(starts, ["src", "_anchor"]).filter("rec_no <= records").join(stops, ["src", "_anchor"], "left")
    spans = spans.select("src", "rec_no", "_anchor", "offset", F.coalesce("_stop", "bytes").alias("stop"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: tuple[str, int] | None = None
        lines, firsts, size = [], np.zeros(0, np.int64), 0
        for batch in batches:
            out = []
            for src, number, first, offset, stop in batch.itertuples(index=False):
                if held != (src, offset):
                    store, name = filesystem(src)
                    with store.open_input_file(name) as f:
                        raw = f.read_at(stop - offset, offset)
                    size = len(raw)
                    lines = raw.decode("utf-8", "surrogatepass").replace("\r\n", "\n").removesuffix("\n").split("\n")
                    before = states.before(*states.functions(pa.array(lines, pa.string())), 0)
                    firsts, held = np.flatnonzero(before[:-1] == 0), (src, offset)
                k = number - first
                end = int(firsts[k + 1]) if k + 1 < len(firsts) else len(lines)
                out.append((src, number, "\n".join(lines[int(firsts[k]) : end]), size))
            yield pd.DataFrame(out, columns=["src", "rec_no", "value", "bytes_read"])

    # records behind one indexed one are read together
    return spans.repartition("src", "_anchor").sortWithinPartitions("src", "_anchor", "rec_no").mapInPandas(run, "src string, rec_no long, value string, bytes_read long")
