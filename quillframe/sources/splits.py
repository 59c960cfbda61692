"""Logical records of large line-based files, many tasks to a file.

Spark's text source deals a file out in byte ranges (blocks) of whole lines. Whether a line
starts a record depends on the quotes of all lines before it, so a block alone cannot tell.
Two passes settle it.

1. Every block is summed up for both cases, entered outside and inside quotes: how it is
   left, and how many records start in it. A line is a function from state to state, and so
   is a block, their composition; a comment that holds a quote leads outside from either
   state. The block also gives its first real record (or all up to a marker), from which
   a file's header is taken.
2. The driver composes the functions of each file's blocks in order, a few numbers a block,
   and so knows each block's state and first record number. A second pass cuts the records.
   Records that end where they start go on as they are. Only those that reach over the end
   of a block come as pieces and are put together by a shuffle of these pieces.

Files are read by Spark alone, from any store and compressed or not (one block then). Blocks
are known by (file, first byte) and must be the same in both passes: a change of the
cluster's size between them can move them, which is refused rather than misread.

Defined cases: empty files give nothing; an unclosed quote makes the rest of the file one
record; lines end with LF, CR LF or CR, and breaks inside a record become LF; a file without
a real record has no header.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.functions import scalars

#: Blocks of a read, a row each on the driver and in the broadcast: 100 TB in blocks of 128 MB is 0.8 million.
MOST_BLOCKS = 2_000_000
_SUMMARY = "src string, block long, out0 int, out1 int, starts0 long, starts1 long, head_no long, head string"


def block_lines(spark: SparkSession, path: str | list[str], strip: bool = False) -> DataFrame:
    """(src, block, value): lines, in order within each task; block is the first byte of the range the line was read in."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("src"), F.col("_metadata.file_block_start").alias("block"), "value")
    return rows.withColumn("value", scalars.trim(F.col("value"))) if strip else rows


class LineStates:
    """The state after each of a run of lines, from the state before them: 0 outside quotes, 1 inside."""

    def __init__(self, quote: str, escape: str, comment: str):
        self.quote, self.escape, self.comment = quote, escape, comment

    def functions(self, lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Which lines have an odd number of quotes, and which are comments when they start a record."""
        none = np.zeros(len(lines), bool)
        notes = pc.starts_with(lines, self.comment).to_numpy(zero_copy_only=False) if self.comment else none
        if not self.quote:
            return none, notes
        bare = pc.replace_substring_regex(lines, re.escape(self.escape) + ".", "") if self.escape else lines
        return pc.count_substring(bare, self.quote).to_numpy(zero_copy_only=False) % 2 == 1, notes

    @staticmethod
    def before(odd: np.ndarray, notes: np.ndarray, state: int) -> np.ndarray:
        """The state before each line, and last the state after all of them."""
        flips = np.concatenate([[0], np.cumsum(odd)])
        # behind a comment with an odd quote the state is outside, whatever it was: parity counts from there
        since = np.concatenate([[-1], np.where(odd & notes, np.arange(len(odd)), -1)])
        since = np.maximum.accumulate(since)
        return np.where(since >= 0, flips - flips[since + 1], flips + state) % 2


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], int, int]]:
    """((src, block), from, to) of the stretches of one block in a batch."""
    src, block = batch.column("src"), batch.column("block").to_numpy(zero_copy_only=False)
    if not len(block):
        return
    files = pc.run_end_encode(src)
    ends = np.union1d(np.asarray(files.run_ends), np.flatnonzero(np.diff(block)) + 1).tolist()
    lo = 0
    for hi in ends:
        yield (src[lo].as_py(), int(block[lo])), lo, hi
        lo = hi


def _summaries(states: LineStates, marker: str):
    blank = re.compile(r"\s*\Z")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        key, at, starts, no, head, done = None, [0, 1], [0, 0], 0, [], False

        def row() -> pd.DataFrame:
            return pd.DataFrame([(*key, *at, *starts, no if done else None, "\n".join(head) if done else None)], columns=[f.split()[0] for f in _SUMMARY.split(", ")]).astype({"head_no": "Int64"})

        for batch in batches:
            for here, lo, hi in _runs(batch):
                if here != key:
                    if key is not None:
                        yield row()
                    key, at, starts, no, head, done = here, [0, 1], [0, 0], 0, [], False
                lines = batch.column("value").slice(lo, hi - lo)
                odd, notes = states.functions(lines)
                for k in (0, 1):
                    before = states.before(odd, notes, at[k])
                    if k == 0 and not done:
                        # the first real record as if the block were entered outside quotes, or all up to the marker
                        for x, (inside, after) in enumerate(zip(before[:-1].tolist(), before[1:].tolist(), strict=True)):
                            line = lines[x].as_py()
                            no += inside == 0
                            skipped = inside == 0 and (notes[x] or blank.match(line))
                            if not skipped:
                                head.append(line)
                                done = bool(re.match(marker, line)) if marker else after == 0
                                if done:
                                    break
                    starts[k] += int((before[:-1] == 0).sum())
                    at[k] = int(before[-1])
        if key is not None:
            yield row()

    def arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("src", pa.string()), ("block", pa.int64()), ("out0", pa.int32()), ("out1", pa.int32()), ("starts0", pa.int64()), ("starts1", pa.int64()), ("head_no", pa.int64()), ("head", pa.string())])
        for frame in run(batches):
            yield pa.RecordBatch.from_pandas(frame, schema=schema, preserve_index=False)

    return arrow


def composed(summaries: list[Any], one_document: bool = False) -> tuple[list[tuple], dict[str, tuple[int, str]]]:
    """Rows (src, block, state, records before, whether a record crosses an end) of every block, and (number, text) of each source's head.

    A source is a file, or with ``one_document`` a folder, whose files count on in order of their names; no record goes from file to file.
    """
    rows, heads, file, source, state, records = [], {}, None, None, 0, 0
    for s in sorted(summaries, key=lambda s: (s["src"], s["block"])):
        if s["src"] != file:
            file, state = s["src"], 0
            if (now := _folder(file) if one_document else file) != source:
                source, records = now, 0
        if state == 0 and source not in heads and s["head"] is not None:
            heads[source] = (records + s["head_no"], s["head"])
        left = s["out1"] if state else s["out0"]
        rows.append((file, s["block"], state, records, bool(state or left)))
        records += s["starts1"] if state else s["starts0"]
        state = left
    return rows, heads


def _folder(file: str) -> str:
    return file.rpartition("/")[0]


def _cut(states: LineStates, pieces: bool):
    """Rows (src, rec_no, piece, value) from lines with their block's state and records before it: whole records, or the pieces of those that cross its ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, no, held, head = None, 0, 0, [], False

        def batch_of(src: str, block: int, numbers: list[int], values) -> pa.RecordBatch:
            n = len(numbers)
            return pa.RecordBatch.from_arrays([pa.array([src] * n, pa.string()), pa.array(numbers, pa.int64()), pa.array([block] * n, pa.int64()), pa.array(values, pa.string())], ["src", "rec_no", "piece", "value"])

        def ended() -> Iterator[pa.RecordBatch]:
            """What is held when a block ends: a piece if it came from before or goes on, else a record."""
            if held and pieces == bool(head or state):
                yield batch_of(*key, [no], ["\n".join(held)])

        for batch in batches:
            for here, lo, hi in _runs(batch):
                if here != key:
                    if key is not None:
                        yield from ended()
                    if not batch.column("state")[lo].is_valid:
                        raise RuntimeError(f"{here[0]} was dealt out differently in the second pass; read it again")
                    key, state, no = here, batch.column("state")[lo].as_py(), batch.column("records")[lo].as_py()
                    held, head = [], state == 1
                lines = batch.column("value").slice(lo, hi - lo)
                before = states.before(*states.functions(lines), state)
                firsts = np.flatnonzero(before[:-1] == 0)
                state = int(before[-1])
                if not len(firsts):
                    held += lines.to_pylist()
                    continue
                held += lines.slice(0, firsts[0]).to_pylist()
                # the record in hand ends where the next starts
                if held and pieces == head:
                    yield batch_of(*key, [no], ["\n".join(held)])
                head = False
                if not pieces and len(firsts) > 1:
                    sizes = np.diff(firsts)
                    if (sizes == 1).all():
                        values = lines.slice(firsts[0], firsts[-1] - firsts[0])
                    else:
                        texts = lines.to_pylist()
                        values = [texts[a] if n == 1 else "\n".join(texts[a : a + n]) for a, n in zip(firsts[:-1].tolist(), sizes.tolist(), strict=True)]
                    yield batch_of(*key, list(range(no + 1, no + len(firsts))), values)
                no += len(firsts)
                held = lines.slice(firsts[-1]).to_pylist()
        if key is not None:
            yield from ended()

    return run


def logical_records(spark: SparkSession, path: str | list[str], o: dict[str, Any], marker: str = "", one_document: bool = False) -> tuple[DataFrame, dict[str, tuple[int, str]]]:
    """(src, rec_no, value) of all files, comments and blank records included in the numbers, and each file's head.

    ``o``: quote, escape, comment, strip_records and nl_in_quotes count. A head is (number of its last record, text):
    the first real record, or, with a ``marker`` pattern, all lines up to the first that matches it.
    """
    states = LineStates(o["quote"] if o["nl_in_quotes"] else "", o["escape"], o["comment"])
    lines = block_lines(spark, path, o["strip_records"])
    found = lines.mapInArrow(_summaries(states, marker), _SUMMARY).collect()
    if len(found) > MOST_BLOCKS:
        raise ValueError(f"{len(found)} blocks; raise spark.sql.files.maxPartitionBytes")
    rows, heads = composed(found, one_document)
    if not rows:
        return spark.createDataFrame([], "src string, rec_no long, value string"), heads
    known = spark.createDataFrame(rows, "_src string, _block long, state int, records long, crossed boolean")
    placed = lines.join(F.broadcast(known), (F.col("src") == F.col("_src")) & (F.col("block") == F.col("_block")), "left")
    placed = placed.select("src", "block", "value", "state", "records", "crossed")
    out = "src string, rec_no long, piece long, value string"
    named = lambda df: df.withColumn("src", F.regexp_replace("src", "/[^/]*$", "")) if one_document else df
    whole = placed.drop("crossed").mapInArrow(_cut(states, False), out).drop("piece")
    if not any(r[4] for r in rows):
        return named(whole), heads
    files = sorted({r[0] for r in rows if r[4]})
    some = placed.filter("crossed")
    some = some.filter(F.col("src").isin(files)) if len(files) <= 1000 else some
    cut = some.drop("crossed").mapInArrow(_cut(states, True), out)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "value"))), lambda s: s["value"]), "\n")
    return named(whole.unionByName(cut.groupBy("src", "rec_no").agg(joined.alias("value")))), heads


def read_lines(spark: SparkSession, path: str | list[str], one_document: bool = False) -> DataFrame:
    """(src, rec_no, value): physical lines of files of any size, numbered within their file."""
    plain = {"quote": "", "escape": "", "comment": "", "strip_records": False, "nl_in_quotes": False}
    return logical_records(spark, path, plain, one_document=one_document)[0]
