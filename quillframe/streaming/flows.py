"""Streaming forms: the same parsers on unbounded text, running statistics, and event-time windows with late data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillframe.functions import datatypes
from quillframe.sources import options as opts
from quillframe.sources import readers


def text_stream(spark: SparkSession, path: str, whole: bool = True, per_trigger: int = 100) -> DataFrame:
    """(src, value) of files as they arrive in a folder."""
    return spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("src"), "value")


def parquet_stream(spark: SparkSession, folder: str, schema: T.StructType, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def parsed(stream: DataFrame, fmt: str, names: list[str], **options) -> DataFrame:
    """Records of a text stream. Names must be given: a stream cannot be read twice to find them."""
    if fmt == "csv":
        o = opts.resolve(**options)
        rows = readers.lines(stream)
        cells = readers.csv_cells(F.col("value"), o)
        rows = rows.filter("rec_no > 1") if o["header"] else rows
        return readers.named(rows.filter("value <> ''"), cells, names)
    if fmt not in ("mime", "manchester", "perl", "xml"):
        raise ValueError(f"{fmt} is read in batches only")
    return readers.parse_table(stream, fmt, field_names=names, **options)


def running_statistics(stream: DataFrame, by: list[str], statistics: dict[str, Column]) -> DataFrame:
    """Statistics since the start, for update or complete mode."""
    return stream.groupBy(*by).agg(*[c.alias(n) for n, c in statistics.items()])


def windowed(stream: DataFrame, time: str, width: str, by: list[str], statistics: dict[str, Column], slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding event-time windows; rows later than ``late`` are dropped and state beyond it is freed."""
    rows = stream.withWatermark(time, late)
    span = F.window(time, width, slide) if slide else F.window(time, width)
    out = rows.groupBy(span.alias("w"), *by).agg(*[c.alias(n) for n, c in statistics.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *statistics)


def sessions(stream: DataFrame, time: str, gap: str, by: list[str], statistics: dict[str, Column], late: str = "10 minutes") -> DataFrame:
    rows = stream.withWatermark(time, late)
    out = rows.groupBy(F.session_window(time, gap).alias("w"), *by).agg(*[c.alias(n) for n, c in statistics.items()])
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, *statistics)


def validated(stream: DataFrame, checks: dict[str, str]) -> DataFrame:
    """Adds _bad: the names of the columns whose values are not of their types."""
    bad = [F.when(~datatypes.conforms(F.col(c), spec), F.lit(c)) for c, spec in checks.items()]
    return stream.withColumn("_bad", F.filter(F.array(*bad), lambda b: b.isNotNull()))


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs what is there through a stream and returns it as a table: for tests and small backfills."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)


def drained_to(stream: DataFrame, folder: str) -> DataFrame:
    """Runs what is there through a stream into a Parquet table below a shared folder, and reads it."""
    query = stream.writeStream.format("parquet").option("path", f"{folder}/table").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")
