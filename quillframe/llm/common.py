"""Table access and lineage cuts shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_dir: list[str] = []
#: Has Spark delete a query's shuffle files when the query ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to a Python worker at once. With Spark's 10,000 whole texts, both sides of the pipe hold tens of MB several times over.
FEW_ROWS = {"spark.sql.execution.arrow.maxRecordsPerBatch": "256"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; one of our own only where the setting is absent (tests, local mode)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="quillframe-"))
    return _own_dir[0]


def saved(frame: DataFrame, by: list[str] | None = None, settings: dict[str, str] | None = None) -> DataFrame:
    """Cuts lineage: writes the frame to the shared folder as Parquet, in folders by the columns ``by``, and reads it back. settings hold for the write.

    Every executor can reread the files, so losing one costs nothing that was saved.
    The shuffle files of the write go when it ends; left to Spark they would lie on the
    executors' disks until the driver happens to collect its garbage.
    """
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/quillframe/{uuid.uuid4().hex}"
    settings = {CLEANUP: "true"} | (settings or {})
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        frame.select("*").write.option("compression", "zstd").parquet(path, partitionBy=by)  # the settings are read where a frame is made
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(frame.schema).parquet(path)
    out._quillframe_path = path
    return out


def discarded(*frames: DataFrame) -> None:
    """Deletes the files of saved tables that nothing reads any more."""
    for frame in frames:
        spark = frame.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(frame._quillframe_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
