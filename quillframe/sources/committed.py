"""One document of many parts: a Spark data source that commits header, parts and trailer together.

Each task writes its records under a folder of the attempt and reports it. Only when all
tasks are through does the commit give the parts their places in the document and write
what stands around them; a failed or aborted write takes its folder away and leaves nothing
that a reader could find. Part names sort in document order.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "quillframe_document"


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """The store of a path, and the path in it; plain paths and file: paths are local to every machine, so they must be shared."""
    local = re.match(r"file:/*(/.*)", path)
    if local or ":" not in path.split("/")[0]:
        return fs.LocalFileSystem(), local[1] if local else path
    return fs.FileSystem.from_uri(path)


@dataclass
class Part(WriterCommitMessage):
    partition: int
    file: str
    records: int


class DocumentWriter(DataSourceArrowWriter):
    """Rows (ord, value) in order within each partition, partitions in order. ``separator`` stands between any two records."""

    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.overwrite = options["path"], overwrite
        self.header, self.trailer, self.separator, self.suffix = (json.loads(options.get(k, '""')) for k in ("header", "trailer", "separator", "suffix"))
        self.last = json.loads(options.get("last", "null"))
        self.attempt = f"_attempt-{uuid.uuid4().hex}"
        store, root = filesystem(self.path)
        kept = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        self.fresh = store.get_file_info(root).type == fs.FileType.NotFound
        if kept and not overwrite:
            raise FileExistsError(f"{self.path} is not empty")
        self.old = [x.path for x in kept]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task, (store, root) = TaskContext.get(), filesystem(self.path)
        store.create_dir(f"{root}/{self.attempt}", recursive=True)
        file, records, last = f"{root}/{self.attempt}/{task.partitionId():05d}-{task.taskAttemptId()}", 0, False
        with store.open_output_stream(file) as out:
            for batch in iterator:
                values = batch.column("value").to_pylist()
                if not values:
                    continue
                out.write((((self.separator + "\n") if records else "") + (self.separator + "\n").join(values)).encode("utf-8", "surrogatepass"))
                records += len(values)
                last = last or (self.last is not None and self.last in batch.column("ord").to_pylist())
            if records:
                out.write(b"\n" if last else (self.separator + "\n").encode())
        return Part(task.partitionId(), file, records)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = filesystem(self.path)
        store.create_dir(root, recursive=True)
        for old in self.old:
            (store.delete_dir if store.get_file_info(old).type == fs.FileType.Directory else store.delete_file)(old)
        parts = sorted((m for m in messages if m is not None and m.records), key=lambda m: m.partition)
        place = lambda k: f"{root}/part-{k:06d}{self.suffix}"
        for k, part in enumerate(parts, 1):
            store.move(part.file, place(k))
        for k, text in ((0, self.header), (len(parts) + 1, self.trailer)):
            if text:
                with store.open_output_stream(place(k)) as out:
                    out.write((text + "\n").encode("utf-8", "surrogatepass"))
        self._clear()
        with store.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Part | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        store, root = filesystem(self.path)
        if store.get_file_info(f"{root}/{self.attempt}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.attempt}")
        if self.fresh and not store.get_file_info(fs.FileSelector(root, allow_not_found=True)) and store.get_file_info(root).type != fs.FileType.NotFound:
            store.delete_dir(root)


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def writer(self, schema: StructType, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> str:
    spark.dataSource.register(DocumentSource)
    return NAME
