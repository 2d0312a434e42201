"""Sizes and leading bytes of files, as a data source: ``spark.read.format("file_heads")``.

Spark's binary source loads every file whole. This source opens each file, asks its length and reads the first bytes, whatever
the file's size. The listing is dealt into groups of files, one partition each.

Options: ``path`` (a folder, listed with all below it; a path or URI that Arrow's file systems know), ``pattern`` (of the file
name), ``bytes`` (leading bytes to read) and ``files`` (of a partition).
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

HEAD_BYTES, FILES = 4, 1000
SCHEMA = "path string, length bigint, modified timestamp, head binary"


@dataclass
class FileGroup(InputPartition):
    paths: list[str]


def _open(root: str) -> tuple[arrow_fs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return arrow_fs.FileSystem.from_uri(root)
    return arrow_fs.LocalFileSystem(), root


class FileHeadReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.pattern = options.get("pattern", "*")
        self.size = int(options.get("bytes", HEAD_BYTES))
        self.files = int(options.get("files", FILES))

    def partitions(self) -> list[FileGroup]:
        files, base = _open(self.root)
        listed = files.get_file_info(arrow_fs.FileSelector(base, recursive=True))
        # As Spark does, files and folders whose name begins with an underscore or a dot are passed over.
        hidden = lambda path: any(x[:1] in ("_", ".") for x in path[len(base) :].strip("/").split("/"))
        wanted = (i for i in listed if i.type == arrow_fs.FileType.File and fnmatch.fnmatch(i.base_name, self.pattern))
        paths = sorted(i.path for i in wanted if not hidden(i.path))
        return [FileGroup(paths[i : i + self.files]) for i in range(0, len(paths), self.files)] or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        files, _ = _open(self.root)
        rows = []
        for info in files.get_file_info(partition.paths):
            with files.open_input_file(info.path) as f:
                rows.append((info.path, info.size, info.mtime, f.read(self.size)))
        columns = list(zip(*rows)) or [()] * 4
        kinds = (pa.string(), pa.int64(), pa.timestamp("us", "UTC"), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["path", "length", "modified", "head"])


class FileHeads(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_heads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FileHeadReader:
        return FileHeadReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileHeads)
