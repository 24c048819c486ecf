"""Whole files as rows, read and written: a data source that plans its tasks by the files' sizes.

Files are listed once, in order of path, and dealt to tasks that hold about so many bytes, each file
counting as a few kilobytes more than it has: many small files make few tasks. Empty files are rows
like any others. The stores that Arrow knows can be read and written (local disks, HDFS by its
client, and object stores).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from fnmatch import fnmatchcase
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

NAME = "whole_files"
SCHEMA = "path string, relative string, modificationTime timestamp, length long, content binary"
#: Ends the name of a file that is being written.
PART = ".whole-files-part"
#: What a task reads, what a file counts beside its bytes, and what is given on at once.
TASK_BYTES, OPEN_BYTES, BATCH_BYTES = 128 << 20, 256 << 10, 16 << 20


def _store(path: str):  # noqa: ANN202
    """The file system of a path, and the path in it."""
    from pyarrow import fs

    path = "file:///" + path.removeprefix("file:").lstrip("/") if path.startswith(("file:", "/")) else path
    return fs.FileSystem.from_uri(path if "%" in path or " " not in path else quote(path, safe=":/"))


@dataclass
class Found:
    """A listed file: its path in its store and below the root, its time in microseconds, and its size."""

    path: str
    relative: str
    time: int
    size: int


@dataclass
class FileGroup(InputPartition):
    files: list[Found]


def listed(root: str, pattern: str, depth: int | None) -> list[Found]:
    """Files under a folder whose names match a pattern in any case, at most so many folders down, in order of path; none where there is no folder."""
    from pyarrow import fs

    store, base = _store(root)
    base = base.rstrip("/")
    out = []
    front = [base]
    while front:
        below = []
        for folder in front:
            for info in store.get_file_info(fs.FileSelector(folder, allow_not_found=True)):
                if info.type == fs.FileType.Directory:
                    below.append(info.path)
                elif not info.base_name.endswith(PART) and fnmatchcase(info.base_name.lower(), pattern.lower()):
                    out.append(Found(info.path, info.path[len(base) + 1 :], int(info.mtime_ns or 0) // 1000, info.size or 0))
        front = below if depth is None or depth > 0 else []
        depth = None if depth is None else depth - 1
    return sorted(out, key=lambda f: f.path)


def dealt(files: list[Found], task_bytes: int) -> list[FileGroup]:
    """Files in order, as many to a group as fit; one that is larger by itself."""
    groups: list[FileGroup] = []
    room = 0
    for f in files:
        need = f.size + OPEN_BYTES
        if not groups or need > room:
            groups.append(FileGroup([]))
            room = task_bytes
        groups[-1].files.append(f)
        room -= need
    return groups


class WholeFiles(DataSource):
    """`spark.read.format("whole_files")`, with the options path, pattern, depth and taskBytes; the same to write (relative, content)."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options))


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        given = {k.lower(): v for k, v in options.items()}
        self.root, self.pattern = given["path"], given.get("pattern", "*")
        self.depth = int(given["depth"]) if "depth" in given else None
        self.task_bytes = int(given.get("taskbytes", TASK_BYTES))

    def partitions(self) -> list[InputPartition]:
        return dealt(listed(self.root, self.pattern, self.depth), self.task_bytes) or [FileGroup([])]

    def read(self, partition: FileGroup) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.root)
        names = [f.split()[0] for f in SCHEMA.split(", ")]
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            columns = list(zip(*held, strict=True))
            kinds = [pa.string(), pa.string(), pa.timestamp("us", tz="UTC"), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

        size = 0
        scheme = self.root.split(":")[0] if ":" in self.root else "file"
        for f in partition.files:
            with store.open_input_stream(f.path) as stream:
                content = stream.read()
            held.append((f"{scheme}:{quote(f.path)}", f.relative, datetime.fromtimestamp(f.time / 1e6, UTC), f.size, content))
            size += len(content)
            if size > BATCH_BYTES:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()


class _Writer(DataSourceArrowWriter):
    """A file for each row. It is written beside its place and moved there, so a task that is repeated leaves whole files."""

    def __init__(self, options: dict[str, str]) -> None:
        self.root = {k.lower(): v for k, v in options.items()}["path"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, base = _store(self.root)
        for batch in iterator:
            for relative, content in zip(batch.column("relative").to_pylist(), batch.column("content").to_pylist(), strict=True):
                place = posixpath.normpath(relative)
                if place.startswith(("/", "../")) or place in ("..", "."):
                    raise ValueError(f"no place below the folder: {relative!r}")
                target = f"{base.rstrip('/')}/{place}"
                folder, name = posixpath.split(target)
                store.create_dir(folder, recursive=True)
                with store.open_output_stream(part := f"{folder}/{name}.{uuid.uuid4().hex}{PART}") as out:
                    out.write(content or b"")
                store.move(part, target)
        return WriterCommitMessage()

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        pass

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        pass


def read_files(spark: SparkSession, path: str, pattern: str = "*", depth: int | None = None, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(path, relative, modificationTime, length, content) of the files under a folder, empty ones too; paths are percent-encoded."""
    spark.dataSource.register(WholeFiles)
    reader = spark.read.format(NAME).option("path", path).option("pattern", pattern).option("taskBytes", task_bytes)
    return (reader if depth is None else reader.option("depth", depth)).load()


def write_files(files: DataFrame, path: str) -> None:
    """Each row of (relative, content) as a file below a folder; files that are there stay, but for those of the same place."""
    files.sparkSession.dataSource.register(WholeFiles)
    files.select("relative", F.col("content").cast("binary").alias("content")).write.format(NAME).option("path", path).mode("append").save()
