"""Folders of chat exports as a data source of their own: `spark.read.format("chat_exports")` and `spark.readStream`.

    register(spark)
    files = spark.read.format("chat_exports").option("glob", "*.json").load("s3://bucket/exports")
    chats = chat_exports.standard_export(files)

Rows are (path, text), one per file, as the readers of whole files take them, so
parsing stays with Spark's expressions. Files are dealt over tasks by their sizes.
As a stream, a file is delivered in the first batch after it has rested for
`settle` seconds.
"""

from __future__ import annotations

import fnmatch
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: Bytes that a task reads, unless one file has more.
TASK_BYTES = 64 << 20


@dataclass(frozen=True)
class ExportFile:
    path: str
    size: int
    changed: int  # nanoseconds


@dataclass
class Share(InputPartition):
    """The files of one task."""

    paths: tuple[str, ...]

    def __init__(self, paths: tuple[str, ...]):
        super().__init__(paths)
        self.paths = paths


def shares(files: list[ExportFile], task_bytes: int) -> list[Share]:
    """Files in the order of their paths, each task with `task_bytes` or one file."""
    out, held, size = [], [], 0
    for file in sorted(files, key=lambda f: f.path):
        if held and size + file.size > task_bytes:
            out.append(Share(tuple(held)))
            held, size = [], 0
        held.append(file.path)
        size += file.size
    return [*out, Share(tuple(held))] if held else out


class Folder:
    """What the options say: path, glob (of file names), recursive, taskBytes, settle (seconds)."""

    def __init__(self, options: dict[str, str]):
        if not options.get("path"):
            raise ValueError("chat_exports needs a path")
        self.uri, self.glob = options["path"], options.get("glob", "*.json")
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.task_bytes = int(options.get("taskBytes", TASK_BYTES))
        self.settle = float(options.get("settle", 1))

    def files(self) -> list[ExportFile]:
        """Hidden files and folders are left out, as Spark does. The listing is the driver's, one entry per file."""
        system, root = fs.FileSystem.from_uri(self.uri)
        out = []
        for info in system.get_file_info(fs.FileSelector(root, recursive=self.recursive)):
            inner = info.path[len(root):].strip("/").split("/")
            if info.type == fs.FileType.File and not any(p.startswith(("_", ".")) for p in inner) and fnmatch.fnmatchcase(inner[-1], self.glob):
                out.append(ExportFile(info.path, info.size, info.mtime_ns or 0))
        return out

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        """A batch per file, so that one file is held at a time. Bytes that are no UTF-8 become U+FFFD, a leading byte order mark goes."""
        system, _ = fs.FileSystem.from_uri(self.uri)
        for path in partition.paths:
            with system.open_input_stream(path) as stream:
                text = stream.read().decode("utf-8-sig", errors="replace")
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.string()), pa.array([text], pa.string())], ["path", "text"])


class ExportReader(DataSourceReader):
    def __init__(self, folder: Folder):
        self.folder = folder

    def partitions(self) -> list[Share]:
        # Spark wants one partition at least.
        return shares(self.folder.files(), self.folder.task_bytes) or [Share(())]

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)


class ExportStream(DataSourceStreamReader):
    """Offsets are times of change: a batch holds the files changed after its start, up to its end.

    Only files that have rested for `settle` seconds count, so none can appear
    later with a time that a batch has passed, unless it is moved in with an
    older one: write files in place, or copy them.
    """

    def __init__(self, folder: Folder):
        self.folder, self.last = folder, 0

    def initialOffset(self) -> dict:
        return {"changed": 0}

    def latestOffset(self) -> dict:
        rested = time.time_ns() - int(self.folder.settle * 1e9)
        self.last = max([f.changed for f in self.folder.files() if f.changed <= rested], default=self.last)
        return {"changed": self.last}

    def partitions(self, start: dict, end: dict) -> list[Share]:
        new = [f for f in self.folder.files() if start["changed"] < f.changed <= end["changed"]]
        return shares(new, self.folder.task_bytes)

    def read(self, partition: Share) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition)


class ChatExports(DataSource):
    @classmethod
    def name(cls) -> str:
        return "chat_exports"

    def schema(self) -> str:
        return "path STRING, text STRING"

    def reader(self, schema) -> ExportReader:
        return ExportReader(Folder(self.options))

    def streamReader(self, schema) -> ExportStream:
        return ExportStream(Folder(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ChatExports)
