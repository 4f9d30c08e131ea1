"""A data source of files below a folder, empty ones included, in batches and streams.

Spark's own binary file reader passes over files without bytes. This one lists a tree through ``pyarrow.fs`` in tasks: the driver lists folders down to
``depth`` only, and each folder there is a partition whose task lists and reads what lies below. As a stream it goes by modification time and path: a
batch has the files after the last batch's that have rested for ``settle`` seconds, and its end is the offset that a restart goes on from. Files that
appear later with an older time (moved ones, say) are not seen by a stream; a full scan finds them.

Options: ``path``; ``empty`` (true: only files without bytes, for a union with Spark's reader); ``depth`` (1); ``settle`` (2, seconds).
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def _open(root: str):
    """The file system of a URI, and the place in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _prefix(root: str) -> str:
    """What goes before a place to make a path as Spark's file sources give it."""
    scheme, sign, rest = root.partition("://")
    return f"{scheme}://{rest.partition('/')[0]}" if sign and scheme != "file" else "file:"


@dataclass
class Folder(InputPartition):
    """Files below ``place``, or in it alone, with times and paths after ``start`` up to ``end``."""

    place: str
    below: bool
    start: tuple[int, str] | None = None
    end: tuple[int, str] | None = None


class _Tree:
    def __init__(self, options: dict[str, str]):
        self.root, self.empty = options["path"], options.get("empty", "false") == "true"
        self.depth, self.settle = int(options.get("depth", "1")), float(options.get("settle", "2"))

    def folders(self, start=None, end=None) -> list[Folder]:
        from pyarrow import fs

        store, top = _open(self.root)
        out, level = [], [top]
        for _ in range(self.depth):
            found = []
            for place in level:
                out.append(Folder(place, False, start, end))
                found += [x.path for x in store.get_file_info(fs.FileSelector(place, allow_not_found=True)) if x.type == fs.FileType.Directory]
            level = found
        return out + [Folder(place, True, start, end) for place in level]

    def files(self, part: Folder) -> Iterator:
        """(file, (time, path)) of a partition."""
        from pyarrow import fs

        store, _ = _open(self.root)
        for x in store.get_file_info(fs.FileSelector(part.place, recursive=part.below, allow_not_found=True)):
            if x.type == fs.FileType.File and not (self.empty and x.size):
                at = (x.mtime_ns or 0, x.path)
                if (part.start is None or at > tuple(part.start)) and (part.end is None or at <= tuple(part.end)):
                    yield x, at

    def read(self, part: Folder) -> Iterator[tuple]:
        from datetime import UTC, datetime

        store, _ = _open(self.root)
        before = _prefix(self.root)
        for x, at in self.files(part):
            content = b""
            if x.size:
                with store.open_input_stream(x.path) as f:
                    content = f.read()
            yield before + x.path, datetime.fromtimestamp(at[0] // 1000 / 1e6, UTC), x.size, content


class TreeReader(_Tree, DataSourceReader):
    def partitions(self) -> list[Folder]:
        return self.folders()


class TreeStream(_Tree, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        """The last file that has rested; times and paths alone pass through the driver, one at a time."""
        rested = time.time_ns() - int(self.settle * 1e9)
        last = max((at for part in self.folders() for _, at in self.files(part) if at[0] <= rested), default=(-1, ""))
        return {"time": last[0], "path": last[1]}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return self.folders((start["time"], start["path"]), (end["time"], end["path"]))

    def commit(self, end: dict) -> None:
        pass


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "filetree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options)

    def streamReader(self, schema) -> TreeStream:
        return TreeStream(self.options)


def empty_files(spark: SparkSession, root: str, stream: bool = False, settle: float = 2) -> DataFrame:
    """The files below ``root`` that have no bytes, as Spark's binary file reader gives others."""
    spark.dataSource.register(FileTree)
    r = spark.readStream if stream else spark.read
    return r.format("filetree").option("empty", "true").option("settle", str(settle)).load(root)
