"""A Spark data source of raw event lines: ``spark.read.format("event_lines").load(folder)``, and the same with ``readStream``.

Columns: ``raw`` (the line as it is, malformed ones too), ``path`` and ``offset`` (its first byte), so that each event can be traced to its bytes.
Lines end with a line feed, with or without a carriage return before it; blank ones are left out. Register it once a session:
``spark.dataSource.register(EventLines)``.

Files are cut into ranges of bytes; a line belongs to the range in which it begins, so large files are read by many tasks. A stream's offset is the
time of change and path of the newest file it has read; files are complete when they appear and don't change after (as Spark's own file
streams ask), and are read in that order. Files are reached through ``pyarrow.fs``: local or mounted folders, hdfs, s3, gs.

Options: ``range_bytes`` (64 MB).
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "raw string, path string, offset bigint"
CHUNK = 1 << 20


class Range(InputPartition):
    def __init__(self, path: str, start: int, stop: int):
        self.path, self.start, self.stop = path, start, stop


def _system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def _files(uri: str) -> list[tuple[int, str, int]]:
    """(time of change, path, bytes) of the data files below a folder, or of the file itself, in order."""
    system, path = _system(uri)
    info = system.get_file_info(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and f.size and f.base_name[0] not in "._")


def ranges(files: list[tuple[int, str, int]], size: int) -> list[Range]:
    return [Range(path, start, min(start + size, total)) for _, path, total in files for start in range(0, total, size)]


def lines(system: fs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of the lines that begin in a range."""
    with system.open_input_file(part.path) as f:
        at = part.start
        held = b""
        if at:  # the line that the byte before belongs to is another range's, unless it ends there
            f.seek(at - 1)
            skipping, at = True, at - 1
        else:
            skipping = False
        while True:
            chunk = f.read(CHUNK)
            held += chunk
            begin = 0
            while (end := held.find(b"\n", begin)) >= 0:
                if skipping:
                    skipping = False
                elif at + begin >= part.stop:
                    return
                else:
                    yield at + begin, held[begin:end]
                begin = end + 1
            at, held = at + begin, held[begin:]
            if at >= part.stop and not skipping:
                return
            if not chunk:
                if held and not skipping:
                    yield at, held
                return
            if skipping:  # nothing of an unfinished line before the range is needed
                at, held = at + len(held), b""


def _batches(uri: str, part: Range) -> Iterator[pa.RecordBatch]:
    system, _ = _system(uri)
    rows: list[tuple[int, str]] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.string()), pa.array([part.path] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64())], names=["raw", "path", "offset"])

    size = 0
    for at, line in lines(system, part):
        text = line.removesuffix(b"\r").decode("utf-8", "replace")
        if text.strip(" "):
            rows.append((at, text))
            size += len(text)
        if len(rows) >= 10_000 or size >= 1 << 24:
            yield batch()
            rows, size = [], 0
    if rows:
        yield batch()


class LinesReader(DataSourceReader):
    def __init__(self, uri: str, size: int):
        self.uri, self.size = uri, size

    def partitions(self) -> list[Range]:
        return ranges(_files(self.uri), self.size) or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(self.uri, partition) if partition.path else iter([])


class LinesStream(DataSourceStreamReader):
    def __init__(self, uri: str, size: int):
        self.uri, self.size = uri, size

    def initialOffset(self) -> dict:
        return {"changed": -1, "path": ""}

    def latestOffset(self) -> dict:
        files = _files(self.uri)
        return {"changed": files[-1][0], "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Range]:
        after, upto = (start["changed"], start["path"]), (end["changed"], end["path"])
        return ranges([f for f in _files(self.uri) if after < f[:2] <= upto], self.size)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        return _batches(self.uri, partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class EventLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "event_lines"

    def schema(self) -> str:
        return SCHEMA

    def _where(self) -> tuple[str, int]:
        if not self.options.get("path"):
            raise ValueError("event_lines needs a path")
        return self.options["path"], int(self.options.get("range_bytes", 1 << 26))

    def reader(self, schema: object) -> LinesReader:
        return LinesReader(*self._where())

    def streamReader(self, schema: object) -> LinesStream:
        return LinesStream(*self._where())
