"""Lines appended to growing files, as a stream: a Python data source with a byte offset per file.

Spark's file stream reads a file once, when it appears; a log that is still being written needs its position remembered.  An
offset here maps every file to the byte up to which its lines were read.  A batch holds only what was appended since,
in partitions of bounded size, and only whole lines: an unfinished last line waits for its end.  Offsets live in the
stream's checkpoint, so a batch that is tried again reads the same bytes.

A file shorter than its offset was replaced and is read from its start; files that are gone are forgotten.  One that was
replaced by a longer one can't be told from one that grew: trees that are rewritten belong to ``increments.FileStore``.  The
offset names every file of the tree, so the source is meant for logs in use, not for an archive.  Files are opened through
pyarrow's file systems (local or shared folders, S3, GCS, HDFS).
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Executors need not have this package installed: the source travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of appended text in one partition, of one read, and of a line that is still read.
PART_BYTES, READ_BYTES, MAX_LINE_BYTES = 32 << 20, 1 << 20, 4 << 20

SCHEMA = "file_path string, line_no bigint, value string"


@dataclass
class Appended(InputPartition):
    """Lines of a file that begin in [begin, end); the first of them begins at or after ``begin``, ``whole`` if at it."""

    path: str
    begin: int
    end: int
    stop: int
    whole: bool


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and path.startswith("file:"):
        path = path[len("file:") :]
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def last_line_end(file, size: int) -> int:
    """Byte after the last line break before ``size``; 0 if there is none."""
    while size > 0:
        begin = max(0, size - READ_BYTES)
        file.seek(begin)
        at = file.read(size - begin).rfind(b"\n")
        if at >= 0:
            return begin + at + 1
        size = begin
    return 0


def lines_of(file, part: Appended) -> Iterator[tuple[int, bytes]]:
    """(first byte, line) of the part's lines, longer ones than the limit left out without holding them."""
    # Unless the part begins a line, the rest of the line before it is passed over first.
    start = part.begin if part.whole else part.begin - 1
    passing, held, at = not part.whole, bytearray(), start
    file.seek(start)
    while start < part.end and at < part.stop:
        block = file.read(min(READ_BYTES, part.stop - at))
        if not block:
            return
        begin = 0
        while (end := block.find(b"\n", begin)) >= 0:
            if not passing and len(held) + end - begin <= MAX_LINE_BYTES:
                yield start, bytes(held) + block[begin:end]
            begin, passing = end + 1, False
            held.clear()
            start = at + begin
            if start >= part.end:
                return
        if not passing:
            held += block[begin:]
            if len(held) > MAX_LINE_BYTES:
                passing = True
                held.clear()
        at += len(block)


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.sizes: dict[str, int] = {}
        self.known: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self, *_) -> dict:
        """End of the last whole line of every file; only files whose size changed are looked into."""
        system, root = _opened(self.path)
        out = {}
        for info in system.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True)):
            hidden = info.base_name.startswith(("_", "."))
            if info.type != fs.FileType.File or hidden or not info.size:
                continue
            if self.sizes.get(info.path) != info.size:
                with system.open_input_file(info.path) as file:
                    self.known[info.path] = last_line_end(file, info.size)
                self.sizes[info.path] = info.size
            out[info.path] = self.known[info.path]
        return out

    def partitions(self, start: dict, end: dict) -> list[Appended]:
        parts = []
        for path, stop in sorted(end.items()):
            begin = start.get(path, 0)
            begin = 0 if begin > stop else begin
            edges = [*range(begin, stop, PART_BYTES), stop]
            parts += [Appended(path, a, b, stop, a == begin) for a, b in zip(edges, edges[1:])]
        return parts

    def read(self, partition: Appended) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        shape = pa.schema([("file_path", pa.string()), ("line_no", pa.int64()), ("value", pa.string())])
        with system.open_input_file(partition.path) as file:
            rows, size = [], 0
            for at, line in lines_of(file, partition):
                rows.append((partition.path, at, line.decode("utf-8", "replace")))
                size += len(line)
                if size > READ_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), shape.types)], schema=shape)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), shape.types)], schema=shape)


class TailSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> TailReader:
        return TailReader(self.options["path"])


def appended_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines appended to the files below ``path``: (file_path, line_no, value).

    ``line_no`` is the byte at which the line begins, so it is unique in its file and follows its order.
    """
    spark.dataSource.register(TailSource)
    return spark.readStream.format(TailSource.name()).load(path)
