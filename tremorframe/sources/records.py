"""Files of multi-line records, read in byte ranges: a range takes the records whose head line starts inside it.

A task reads many ranges, so that the number of tasks does not hang on the length of a range.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a range, and the most that a task reads in smaller ones.
RANGE_BYTES = 64 << 20
#: Records of an Arrow batch.
BATCH = 5_000


class Stretches(InputPartition):
    """``(path, start, end)`` of the parts of files that a task reads."""

    def __init__(self, parts: list[tuple[str, int, int]]):
        self.parts = parts


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that a path names, and the path inside it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


def range_records(file, start: int, end: int, head: re.Pattern, lines: int, comment: bytes = b"#") -> Iterator[str]:
    """Records of ``lines`` lines whose head starts at a byte in [start, end); blank and comment lines do not count.

    A record may run on behind ``end``; one that the file cuts off is left out. A line that begins before ``start``
    belongs to the range before.
    """
    if start >= end:
        return
    at = max(0, start - 1)
    file.seek(at)
    reader = _lines(file, min(1 << 20, max(1 << 12, end - start)))
    if start:
        at += len(next(reader, b""))
    open_records: deque[list[str]] = deque()
    for raw in reader:
        begins, at = at, at + len(raw)
        if begins >= end and not open_records:
            return
        bare = raw.strip()
        if not bare or bare.startswith(comment):
            continue
        text = raw.rstrip(b"\r\n").decode("utf-8", "replace")
        for record in open_records:
            record.append(text)
        if begins < end and head.search(text):
            open_records.append([text])
        if open_records and len(open_records[0]) == lines:
            yield "\n".join(open_records.popleft())


def _lines(stream, block: int = 1 << 20) -> Iterator[bytes]:
    """Lines with their ends, the file read in blocks."""
    rest = b""
    while data := stream.read(block):
        *whole, rest = (rest + data).split(b"\n")
        yield from (line + b"\n" for line in whole)
    if rest:
        yield rest


class RecordReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options, self.files = options, json.loads(options["files"])
        self.head, self.lines = options["head"], int(options["lines"])
        self.bytes = int(options.get("rangebytes") or options.get("rangeBytes") or RANGE_BYTES)

    def partitions(self) -> list[InputPartition]:
        slots = int(self.options.get("slots", 1))
        share = -(-sum(size for _, size in self.files) // slots)
        most = max(1, min(max(RANGE_BYTES, self.bytes), share) // self.bytes) * self.bytes
        out, room = [], 0
        for path, size in self.files:
            at = 0
            while at < size:
                if room < self.bytes:
                    out.append([])
                    room = most
                end = min(at + room // self.bytes * self.bytes, size)
                out[-1].append((path, at, end))
                room -= end - at
                at = end
        # A file without a byte, or no file, still needs a partition: an empty one.
        return [Stretches(parts) for parts in out or [[]]]

    def read(self, partition: Stretches) -> Iterator[pa.RecordBatch]:
        head, batch = re.compile(self.head), []
        for path, start, end in partition.parts:
            system, inner = located(path)
            with system.open_input_file(inner) as file:
                for at in range(start, end, self.bytes):
                    for record in range_records(file, at, min(at + self.bytes, end), head, self.lines):
                        batch.append(record)
                        if len(batch) == BATCH:
                            yield pa.RecordBatch.from_arrays([pa.array(batch, pa.string())], ["value"])
                            batch = []
        if batch:
            yield pa.RecordBatch.from_arrays([pa.array(batch, pa.string())], ["value"])


class RecordSource(DataSource):
    """``spark.read.format("multi_line_records")`` with options ``files`` (JSON of path and length), ``head``, ``lines``, ``rangeBytes``, ``slots``
    (into how many tasks to deal the ranges, if they are no more than RANGE_BYTES each)."""

    @classmethod
    def name(cls) -> str:
        return "multi_line_records"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> RecordReader:
        return RecordReader(self.options)


def read_records(spark: SparkSession, path, head: str, lines: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``value``: a record per row. Spark lists the files (folders, globs and lists of paths); their contents are read in ranges."""
    files = spark.read.format("binaryFile").load(path).select("path", "length").collect()  # as many rows as files
    spark.dataSource.register(RecordSource)
    return (spark.read.format("multi_line_records")
            .options(files=json.dumps([[f.path, f.length] for f in files]), head=head, lines=str(lines), rangeBytes=str(range_bytes),
                     slots=str(4 * spark.sparkContext.defaultParallelism)).load())
