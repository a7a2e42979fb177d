"""Batch reading of log files, and of byte ranges of them, with lines as bytes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHUNK = 65536
LINES = "path string, generation int, line_offset long, line binary"


class LineSplitter:
    """Complete lines of successive chunks: ended by \\n, without one \\r before it; the rest is carried over."""

    def __init__(self) -> None:
        self.carry = b""

    def feed(self, chunk: bytes) -> list[bytes]:
        *lines, self.carry = (self.carry + chunk).split(b"\n") if b"\n" in chunk else (self.carry + chunk,)
        return [line.removesuffix(b"\r") for line in lines]


def lines_between(path: str, start: int, end: int, chunk: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(offset, line) of the complete lines in a byte range, read a chunk at a time."""
    size, at, splitter = chunk if chunk > 0 else CHUNK, start, LineSplitter()
    with open(path, "rb") as file:
        file.seek(start)
        left = end - start
        while left > 0 and (data := file.read(min(size, left))):
            left -= len(data)
            carried, splitter.carry = splitter.carry, b""
            *whole, splitter.carry = (carried + data).split(b"\n") if b"\n" in data else (carried + data,)
            for line in whole:
                yield at, line.removesuffix(b"\r")
                at += len(line) + 1


def _range_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["path", "generation", "line_offset", "line"]
    types = (pa.string(), pa.int32(), pa.int64(), pa.binary())

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    for batch in batches:
        for path, generation, start, end in zip(*(c.to_pylist() for c in batch.columns)):
            rows: list[tuple] = []
            try:
                for offset, line in lines_between(path, start, end):
                    rows.append((path, generation, offset, line))
                    if len(rows) == 8192:
                        yield table(rows)
                        rows = []
            except FileNotFoundError:  # the file went since it was listed; what was read before counts
                pass  # any other error fails the task: the offset is past this range, so its lines mustn't be left out
            if rows:
                yield table(rows)


def read_ranges(ranges: DataFrame) -> DataFrame:
    """Lines of the byte ranges (path, generation, start, end), read by the executors."""
    return ranges.select("path", F.col("generation").cast("int"), F.col("start").cast("long"), F.col("end").cast("long")).mapInArrow(_range_batches, LINES)


def read_logs(spark: SparkSession, folder: str, recursive: bool = False) -> DataFrame:
    """(path, generation, line_offset, line) of the .log and .txt files of a folder on any file system.

    Bytes stay as they are (a BOM and single \\r too, as Spark's text reader would not); a last line without \\n is left out.
    Each file is one row until it is split, so it has to fit into a task's memory; ranges suit larger ones.
    """
    reader = spark.read.format("binaryFile").option("pathGlobFilter", "*.{log,txt,LOG,TXT,Log,Txt}").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(folder).select("path", "content").mapInArrow(_content_batches, LINES)


def _content_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
            *lines, _ = content.as_py().split(b"\n")
            at, offsets = 0, []
            for line in lines:
                offsets.append(at)
                at += len(line) + 1
            yield pa.RecordBatch.from_arrays([pa.array([path] * len(lines), pa.string()), pa.array([1] * len(lines), pa.int32()), pa.array(offsets, pa.int64()), pa.array([line.removesuffix(b"\r") for line in lines], pa.binary())], ["path", "generation", "line_offset", "line"])
