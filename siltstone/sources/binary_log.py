"""Spark data source for checksummed binary logs: one file is one partition, since records have no
sync markers; files are independent, so a directory reads in parallel.

Format `checked_log`: files of nine digits and `.data`; rows of every record up to the first one
that is cut off or corrupt, which is reported as a last row with its outcome. Option `index`
(true) reads `.hint` files instead: keys and places without values; an index counts whole or not at
all, so a bad one yields a single row with outcome `corrupt`.

The reader opens files by path on the executor; for a store that only Spark reads, load the files
with binaryFile and use decode_frame().
"""

from __future__ import annotations

import os
import re
import struct
import time
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from siltstone.functions.scalars import INDEX_HEADER, KEY_LIMIT, RECORD_HEADER, VALUE_LIMIT

SCHEMA = "file_id bigint, offset bigint, record_size bigint, seq bigint, tombstone boolean, key binary, value binary, outcome string"
HEAD = struct.Struct("<IQIIB")
INDEX_HEAD = struct.Struct("<IQIIQB")
SIGNED = 1 << 63


def encode(seq: int, tombstone: bool, key: bytes, value: bytes) -> bytes:
    """A record: checksum of all that follows it, number, sizes, flags, key, value."""
    rest = HEAD.pack(0, seq, len(key), len(value), int(tombstone))[4:] + key + value
    return struct.pack("<I", zlib.crc32(rest)) + rest


def decode(data: bytes, at: int) -> tuple[str, tuple | None]:
    """(`ok`, (seq, tombstone, key, value, size)), or (`truncated` or `corrupt`, None).

    The order of the checks matters: sizes and flags that can't be are corrupt even where the
    record would also end beyond the data."""
    if len(data) - at < RECORD_HEADER:
        return "truncated", None
    crc, seq, n_key, n_value, flags = HEAD.unpack_from(data, at)
    if not 0 < n_key <= KEY_LIMIT or n_value > VALUE_LIMIT or flags > 1:
        return "corrupt", None
    size = RECORD_HEADER + n_key + n_value
    if len(data) - at < size:
        return "truncated", None
    if zlib.crc32(memoryview(data)[at + 4 : at + size]) != crc or seq >= SIGNED:
        return "corrupt", None
    key = data[at + RECORD_HEADER : at + RECORD_HEADER + n_key]
    return "ok", (seq, bool(flags), key, data[at + RECORD_HEADER + n_key : at + size], size)


def records(file_id: int, data: bytes) -> Iterator[tuple]:
    """Rows of a file: its valid prefix, then what ended it, if bytes are left."""
    at = 0
    while at < len(data):
        outcome, r = decode(data, at)
        if r is None:
            yield file_id, at, len(data) - at, None, None, None, None, outcome
            return
        yield file_id, at, r[4], r[0], r[1], r[2], r[3], "ok"
        at += r[4]


def encode_index(seq: int, tombstone: bool, key: bytes, size: int, offset: int) -> bytes:
    rest = INDEX_HEAD.pack(0, seq, len(key), size, offset, int(tombstone))[4:] + key
    return struct.pack("<I", zlib.crc32(rest)) + rest


def index_entries(file_id: int, data: bytes, log_size: int) -> Iterator[tuple]:
    """Rows of an index, or one corrupt row if any entry is bad or points outside its log."""
    at, rows = 0, []
    while at < len(data):
        if len(data) - at < INDEX_HEADER:
            break
        crc, seq, n_key, size, offset, flags = INDEX_HEAD.unpack_from(data, at)
        end = at + INDEX_HEADER + n_key
        if end > len(data) or zlib.crc32(memoryview(data)[at + 4 : end]) != crc or offset + size > log_size or seq >= SIGNED:
            break
        rows.append((file_id, offset, size, seq, bool(flags & 1), data[at + INDEX_HEADER : end], None, "ok"))
        at = end
    yield from rows if at == len(data) else [(file_id, 0, len(data), None, None, None, None, "corrupt")]


def data_files(folder: str) -> list[tuple[int, str]]:
    """(file_id, path) of the log files of a folder, ascending; other names are ignored."""
    found = sorted(n for n in os.listdir(folder) if re.fullmatch(r"[0-9]{9}\.data", n))
    return [(int(n[:9]), os.path.join(folder, n)) for n in found]


def remove_leftovers(folder: str, own: set[str] = frozenset(), age: float = 3600.0) -> None:
    """Removes temporary files of writers that died: those older than ``age`` seconds."""
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        if name.endswith(".tmp") and path not in own and time.time() - os.path.getmtime(path) >= age:
            os.remove(path)


@dataclass
class LogFile(InputPartition):
    file_id: int
    path: str


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder, self.index = options["path"].removeprefix("file://"), options.get("index", "false").lower() == "true"

    def partitions(self) -> list[LogFile]:
        return [LogFile(i, p) for i, p in data_files(self.folder) if os.path.getsize(p)] or [LogFile(0, "")]

    def read(self, partition: LogFile) -> Iterator[tuple]:
        if not partition.path:
            return
        hint = partition.path[: -len("data")] + "hint"
        if self.index and os.path.exists(hint):
            with open(hint, "rb") as f:
                rows = list(index_entries(partition.file_id, f.read(), os.path.getsize(partition.path)))
            if not rows or rows[0][7] == "ok":
                yield from rows
                return
        with open(partition.path, "rb") as f:
            yield from records(partition.file_id, f.read())


@dataclass
class Written(WriterCommitMessage):
    paths: list


class _Writer(DataSourceWriter):
    """Each task writes one file under a temporary name; commit publishes them under the next file
    numbers, in task order, and abort removes them."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"].removeprefix("file://")

    def write(self, rows: Iterator) -> Written:
        from pyspark import TaskContext

        os.makedirs(self.folder, exist_ok=True)
        path = os.path.join(self.folder, f"{TaskContext.get().taskAttemptId():09d}.tmp")
        size = 0
        with open(path, "wb") as f:
            for r in rows:
                size += f.write(encode(r["seq"], r["tombstone"], bytes(r["key"]), b"" if r["tombstone"] else bytes(r["value"] or b"")))
            f.flush()
            os.fsync(f.fileno())
        if not size:
            os.remove(path)
        return Written([path] if size else [])

    def commit(self, messages: list) -> None:
        own = {p for m in messages if m for p in m.paths}
        last = max((i for i, _ in data_files(self.folder)), default=0)
        for k, path in enumerate((p for m in messages if m for p in m.paths), last + 1):
            os.rename(path, os.path.join(self.folder, f"{k:09d}.data"))
        remove_leftovers(self.folder, own)

    def abort(self, messages: list) -> None:
        for path in (p for m in messages if m for p in m.paths):
            if os.path.exists(path):
                os.remove(path)


class CheckedLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "checked_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CheckedLog)


def decode_frame(files: DataFrame) -> DataFrame:
    """Log rows of binaryFile rows (path, content), for any file system that Spark reads."""
    import pandas as pd

    numbered = files.select(F.regexp_extract("path", r"([0-9]{9})\.data$", 1).try_cast("bigint").alias("file_id"), "content").filter("file_id is not null and length(content) > 0")

    def run(batches: Iterator) -> Iterator:
        for b in batches:
            for i, data in zip(b["file_id"], b["content"], strict=True):
                rows = records(int(i), bytes(data))
                while chunk := [r for _, r in zip(range(5000), rows)]:  # noqa: B905
                    yield pd.DataFrame(chunk, columns=[c.split()[0] for c in SCHEMA.split(", ")]).astype({"seq": "Int64", "tombstone": "boolean"})

    return numbered.mapInPandas(run, SCHEMA)
