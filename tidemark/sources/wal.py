"""The byte format of mutation logs: framing, replay and a Spark data source.

Replay yields the longest valid prefix: a torn header, a torn body, a bad
checksum or a bad frame ends it quietly, and records after it are not read.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.session import ship_package

SCHEMA = "file string, seq bigint, key binary, kind tinyint, value binary"


def pack_frame(kind: int, key: bytes, value: bytes | None) -> bytes:
    value = value or b""
    return struct.pack("<BI", kind, len(key)) + key + struct.pack("<I", len(value)) + value


def unpack_frame(body: bytes) -> tuple[int, bytes, bytes] | None:
    """(kind, key, value), or None where a length does not fit."""
    if len(body) < 9:
        return None
    kind, key_len = struct.unpack_from("<BI", body)
    if 9 + key_len > len(body):
        return None
    (value_len,) = struct.unpack_from("<I", body, 5 + key_len)
    if 9 + key_len + value_len != len(body):
        return None
    return kind, body[5 : 5 + key_len], body[9 + key_len :]


def pack_record(kind: int, key: bytes, value: bytes | None) -> bytes:
    body = pack_frame(kind, key, value)
    return struct.pack("<II", zlib.crc32(body), len(body)) + body


def pack_log(mutations: Iterable[tuple[int, bytes, bytes | None]]) -> bytes:
    return b"".join(pack_record(*m) for m in mutations)


def replay(data: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """Mutations of the longest valid prefix."""
    at = 0
    while at + 8 <= len(data):
        crc, size = struct.unpack_from("<II", data, at)
        body = data[at + 8 : at + 8 + size]
        if len(body) < size or zlib.crc32(body) != crc or (found := unpack_frame(body)) is None:
            return
        yield found
        at += 8 + size


def replay_stream(source) -> Iterator[tuple[int, bytes, bytes]]:
    """``replay`` of an open file, one record at a time."""
    while len(head := source.read(8)) == 8:
        crc, size = struct.unpack("<II", head)
        body = source.read(size)
        if len(body) < size or zlib.crc32(body) != crc or (found := unpack_frame(body)) is None:
            return
        yield found


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Replay every log file under ``path`` (any file system Spark can open).

    One file is one task's work: the format has no split points.  Spark hands
    over a file's bytes as a whole (files beyond 2 GB need the data source
    below, which streams); records go on in batches.  A folder without log
    files gives no rows.
    """
    ship_package(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def parse(batches):
        import pandas as pd

        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                rows = ((name, i, k, kind - 256 if kind > 127 else kind, v) for i, (kind, k, v) in enumerate(replay(content)))
                while part := list(itertools.islice(rows, 10_000)):
                    yield pd.DataFrame(part, columns=["file", "seq", "key", "kind", "value"])

    return files.mapInPandas(parse, SCHEMA)


def write_logs(log: DataFrame, path: str) -> None:
    """Append a mutation log (seq, key, kind, value) as Parquet, in order
    within each file; the byte format is for exchange, Parquet is at rest."""
    log.select("seq", F.col("key"), F.col("kind"), F.col("value")).sortWithinPartitions("seq").write.mode("append").parquet(path)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WalReader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def partitions(self):
        return [_File(p) for p in self.paths]

    def read(self, partition):
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(partition.path) if "://" in partition.path else (fs.LocalFileSystem(), partition.path)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            return
        with store.open_input_stream(path, buffer_size=1 << 20) as f:
            for i, (kind, key, value) in enumerate(replay_stream(f)):
                yield (partition.path, i, key, kind - 256 if kind > 127 else kind, value)


class WalDataSource(DataSource):
    """``spark.dataSource.register(WalDataSource)``; then
    ``spark.read.format("kvwal").load("a.log,b.log")``.  A missing file is empty."""

    @classmethod
    def name(cls):
        return "kvwal"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WalReader(self.options)
