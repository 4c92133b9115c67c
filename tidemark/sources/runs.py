"""The byte format of runs: sorted entries, bloom filter, sparse index, footer.

Entries ``key length u32, key, kind u8, value length u32, value`` in key order;
the filter (``probes u32, bits u32``, the bits); the index ``count u32`` and
``key length u32, key, offset u64`` of every 16th entry; the footer of five u64:
offset and length of filter and index, and the magic number.  All numbers are
little-endian.  Writers and readers go through a file in blocks; neither holds
a whole run.
"""

from __future__ import annotations

import bisect
import itertools
import operator
import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tidemark.functions.hashing import FNV_OFFSET, FNV_PRIME, MASK32, bloom_bits, bloom_probes
from tidemark.session import ship_package

# Fixed values of the format.
MAGIC = 0x5153535442303031
INDEX_EVERY = 16
FOOTER = 40
U32, KIND_U32 = struct.Struct("<I").pack, struct.Struct("<BI").pack

SCHEMA = "file string, key binary, kind tinyint, value binary"
READ = 1 << 20
#: A task reads files of so many bytes together, one file at least.
TASK_BYTES = 4 << 20
#: Rows and bytes of entries that go on together from a reader.
BATCH_ROWS = 4096
#: Longer keys are hashed one by one.
LONG_KEY = 256


class CorruptRun(ValueError):
    """Too short, a foreign magic number, or an index that ends early."""


def signed(kind: int) -> int:
    return kind - 256 if kind > 127 else kind


def key_hashes(key: bytes) -> tuple[int, int]:
    h1 = h2 = FNV_OFFSET
    for b in key:
        h1, h2 = (h1 ^ b) * FNV_PRIME & MASK32, h2 * FNV_PRIME & MASK32 ^ b
    return h1, h2


def hash_all(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """``key_hashes`` of all keys, one step for the bytes at one place."""
    lengths = np.fromiter(map(len, keys), np.int64, len(keys))
    data, starts = np.frombuffer(b"".join(keys), np.uint8), np.cumsum(lengths) - lengths
    h1, h2 = np.full(len(keys), FNV_OFFSET, np.uint64), np.full(len(keys), FNV_OFFSET, np.uint64)
    prime, mask = np.uint64(FNV_PRIME), np.uint64(MASK32)
    at, place = np.flatnonzero((lengths > 0) & (lengths <= LONG_KEY)), 0
    while len(at):
        b = data[starts[at] + place].astype(np.uint64)
        h1[at], h2[at] = (h1[at] ^ b) * prime & mask, h2[at] * prime & mask ^ b
        place += 1
        at = at[lengths[at] > place]
    for i in np.flatnonzero(lengths > LONG_KEY):
        h1[i], h2[i] = key_hashes(keys[i])
    return h1, h2


class RunWriter:
    """Entries in key order to an open file; ``bits`` and ``probes`` size the
    filter beforehand, so keys are not kept."""

    def __init__(self, out: BinaryIO, bits: int, probes: int):
        self.out, self.m, self.k = out, bits, probes
        self.filter = np.zeros((bits + 7) // 8, np.uint8)
        self.index: list[tuple[bytes, int]] = []
        self.n, self.at, self.last = 0, 0, None

    def add(self, key: bytes, kind: int, value: bytes) -> None:
        self.add_all([key], [kind], [value])

    def add_all(self, keys: list[bytes], kinds: list[int], values: list[bytes]) -> None:
        """Many entries at once: one write, and filter bits set together."""
        if not keys:
            return
        if (self.last is not None and keys[0] <= self.last) or any(map(operator.ge, keys, keys[1:])):
            raise ValueError("keys of a run ascend")
        h1, h2 = hash_all(keys)
        for i in range(self.k):
            pos = (h1 + np.uint64(i) * h2 & np.uint64(MASK32)) % np.uint64(self.m)
            np.bitwise_or.at(self.filter, (pos >> np.uint64(3)).astype(np.int64), np.uint8(1) << (pos & np.uint64(7)).astype(np.uint8))
        parts, at = [], self.at
        for n, (key, kind, value) in enumerate(zip(keys, kinds, values, strict=True), self.n):
            if n % INDEX_EVERY == 0:
                self.index.append((key, at))
            parts += (U32(len(key)), key, KIND_U32(kind & 255, len(value)), value)
            at += 9 + len(key) + len(value)
        self.out.write(b"".join(parts))
        self.n, self.at, self.last = self.n + len(keys), at, keys[-1]

    def close(self) -> None:
        block = struct.pack("<II", self.k, self.m) + self.filter.tobytes()
        anchors = struct.pack("<I", len(self.index)) + b"".join(struct.pack("<I", len(k)) + k + struct.pack("<Q", o) for k, o in self.index)
        self.out.write(block + anchors + struct.pack("<5Q", self.at, len(block), self.at + len(block), len(anchors), MAGIC))


def decode_index(data: bytes) -> list[tuple[bytes, int]]:
    """(key, offset) of the anchors."""
    if len(data) < 4:
        raise CorruptRun("index")
    out, at = [], 4
    for _ in range(struct.unpack_from("<I", data)[0]):
        if at + 4 > len(data):
            raise CorruptRun("index")
        (n,) = struct.unpack_from("<I", data, at)
        if at + 12 + n > len(data):
            raise CorruptRun("index")
        out.append((data[at + 4 : at + 4 + n], struct.unpack_from("<Q", data, at + 4 + n)[0]))
        at += 12 + n
    return out


class RunReader:
    """An open run: filter and index in memory, entries read on demand."""

    def __init__(self, source: BinaryIO, size: int):
        self.source = source
        if size < FOOTER:
            raise CorruptRun("too short")
        filter_at, filter_len, index_at, index_len, magic = struct.unpack("<5Q", self._read(size - FOOTER, FOOTER))
        if magic != MAGIC:
            raise CorruptRun("magic number")
        block = self._read(filter_at, filter_len)
        self.k, self.m = struct.unpack_from("<II", block)
        self.filter, self.end = block[8:], filter_at
        self.index = decode_index(self._read(index_at, index_len))
        self.anchors = [k for k, _ in self.index]

    def _read(self, at: int, n: int) -> bytes:
        self.source.seek(at)
        data = self.source.read(n)
        if len(data) < n:
            raise CorruptRun("torn")
        return data

    def may_contain(self, key: bytes) -> bool:
        h1, h2 = key_hashes(key)
        places = [(h1 + i * h2 & MASK32) % self.m for i in range(self.k)]
        return all(self.filter[p >> 3] >> (p & 7) & 1 for p in places)

    def _entries(self, at: int, end: int) -> Iterator[tuple[bytes, int, bytes]]:
        data, low = b"", 0
        while at + low < end or low < len(data):
            need = 4
            for _ in range(3):  # the lengths say how much an entry needs
                if low + need > len(data):
                    at += low
                    data, low = self._read(at, min(max(READ, need), end - at)), 0
                    if need > len(data):
                        raise CorruptRun("entry")
                (n,) = struct.unpack_from("<I", data, low)
                need = 9 + n if need == 4 else 9 + n + struct.unpack_from("<I", data, low + 5 + n)[0]
            yield data[low + 4 : low + 4 + n], data[low + 4 + n], data[low + 9 + n : low + need]
            low += need
            if low == len(data):
                at, data, low = at + low, b"", 0

    def scan(self) -> Iterator[tuple[bytes, int, bytes]]:
        """(key, kind, value) of all entries in key order."""
        return self._entries(0, self.end)

    def get(self, key: bytes) -> tuple[int, bytes] | None:
        """(kind, value) of a key, by filter, anchor and one block; else None."""
        block = bisect.bisect_right(self.anchors, key)
        if not block or not self.may_contain(key):
            return None
        end = self.index[block][1] if block < len(self.index) else self.end
        for k, kind, value in self._entries(self.index[block - 1][1], end):
            if k >= key:
                return (kind, value) if k == key else None
        return None


def opened(path: str):
    """(file system, path) of pyarrow for a URI or a local path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def write_runs(runs: DataFrame, folder: str) -> DataFrame:
    """One file per run of (run_seq, key, kind, value) with distinct keys;
    returns run_seq, file, n_keys.  A run is one file and so one task's work
    (runs are cut by the flush threshold); its entries go through in batches,
    sorted and counted by Spark, which spills.  ``runs`` is computed once."""
    from tidemark.session import materialise

    ship_package(runs.sparkSession)
    value = F.coalesce(F.col("value").cast("binary"), F.lit(b""))
    entries = runs.where("run_seq is not null").select("run_seq", F.col("key").cast("binary").alias("key"), F.col("kind").cast("int").alias("kind"), value.alias("value"))
    n = F.count(F.lit(1)).over(Window.partitionBy("run_seq"))
    counted = entries.repartition("run_seq").withColumn("n", n)
    placed = counted.select("run_seq", "key", "kind", "value", bloom_bits(F.col("n")).alias("m"), bloom_probes(F.col("n"), bloom_bits(F.col("n"))).alias("k")).sortWithinPartitions("run_seq", "key")

    def write(batches):
        import uuid

        import pyarrow as pa

        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        run, out, path = None, None, None

        def done():
            run.close()
            out.close()
            return pa.RecordBatch.from_pylist([{"run_seq": number, "file": path, "n_keys": run.n}], pa.schema([("run_seq", pa.int64()), ("file", pa.string()), ("n_keys", pa.int64())]))

        number = None
        for batch in batches:
            each = batch.column("run_seq").to_numpy()
            keys, kinds, values = (batch.column(c).to_pylist() for c in ("key", "kind", "value"))
            bounds = [0, *(np.flatnonzero(each[1:] != each[:-1]) + 1), len(each)]
            for low, high in itertools.pairwise(bounds):
                if low == high:
                    continue
                if each[low] != number:
                    if run is not None:
                        yield done()
                    number = int(each[low])
                    path = f"{base}/run-{number:010d}-{uuid.uuid4().hex}.run"
                    out = store.open_output_stream(path)
                    run = RunWriter(out, batch.column("m")[low].as_py(), batch.column("k")[low].as_py())
                run.add_all(keys[low:high], kinds[low:high], values[low:high])
        if run is not None:
            yield done()

    return materialise(placed.mapInArrow(write, "run_seq bigint, file string, n_keys bigint"), "run-files")


def run_number(file: Column) -> Column:
    """The run_seq that ``write_runs`` has put into a file's name."""
    return F.regexp_extract(file, r"run-(-?\d+)-[0-9a-f]+\.run$", 1).cast("bigint")


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class RunSource(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]

    def partitions(self):
        """Consecutive files of TASK_BYTES together, for runs can be many and small."""
        parts, total = [], 0
        for p in self.paths:
            store, path = opened(p)
            size = store.get_file_info(path).size or 0
            if not parts or total + size > TASK_BYTES:
                parts.append([])
                total = 0
            parts[-1].append(p)
            total += size
        return [_Files(x) for x in parts]

    def read(self, partition):
        import pyarrow as pa

        schema = pa.schema([("file", pa.string()), ("key", pa.binary()), ("kind", pa.int8()), ("value", pa.binary())])
        for name in partition.paths:
            store, path = opened(name)
            size = store.get_file_info(path).size
            with store.open_input_file(path) as f:
                rows, held = [], 0
                batch = lambda rows, name=name: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(([name] * len(rows), *zip(*rows, strict=True)), schema.types, strict=True)], schema=schema)
                for key, kind, value in RunReader(f, size).scan():
                    rows.append((key, signed(kind), value))
                    held += len(key) + len(value)
                    if len(rows) >= BATCH_ROWS or held >= READ:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)


class RunDataSource(DataSource):
    """``spark.dataSource.register(RunDataSource)``; then
    ``spark.read.format("kvrun").load("a.run,b.run")``: a task reads whole
    files, small ones together."""

    @classmethod
    def name(cls):
        return "kvrun"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RunSource(self.options)


def read_runs(spark: SparkSession, paths: list[str]) -> DataFrame:
    """file, key, kind, value of run files; a task reads whole files."""
    spark.dataSource.register(RunDataSource)
    ship_package(spark)
    return spark.read.format("kvrun").load(",".join(paths))
