"""A durable versioned table: Parquet log and runs behind numbered pointers.

Folder layout: ``log/`` appended batches, ``runs/`` immutable runs, each in a
folder of a new name, ``pointer/p-<n>`` the states (lists of runs and batches,
next run, log low-water mark).  A change writes new files first and then moves the pointer by one rename that
never overwrites; files are deleted only afterwards, so a crash at any step
leaves the old or the new state, never a mixture, and of two writers one gets
``Conflict``.  A flush writes the tail as one new run and resets the log; older
runs are not touched until a compaction.
"""

from __future__ import annotations

import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import state
from tidemark.operators.pointer import Pointers
from tidemark.session import hadoop_path, remove

LOG = "seq bigint, key binary, kind tinyint, value binary"
RUN = "run_seq bigint, seq bigint, key binary, kind tinyint, value binary"


class NotFound(KeyError):
    """The key is absent or deleted."""


class PositionGone(LookupError):
    """A flush or compaction has dropped the versions of a position."""


@dataclass(frozen=True)
class Options:
    """A tail of ``flush_rows`` mutations, ``flush_bytes`` bytes or
    ``flush_batches`` appends becomes a run; ``compaction_trigger`` runs become
    one."""

    flush_rows: int = 1_000_000
    compaction_trigger: int = 4
    flush_bytes: int = 256 << 20
    flush_batches: int = 1000


@dataclass(frozen=True)
class Pointer:
    """``runs``: [last position, folder] of each run, oldest first;
    ``batches``: the log's folders in order."""

    version: int = 0
    runs: list[list] = field(default_factory=list)
    batches: list[str] = field(default_factory=list)
    next_run: int = 1
    flushed_seq: int = -1
    next_seq: int = 0
    tail_bytes: int = 0

    @property
    def n_runs(self) -> int:
        return len(self.runs)


class VersionedTable:
    """One writer at a time (a second one is refused), any number of readers."""

    def __init__(self, spark: SparkSession, root: str, options: Options = Options()):
        self.spark, self.root, self.options = spark, root.rstrip("/"), options
        self.pointers = Pointers(spark, f"{self.root}/pointer")
        self.at = self._load()

    # -- pointer ---------------------------------------------------------
    def _load(self) -> Pointer:
        _, found = self.pointers.read()
        return Pointer(**found) if found else Pointer()

    def _swap(self, to: Pointer) -> None:
        to = replace(to, version=self.at.version + 1)
        self.pointers.swap(to.version, asdict(to))
        self.at = to

    # -- reads -----------------------------------------------------------
    def _read(self, paths: list[str], schema: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def _folders(self, kind: str) -> list[str]:
        fs, folder = hadoop_path(self.spark, f"{self.root}/{kind}")
        return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []

    def runs(self) -> DataFrame:
        return self._read([f"{self.root}/runs/{name}" for _, name in self.at.runs], RUN)

    def tail(self) -> DataFrame:
        """Mutations that no run holds yet."""
        return self._read([f"{self.root}/log/{name}" for name in self.at.batches], LOG)

    def versions(self) -> DataFrame:
        return self.runs().drop("run_seq").unionByName(self.tail())

    def items(self) -> DataFrame:
        """Live pairs in key order (unsigned bytes)."""
        return state.items(self.versions()).select("key", "value")

    def as_of(self, position: int) -> DataFrame:
        """State after ``position``: exact for every position of the tail and
        for the ends of the runs that are left.  A run holds one version per
        key, so any other position is refused with ``PositionGone``."""
        ends = [-1, *(end for end, _ in self.at.runs)]
        if position < self.at.flushed_seq and position not in ends:
            raise PositionGone(f"{position}: of the positions up to {self.at.flushed_seq} only {ends} are left")
        return state.replay_until(self.versions(), position).select("key", "value")

    def get(self, key: bytes) -> bytes:
        found = state.point_get(self.versions(), bytearray(key)).select("value").head()
        if found is None:
            raise NotFound(key)
        return bytes(found[0])

    def multi_get(self, wanted: DataFrame) -> DataFrame:
        return state.multi_get(self.versions(), wanted).select("key", "found", "value")

    # -- writes ----------------------------------------------------------
    def append(self, mutations: DataFrame) -> None:
        """Add (seq, key, kind, value); ``seq`` counts from 0 within the batch
        and is moved behind the log's end."""
        base = self.at.next_seq
        moved = state.require_order(mutations).select(
            (F.col("seq") + base).cast("bigint").alias("seq"), F.col("key").cast("binary").alias("key"), F.col("kind").cast("tinyint").alias("kind"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value")
        )
        name = f"b-{base:020d}-{uuid.uuid4().hex}"
        path = f"{self.root}/log/{name}"
        moved.write.parquet(path)
        size = F.octet_length("key") + F.octet_length("value") + 9
        top, n_bytes = self.spark.read.schema(LOG).parquet(path).agg(F.max("seq"), F.sum(size)).head()
        if top is None:
            remove(self.spark, path)
            return
        self._swap(replace(self.at, next_seq=top + 1, tail_bytes=self.at.tail_bytes + n_bytes, batches=[*self.at.batches, name]))
        at, most = self.at, self.options
        if at.next_seq - 1 - at.flushed_seq >= most.flush_rows or at.tail_bytes >= most.flush_bytes or len(at.batches) >= most.flush_batches:
            self.flush()

    def write(self, rows: list[tuple[int, bytes, bytes]]) -> None:
        """A few (kind, key, value) mutations from the driver, in order."""
        self.append(self.spark.createDataFrame([(i, bytearray(k), kind, bytearray(v)) for i, (kind, k, v) in enumerate(rows)], LOG))

    def put(self, key: bytes, value: bytes) -> None:
        self.write([(0, key, value)])

    def delete(self, key: bytes) -> None:
        self.write([(1, key, b"")])

    def _write_run(self, run: DataFrame, end: int, older: list[list], **change) -> None:
        """A new run behind ``older`` ones.  It lies sorted by key with a bloom
        filter, so lookups prune files."""
        at = self.at
        name = f"r-{at.next_run:010d}-{uuid.uuid4().hex}"
        run = run.withColumn("run_seq", F.lit(at.next_run).cast("bigint")).select("run_seq", "seq", "key", "kind", "value")
        run.repartitionByRange("key").sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.root}/runs/{name}")
        self._swap(replace(at, runs=[*older, [end, name]], next_run=at.next_run + 1, **change))

    def flush(self) -> None:
        """The tail becomes one new run and the log is reset; an empty tail is
        a no-op.  Runs that are there are not read."""
        at = self.at
        end = at.next_seq - 1
        if end == at.flushed_seq:
            return
        self._write_run(state.latest(self.tail()), end, at.runs, flushed_seq=end, batches=[], tail_bytes=0)
        for name in at.batches:
            remove(self.spark, f"{self.root}/log/{name}")
        if self.at.n_runs >= self.options.compaction_trigger:
            self.compact()

    def compact(self) -> None:
        """All runs into one; tombstones go, for nothing older is left."""
        if not self.at.n_runs:
            return
        one = state.compact(self.runs()).withColumn("kind", F.lit(0).cast("tinyint"))
        self._write_run(one, self.at.flushed_seq, [])

    def vacuum(self) -> None:
        """Delete what the pointer has left behind: runs, log batches, older
        pointers.  Not while others still read an older state or write."""
        for kind, held in (("runs", {name for _, name in self.at.runs}), ("log", set(self.at.batches))):
            for name in self._folders(kind):
                if name not in held:
                    remove(self.spark, f"{self.root}/{kind}/{name}")
        self.pointers.tidy()
