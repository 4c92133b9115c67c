"""From an ordered mutation log to state: newest wins, tombstones go last."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.codec import DELETE


def latest(log: DataFrame, keys: Sequence[str] = ("key",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """The newest version of every key, tombstones included.

    Associative, commutative and idempotent for a total order, so it runs as
    a map-side partial aggregate: a hot key sends one row per map task.  Rows
    whose first ordering column is null are refused by ``require_order``.
    """
    rest = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("_n")
    return log.groupBy(*keys).agg(newest).select(*keys, "_n.*")


def live(versions: DataFrame) -> DataFrame:
    """Drop tombstones: every other kind is a put.  Only above ``latest``."""
    return versions.where(F.col("kind") != DELETE)


def latest_state(log: DataFrame, keys: Sequence[str] = ("key",), order: Sequence[str] = ("seq",)) -> DataFrame:
    """The live pairs of a log."""
    return live(latest(log, keys, order)).drop("kind")


def require_order(log: DataFrame, order: str = "seq") -> DataFrame:
    """Fail the job on a null position instead of losing the row silently."""
    return log.withColumn(order, F.when(F.col(order).isNull(), F.raise_error(F.lit(f"null {order}"))).otherwise(F.col(order)))


def items(log: DataFrame) -> DataFrame:
    """All live pairs in key order."""
    return latest_state(log).orderBy("key")


def point_get(log: DataFrame, key: object) -> DataFrame:
    """No row means not found; the key filter reaches the scan."""
    return latest_state(log).where(F.col("key") == F.lit(key))


def lookup(log: DataFrame, key: object) -> DataFrame:
    """Three-valued lookup: no row (absent), or the version with its kind."""
    return latest(log).where(F.col("key") == F.lit(key))


def multi_get(log: DataFrame, wanted: DataFrame) -> DataFrame:
    """Every wanted key with a found flag.  The join side is left to AQE."""
    state = latest_state(log).withColumn("found", F.lit(1))
    return wanted.select("key").distinct().join(state, "key", "left").withColumn("found", F.coalesce("found", F.lit(0)))


def tombstoned(log: DataFrame) -> DataFrame:
    """Keys whose newest version is a delete."""
    return latest(log).where(F.col("kind") == DELETE)


def range_scan(log: DataFrame, low: object, high: object) -> DataFrame:
    """Extension: live pairs with low <= key < high, in key order."""
    return items(log).where((F.col("key") >= F.lit(low)) & (F.col("key") < F.lit(high)))


def replay_until(log: DataFrame, position: int) -> DataFrame:
    """State as it was after ``position``."""
    return latest_state(log.where(F.col("seq") <= position))


def snapshot(log: DataFrame, position: int) -> DataFrame:
    """The versions at ``position``, tombstones gone: everything newer follows in the tail."""
    return live(latest(log.where(F.col("seq") <= position)))


def restore(snap: DataFrame, log: DataFrame, position: int) -> DataFrame:
    """Snapshot plus the tail after it equals a full replay."""
    return latest_state(snap.unionByName(log.where(F.col("seq") > position)))


def flush_runs(log: DataFrame) -> DataFrame:
    """Each run keeps the last write of each of its keys, deletes included."""
    return latest(log, ("run_seq", "key"))


def merge_runs(runs: DataFrame, low: int, high: int) -> DataFrame:
    """Partial compaction of runs low..high into run ``high``: tombstones stay,
    for an older run may still hold the key."""
    part = runs.where(F.col("run_seq").between(low, high))
    return latest(part, ("key",), ("run_seq", "seq")).withColumn("run_seq", F.lit(high).cast("bigint"))


def compact(runs: DataFrame) -> DataFrame:
    """Full compaction: newest run wins, tombstones are dropped."""
    return live(latest(runs, ("key",), ("run_seq", "seq")))


def run_hits(runs: DataFrame) -> DataFrame:
    """How many keys a newest-first lookup finds in each run."""
    newest = runs.groupBy("key").agg(F.max("run_seq").alias("run_seq"))
    return newest.groupBy("run_seq").agg(F.count(F.lit(1)).alias("n_keys"))


def shard_of(key: Column, shards: int) -> Column:
    """Extension: a stable shard from the bytes of the key."""
    return F.pmod(F.crc32(key.cast("binary")), F.lit(shards))


def diff_state(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs in one state and not the other; empty when replicas converge."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))
