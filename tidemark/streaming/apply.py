"""The continuous apply loop: ordered mutations into keyed state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType

from tidemark.operators.state import latest, latest_state
from tidemark.session import scratch_path, ship_package


def _sink(folder: str) -> Callable[[DataFrame, int], None]:
    """Each batch goes to a folder of its own, so a repeated batch overwrites
    itself and changes nothing."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return write


def apply_stream(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Latest version per key in streaming state; changed keys are emitted
    (deletes as tombstones) to ``folder``.  Runs until the input is used up."""
    changed = latest(stream)
    changed.writeStream.outputMode("update").foreachBatch(_sink(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def flush_stream(stream: DataFrame, folder: str, checkpoint: str) -> None:
    """Every micro-batch becomes one run with one version per key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        latest(batch).withColumn("run_seq", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{folder}/run={batch_id}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def emitted_state(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """Live pairs from what a stream has emitted; re-delivery is harmless."""
    read = spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(folder)
    return latest_state(read)


class KeyedApply(StatefulProcessor):
    """Custom state machine hook: ``reduce(old, new)`` decides what a key holds;
    the default is newest position wins.  State lives in RocksDB.

    Rows go through Python one by one, which only a custom reducer needs;
    ``apply_stream`` is the JVM's way.  A batch's rows of a key may come in
    several parts, each sorted by position: a reducer must not depend on the
    order of arrival beyond what the positions say."""

    def __init__(self, reduce: Callable | None = None):
        self.reduce = reduce or (lambda old, new: new if old is None or new[0] >= old[0] else old)

    def init(self, handle):
        self.state = handle.getValueState("version", "seq bigint, kind int, value double")

    def handleInputRows(self, key, rows, timer_values):
        import pandas as pd

        held = tuple(self.state.get()) if self.state.exists() else None
        for part in rows:
            for row in part.sort_values("seq")[["seq", "kind", "value"]].itertuples(index=False):
                held = self.reduce(held, (int(row[0]), int(row[1]), float(row[2])))
        if held is not None:
            self.state.update(held)
            yield pd.DataFrame({"key": [key[0]], "seq": [held[0]], "kind": [held[1]], "value": [held[2]]})

    def close(self):
        pass


def keyed_apply_stream(stream: DataFrame, folder: str, checkpoint: str, reduce: Callable | None = None) -> None:
    """``apply_stream`` through a stateful processor, for custom reducers."""
    ship_package(stream.sparkSession)
    name, conf = "spark.sql.streaming.stateStore.providerClass", stream.sparkSession.conf
    held = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        out = stream.groupBy("key").transformWithStateInPandas(KeyedApply(reduce), "key string, seq bigint, kind int, value double", "Update", "None")
        out.writeStream.outputMode("update").foreachBatch(_sink(folder)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        conf.set(name, held)


def snapshot_due(applied: int, snapshot_idx: int, every: int = 50) -> bool:
    """Whether the applied index has passed a multiple of ``every`` since the
    last snapshot."""
    return applied // every > snapshot_idx // every


def events_stream(spark: SparkSession, sf_dir: str, files_per_batch: int | None = None, bytes_per_batch: str | None = None) -> DataFrame:
    """Adapter A as a stream of files; a batch takes ``files_per_batch`` files
    or ``bytes_per_batch`` ("64m") at most, so that a slow sink holds the
    source back."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    elif bytes_per_batch:
        reader = reader.option("maxBytesPerTrigger", bytes_per_batch)
    raw = reader.option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").parquet(f"{sf_dir}/events.parque[t]")
    digit = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint") % 10
    return raw.select(
        F.concat_ws(":", F.col("user_id").cast("string"), digit.cast("string")).alias("key"),
        F.col("event_id").alias("seq"), F.when(F.col("event_type") == "error", 1).otherwise(0).alias("kind"), "value",
    )


def run_events(spark: SparkSession, sf_dir: str, how: Callable = apply_stream) -> DataFrame:
    """Drain the events through ``how`` and read the state back."""
    stream = events_stream(spark, sf_dir)
    folder = scratch_path(spark, "stream")
    how(stream, f"{folder}/out", f"{folder}/checkpoint")
    return emitted_state(spark, f"{folder}/out", stream.select("key", "seq", "kind", "value").schema).select("key", "seq", "value")
