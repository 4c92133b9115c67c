"""The driver's tables seen as mutation logs, replicas and replicated logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import table

RUN_LENGTH = 1000


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key, seq, kind, value, run_seq: every event is a mutation, errors delete."""
    digit = F.regexp_extract("props", "([0-9]+)", 1).cast("bigint") % 10
    return table(spark, sf_dir, "events").select(
        F.concat_ws(":", F.col("user_id").cast("string"), digit.cast("string")).alias("key"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", 1).otherwise(0).alias("kind"),
        F.col("value"),
        F.floor(F.col("event_id") / RUN_LENGTH).alias("run_seq"),
    )


def pages_kv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """key (url), seq, kind; the html column is left out until it is asked for."""
    return table(spark, sf_dir, "pages").select(F.col("url").alias("key"), F.col("page_id").alias("seq"), F.lit(0).alias("kind"))


def replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, peer, match_idx: five peers per replica group."""
    return table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("group_id"), F.col("event_type").alias("peer")).agg(F.max("event_id").alias("match_idx"))


def raft_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, idx (from 1 by event order), n: the replicated log per group."""
    from tidemark.operators.ordered import dense_index

    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("group_id"), "event_id")
    return dense_index(events, "group_id", "event_id", "idx", "n").select("group_id", "idx", "n")


def leader_log(entries: DataFrame) -> DataFrame:
    """The leader misses its last three entries; terms last ten entries each."""
    return entries.where(F.col("idx") <= F.col("n") - 3).select("group_id", "idx", (1 + F.floor(F.col("idx") / 10)).alias("term"))


def follower_log(entries: DataFrame) -> DataFrame:
    """The follower ends at 55 and never saw a term beyond 5."""
    return entries.where(F.col("idx") <= 55).select("group_id", "idx", F.least(1 + F.floor(F.col("idx") / 10), F.lit(5).cast("bigint")).alias("term"))


def config_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """group_id, idx, config: a signup is a membership entry (its id), else null."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("group_id"), F.col("event_id").alias("idx"), F.when(F.col("event_type") == "signup", F.col("event_id")).alias("config"))
