"""Ordered computations that do not put a whole group into one task.

A plain window sorts each group in one task; a key that holds a third of the
rows then bounds the job.  These operators cut the order into buckets, work
inside each, and carry one summary row per bucket across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 4096


def _before(keys: list[str], order: str):
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def dense_index(df: DataFrame, key: str, order: str, index: str, total: str, bucket: int = BUCKET) -> DataFrame:
    """Number the rows of each key from 1 by ``order`` (unique integers).

    Rows are ranked within (key, order div bucket); the bucket counts are
    summed up on one row per bucket.
    """
    cut = df.withColumn("_b", F.floor(F.col(order) / bucket))
    sums = cut.groupBy(key, "_b").agg(F.count(F.lit(1)).alias("_c"))
    sums = sums.select(key, "_b", F.coalesce(F.sum("_c").over(_before([key], "_b")), F.lit(0)).alias("_o"), F.sum("_c").over(Window.partitionBy(key)).alias(total))
    local = cut.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_b").orderBy(order)))
    return local.join(sums, [key, "_b"]).withColumn(index, F.col("_r") + F.col("_o")).drop("_b", "_r", "_o")


def carry_forward(df: DataFrame, key: str, order: str, value: str, out: str, default: Column, bucket: int = BUCKET) -> DataFrame:
    """As-of lookup: the latest non-null ``value`` at or before each row, else
    ``default``."""
    cut = df.withColumn("_b", F.floor(F.col(order) / bucket))
    inside = Window.partitionBy(key, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    last = cut.groupBy(key, "_b").agg(F.max_by(value, F.when(F.col(value).isNotNull(), F.col(order))).alias("_v"))
    last = last.select(key, "_b", F.last("_v", ignorenulls=True).over(_before([key], "_b")).alias("_v"))
    local = cut.withColumn("_l", F.last(value, ignorenulls=True).over(inside))
    return local.join(last, [key, "_b"]).withColumn(out, F.coalesce("_l", "_v", default)).drop("_b", "_l", "_v")


def range_bounds(df: DataFrame, order: str, parts: int) -> list:
    """At most ``parts`` lower bounds of ranges of about equal size.

    Only the ordering column is read, and only one value per range comes to
    the driver.
    """
    ranged = df.select(order).where(F.col(order).isNotNull()).repartitionByRange(parts, order)
    found = ranged.groupBy(F.spark_partition_id().alias("_p")).agg(F.min(order).alias("_m")).select("_m").collect()
    return sorted(r[0] for r in found)[1:]


def global_rank(df: DataFrame, order: str, index: str, parts: int = 64) -> DataFrame:
    """Number all rows from 0 by ``order`` without a single-partition window."""
    bounds = range_bounds(df, order, parts)
    at = F.lit(0)
    if bounds:
        at = F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.col(order)))
    cut = df.withColumn("_b", at)
    sums = cut.groupBy("_b").agg(F.count(F.lit(1)).alias("_c"))
    # one row per range: at most ``parts`` rows meet here
    sums = sums.select("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_o"))
    local = cut.withColumn("_r", F.row_number().over(Window.partitionBy("_b").orderBy(order)))
    return local.join(sums, "_b").withColumn(index, F.col("_r") - 1 + F.col("_o")).drop("_b", "_r", "_o")
