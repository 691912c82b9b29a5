"""Runs of events separated by gaps, per key, for keys with any number of events.

Time is cut into buckets as wide as the gap: two events in one bucket can never be separated by more
than the gap, so islands are runs of buckets.  Events fold to one row per (key, bucket) before any
window, and a key has at most (time span / gap) buckets, however many events it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import floor_div


def bucket_islands(df: DataFrame, keys: Sequence[str], time: str, gap: int) -> DataFrame:
    """(keys, bucket, first, last, events, island): island numbers from 0 per key.

    A new island starts when the time since the previous event exceeds ``gap``.
    """
    keys = list(keys)
    buckets = (
        df.groupBy(*keys, floor_div(F.col(time), gap).alias("bucket"))
        .agg(F.min(time).alias("first"), F.max(time).alias("last"), F.count(F.lit(1)).alias("events"))
    )
    order = Window.partitionBy(*keys).orderBy("bucket")
    opens = F.coalesce(F.col("first") - F.lag("last").over(order) > gap, F.lit(False)).cast("int")
    return buckets.withColumn("_open", opens).withColumn("island", F.sum("_open").over(order)).drop("_open")


def islands(df: DataFrame, keys: Sequence[str], time: str, gap: int) -> DataFrame:
    """(keys, island, start, end, events)."""
    parts = bucket_islands(df, keys, time, gap)
    return parts.groupBy(*keys, "island").agg(F.min("first").alias("start"), F.max("last").alias("end"), F.sum("events").alias("events"))
