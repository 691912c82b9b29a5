"""Events laid out by day and clustered by entity, so that a hunt over past days opens only their files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import floor_div
from ..operators.analytics import DAY_NS


def write_history(events: DataFrame, path: str, cluster: str, time: str = "time", files: int | None = None, mode: str = "append") -> None:
    """Write events in a folder per ``day``, sorted by ``cluster`` and time inside.

    Rows are dealt in ranges of (day, cluster, time): a day or an entity with a third of all rows takes many files, a quiet
    day one, and an entity stands in few row groups, whose bounds skip the others.  ``files`` is the number of ranges (by
    default the session's shuffle partitions, coalesced by AQE).  Events without a time are in a folder of their own.
    """
    keys = ["day", cluster, time]
    dated = events.withColumn("day", floor_div(F.col(time), DAY_NS))
    dealt = dated.repartitionByRange(files, *keys) if files else dated.repartitionByRange(*keys)
    dealt.sortWithinPartitions(*keys).write.mode(mode).partitionBy("day").parquet(path)


def read_history(spark: SparkSession, path: str, start_ns: int, end_ns: int, time: str = "time") -> DataFrame:
    """Events from ``start_ns`` to before ``end_ns``, with their ``day``; folders of other days are not opened."""
    days = F.col("day").between(start_ns // DAY_NS, (end_ns - 1) // DAY_NS)
    return spark.read.parquet(path).filter(days & (F.col(time) >= start_ns) & (F.col(time) < end_ns))
