"""Folding streams into tables: case versions, trailing rates, evidence without copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.console import fold_cases, trailing_rate
from ..operators.identity import dedup_evidence_stream
from .changelog import ChangeLog
from .novelty import state_on_disk


def fold_feed(feed: DataFrame, columns: list[str], path: str, checkpoint: str, fanout: int = 8, **trigger) -> StreamingQuery:
    """Log the latest version of every case that a micro-batch made or changed, in a :class:`~.changelog.ChangeLog`.

    A micro-batch writes what it changed, however large the case table is, and now and then merges what earlier ones wrote;
    a repeated one changes nothing, so restarts do not change the result.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        news = batch.filter(F.col("kind").isin("new", "update"))
        row = F.struct(*[F.col(f"case.{c}").alias(c) for c in columns])
        rows = news.select(F.col("case.id").alias("id"), row.alias("case"), "seq", F.lit("update").alias("kind"))
        log = ChangeLog(batch.sparkSession, path, "id", "seq", fanout)
        log.append(rows, batch_id)
        log.clean()

    writer = feed.writeStream.option("checkpointLocation", checkpoint).foreachBatch(on_batch)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def current_cases(spark: SparkSession, path: str, initial: DataFrame) -> DataFrame:
    """The case table as of the last whole version of the log."""
    logged = ChangeLog(spark, path, "id", "seq").read()
    return initial if logged is None else fold_cases(initial, logged)


def store_evidence(evidence: DataFrame, path: str, checkpoint: str, key: str = "evidence_id", **trigger) -> StreamingQuery:
    """Store every id of a stream once, however long ago it came first: one folder of new rows per micro-batch.

    The ids are the state, without a watermark, so none is ever forgotten; it is kept by RocksDB in the checkpoint folder and
    on the executors' disks and need not fit in memory.  Ids spread over all tasks, and copies within a micro-batch are
    folded first.  A repeated micro-batch overwrites its own folder.
    """

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    spark = evidence.sparkSession
    writer = evidence.dropDuplicates([key]).writeStream.option("checkpointLocation", checkpoint).foreachBatch(on_batch)
    with state_on_disk(spark):
        return writer.trigger(**(trigger or {"availableNow": True})).start()


def rate_per_window(fires: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Streaming form of the trailing rate: sliding five-second windows every second."""
    timed = fires.withColumn("event_ts", F.timestamp_millis("at_ms")).withWatermark("event_ts", delay)
    counted = timed.groupBy(F.window("event_ts", "5 seconds", "1 second")).agg(F.count(F.lit(1)).alias("fires_in_window"))
    return counted.select(F.col("window.end").alias("at"), "fires_in_window", (F.col("fires_in_window") / 5).alias("rate_per_s"))


__all__ = ["current_cases", "dedup_evidence_stream", "fold_feed", "rate_per_window", "store_evidence", "trailing_rate"]
