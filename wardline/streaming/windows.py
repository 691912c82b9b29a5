"""Rules over event-time windows, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans import rules
from ..plans.rules import Rule


def with_event_time(events: DataFrame, time: str = "time") -> DataFrame:
    """Adds ``event_ts`` from UTC nanoseconds, for windows and watermarks only."""
    return events.withColumn("event_ts", F.expr(f"timestamp_micros({time} div 1000)"))


def _windowed(rule: Rule, events: DataFrame, window: str) -> DataFrame:
    keyed = events.withColumn("window", F.window("event_ts", window))
    return rules.partial_aggregates(rule, keyed, by=["window"])


def _close(rule: Rule, partial: DataFrame, baseline=None) -> DataFrame:
    named = partial.withColumn("window_start", F.col("window.start")).withColumn("window_end", F.col("window.end")).drop("window")
    by = ["window_start", "window_end"]
    return rules.detections_from(rule, rules.judge_frame(rule, rules.finish(rule, named, by), baseline), by)


def windowed_detections(rule: Rule, events: DataFrame, window: str | None = None, baseline=None) -> DataFrame:
    """The rule evaluated in every tumbling window (its own window by default)."""
    timed = events if "event_ts" in events.columns else with_event_time(events)
    span = F.window("event_ts", window or rule.window)
    keyed = timed.withColumn("window_start", span["start"]).withColumn("window_end", span["end"])
    return rules.evaluate(rule, keyed, baseline, by=["window_start", "window_end"])


def stream_detections(
    rule: Rule,
    events: DataFrame,
    emit: Callable[[DataFrame, int], None],
    checkpoint: str,
    delay: str = "10 minutes",
    window: str | None = None,
    baseline=None,
    **trigger,
) -> StreamingQuery:
    """Run the rule on a stream: ``emit(detections, batch_id)`` gets the detections of closed windows.

    The state holds mergeable aggregates per (window, keys), not events.  A window leaves the state when
    the watermark passes it, for all its keys at once, so coarser sources are rolled up and joined
    inside the micro-batch.  Events later than ``delay`` are dropped; a file source takes files by modification time, so files of late times come late.
    """
    timed = with_event_time(events) if "event_ts" not in events.columns else events
    partial = _windowed(rule, timed.withWatermark("event_ts", delay), window or rule.window)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        # a rule reads the closed windows once for each source: they are computed once and written, over those before
        batch.write.mode("overwrite").parquet(f"{checkpoint}/closed")
        closed = batch.sparkSession.read.schema(batch.schema).parquet(f"{checkpoint}/closed")
        emit(_close(rule, closed, baseline), batch_id)

    writer = partial.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(on_batch)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
