"""First sights of values: novelty whose baseline grows with the events, in batch and as a stream.

A value of an attribute is new for an entity if it has not been observed before (or not for longer than ``ttl_ns``) and at
least ``threshold`` observations of the attribute came before it.  Observing goes on while detecting: the second sight of a
value is silent.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..functions.scalar import floor_div
from ..plans.rules import Rule

SIGHT = "entity string, attribute string, value string, time bigint, event_id bigint"
KEY = ["entity", "attribute"]

#: The state store keeps a value's entry apart from its key's others, so an entity's values need not fit in memory.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streaming queries started inside keep their state in RocksDB; a query takes its settings when it starts."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, STORE)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def timed_observations(events: DataFrame, rule: Rule) -> DataFrame:
    """``entity, attribute, value, time, event_id`` of the events that the rule's sources match."""
    hit = F.lit(False)
    for source in rule.sources.values():
        hit = hit | F.coalesce(F.expr(source.where), F.lit(False))
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(c).cast("string").alias("value")) for a, c in rule.observations.items()])
    rows = events.filter(hit).filter(F.col(rule.entity).isNotNull())
    rows = rows.select(F.col(rule.entity).cast("string").alias("entity"), F.explode(pairs).alias("o"), "time", "event_id")
    return rows.select("entity", "o.attribute", "o.value", "time", "event_id").filter("value is not null")


def remembered(observed: DataFrame) -> DataFrame:
    """``entity, attribute, value, times_seen, last_seen``: the baseline that observations leave behind."""
    return observed.groupBy(*KEY, "value").agg(F.count(F.lit(1)).alias("times_seen"), F.max("time").alias("last_seen"))


def first_sights(observed: DataFrame, threshold: int, prior: DataFrame | None = None, ttl_ns: int | None = None) -> DataFrame:
    """The sights (``entity, attribute, value, time, event_id``) in ``observed`` that are new, in order of time and id.

    ``prior`` is a baseline as from :func:`remembered`.  Observations fold to one row per value, or per value and stretch of
    ``ttl_ns``, before any window.  Only the first ``threshold`` observations of an attribute decide when it is warmed up, so
    an entity with very many is never gathered.
    """
    at = F.struct("time", "event_id")
    keys = [*KEY, "value"]
    if ttl_ns is None:
        starts = observed.groupBy(*keys).agg(F.min(at).alias("at"))
        if prior is not None:
            starts = starts.join(prior.select(*keys), keys, "left_anti")
    else:
        rows = observed.select(*keys, "time", at.alias("at"))
        if prior is not None:  # a known value opens its first stretch with its last sight, which is no sight of its own
            rows = rows.unionByName(prior.select(*keys, F.col("last_seen").alias("time"), F.lit(None).cast(rows.schema["at"].dataType).alias("at")))
        folded = rows.groupBy(*keys, floor_div(F.col("time"), max(ttl_ns, 1)).alias("stretch")).agg(
            F.min("time").alias("first"), F.max("time").alias("last"), F.min("at").alias("at"), F.min_by("at", "time").alias("opening")
        )
        before = F.lag("last").over(Window.partitionBy(*keys).orderBy("stretch"))
        opens = before.isNull() | (F.col("first") - before > ttl_ns)
        starts = folded.withColumn("opens", opens).filter("opens and opening is not null").select(*keys, "at")
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("time", "event_id"))
    early = observed.select(*KEY, "time", "event_id", nth.alias("nth")).filter(F.col("nth") <= threshold)
    # warmed up after the observation that completes the threshold
    early = early.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("nth", at))).alias("early"))
    judged = starts.join(early, KEY, "left")
    had = F.lit(0).cast("bigint")
    if prior is not None:
        judged = judged.join(prior.groupBy(*KEY).agg(F.sum("times_seen").alias("had")), KEY, "left")
        had = F.coalesce("had", F.lit(0))
    missing = (F.lit(threshold) - had).cast("int")
    ready = (missing <= 0) | F.coalesce(F.col("at") > F.try_element_at("early", missing), F.lit(False))
    return judged.filter(ready).select(*keys, "at.time", "at.event_id")


# As a stream

_FOLDED = "entity string, attribute string, value string, first bigint, first_id bigint, last bigint, n bigint, times array<bigint>, ids array<bigint>"


def _fold(observed: DataFrame, threshold: int, ttl_ns: int | None) -> DataFrame:
    """Observations of a value folded inside each task's batches: first and last sight, number, the earliest ``threshold``.

    A value that returns after more than ``ttl_ns`` begins another row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            rows = rows.sort_values(["entity", "attribute", "value", "time", "event_id"])
            keys = ["entity", "attribute", "value"]
            if ttl_ns is not None:
                apart = (rows["time"] - rows.groupby(keys)["time"].shift()) > ttl_ns
                rows["stretch"] = apart.cumsum()
                keys = [*keys, "stretch"]
            grouped = rows.groupby(keys, sort=False)
            out = grouped.agg(
                first=("time", "first"), first_id=("event_id", "first"), last=("time", "last"), n=("time", "size"),
                times=("time", lambda s: s.head(threshold).tolist()), ids=("event_id", lambda s: s.head(threshold).tolist()),
            )
            yield out.reset_index()[[c.split()[0] for c in _FOLDED.split(", ")]]

    return observed.mapInPandas(run, _FOLDED)


class FirstSights(StatefulProcessor):
    """Per (entity, attribute): the number of observations, and when each value was seen last."""

    def __init__(self, threshold: int, ttl_ns: int | None):
        self.threshold, self.ttl_ns = threshold, ttl_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.count = handle.getValueState("observations", "n bigint")
        self.seen = handle.getMapState("values", "value string", "last bigint")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        had = self.count.get()[0] if self.count.exists() else 0
        self.count.update((had + int(initialState["times_seen"].sum()),))
        for value, last in zip(initialState["value"], initialState["last_seen"]):
            self.seen.updateValue((value,), (int(last),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # a micro-batch's rows of a key are folded to at most one per value, stretch and task
        batch = pd.concat(list(rows)).sort_values(["first", "first_id"])
        had = self.count.get()[0] if self.count.exists() else 0
        early = sorted((t, i) for times, ids in zip(batch["times"], batch["ids"]) for t, i in zip(times, ids))
        missing = self.threshold - had
        ready = (float("-inf"), 0) if missing <= 0 else early[missing - 1] if missing <= len(early) else (float("inf"), 0)
        out, known = [], {}
        for value, first, first_id, last in zip(batch["value"], batch["first"], batch["first_id"], batch["last"]):
            if value not in known:
                known[value] = self.seen.getValue((value,))[0] if self.seen.containsKey((value,)) else None
            before = known[value]
            gone = before is None or (self.ttl_ns is not None and first - before > self.ttl_ns)
            if gone and (first, first_id) > ready:
                out.append((*key, value, int(first), int(first_id)))
            known[value] = int(last) if before is None else max(before, int(last))
        for value, last in known.items():
            self.seen.updateValue((value,), (last,))
        self.count.update((had + int(batch["n"].sum()),))
        if self.ttl_ns is not None:
            self._wake(timerValues)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SIGHT.split(", ")])

    def _wake(self, timerValues) -> None:
        if not list(self.handle.listTimers()):
            self.handle.registerTimer(max(timerValues.getCurrentWatermarkInMs(), 0) + self.ttl_ns // 1_000_000 + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """Values that no event above the watermark can find in time leave the state."""
        past = timerValues.getCurrentWatermarkInMs() * 1_000_000 - self.ttl_ns
        old = [value for value, last in self.seen.iterator() if last[0] < past]
        for value in old:
            self.seen.removeKey(value)
        if any(True for _ in self.seen.keys()):
            self._wake(timerValues)
        yield pd.DataFrame([], columns=[c.split()[0] for c in SIGHT.split(", ")])

    def close(self) -> None:
        pass


def stream_first_sights(
    observed: DataFrame,
    emit: Callable[[DataFrame, int], None],
    checkpoint: str,
    threshold: int,
    prior: DataFrame | None = None,
    ttl_ns: int | None = None,
    delay: str = "10 minutes",
    **trigger,
) -> StreamingQuery:
    """Run :func:`first_sights` on a stream: ``emit(sights, batch_id)`` gets the new sights of each micro-batch.

    Micro-batches follow one another as they come, and inside one, order is by time and id; so the result equals the batch
    form if no micro-batch reaches back before an earlier one.  ``prior`` seeds the state at the first start.  With
    ``ttl_ns``, values leave the state when the watermark has passed their last sight by as much, and observations later
    than ``delay`` are dropped.
    """
    spark = observed.sparkSession
    folded = _fold(observed, threshold, ttl_ns)
    if ttl_ns is not None:
        folded = folded.withColumn("seen_ts", F.expr("timestamp_micros(last div 1000)")).withWatermark("seen_ts", delay)
    initial = None if prior is None else prior.select(*KEY, "value", "times_seen", "last_seen").groupBy(*KEY)
    sights = folded.groupBy(*KEY).transformWithStateInPandas(
        FirstSights(threshold, ttl_ns), SIGHT, "Append", "None" if ttl_ns is None else "EventTime", initial
    )
    writer = sights.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(emit)
    with state_on_disk(spark):
        return writer.trigger(**(trigger or {"availableNow": True})).start()
