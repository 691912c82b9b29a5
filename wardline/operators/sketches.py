"""Baselines as mergeable sketches, one row per group and day, merged for any range of days without reading events again."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import floor_div
from ..session import small
from .analytics import DAY_NS

#: Size of a quantile sketch: with 800 the rank error of a single quantile is below 0.5 % of the rows, however many are merged.
KLL_K = 800
#: Registers of a distinct-count sketch as a power of two: a standard error of about 0.8 %.
HLL_LOG2 = 14


def daily_sketches(events: DataFrame, group: Sequence[str], value: str, entity: str, time: str = "time", k: int = KLL_K, log2_k: int = HLL_LOG2) -> DataFrame:
    """(group, day, events, n, lowest, highest, quantiles, entities): ``value`` as a double and the distinct ``entity``.

    ``n`` counts values that are neither null nor NaN; a group without any has a null ``quantiles``.  Sketches are built
    before the shuffle, so that a day or group with a third of all rows moves as one sketch per task.  Events without a time
    have no day and are left out.
    """
    number = F.col(value).cast("double")
    number = F.when(~F.isnan(number), number)
    dated = events.filter(F.col(time).isNotNull()).withColumn("day", floor_div(F.col(time), DAY_NS))
    counted = F.count(number)
    return dated.groupBy(*group, "day").agg(
        F.count(F.lit(1)).alias("events"),
        counted.alias("n"),
        F.min(number).alias("lowest"),
        F.max(number).alias("highest"),
        F.when(counted > 0, F.kll_sketch_agg_double(number, k)).alias("quantiles"),
        F.hll_sketch_agg(F.col(entity), F.lit(log2_k)).alias("entities"),
    )


def store_days(sketches: DataFrame, path: str) -> None:
    """Write sketches in a folder per day; the days at hand replace what was stored of them, others stay."""
    sketches.hint("rebalance", "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """The stored sketches of the days ``first`` to ``last``, both included; other folders are not opened."""
    return spark.read.parquet(path).filter(F.col("day").between(first, last))


def merge_sketches(sketches: DataFrame, group: Sequence[str]) -> DataFrame:
    """One row per group over all given days; a coarser group than the stored one merges groups as well."""
    n = F.sum("n")
    return sketches.groupBy(*group).agg(
        F.sum("events").alias("events"),
        n.alias("n"),
        F.min("lowest").alias("lowest"),
        F.max("highest").alias("highest"),
        F.when(n > 0, F.kll_merge_agg_double("quantiles")).alias("quantiles"),
        F.hll_union_agg("entities").alias("entities"),
    )


def with_estimates(merged: DataFrame, points: Sequence[float] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Adds ``percentiles`` (null without values) and ``distinct_entities``, and drops the sketches."""
    each = F.array(*[F.kll_sketch_get_quantile_double("quantiles", F.lit(p)) for p in points])
    return (
        merged.withColumn("percentiles", F.when(F.col("n") > 0, each))
        .withColumn("distinct_entities", F.hll_sketch_estimate("entities"))
        .drop("quantiles", "entities")
    )


def unusual_volume(current: DataFrame, merged: DataFrame, group: Sequence[str], value: str, above: float = 0.99) -> DataFrame:
    """Rows of ``current`` whose value is over the baseline's quantile ``above``, with that quantile as ``usual``.

    The baseline has a row per group; groups without one are never unusual.
    """
    known = merged.filter("n > 0").select(*group, F.kll_sketch_get_quantile_double("quantiles", F.lit(above)).alias("usual"))
    return current.join(small(known), list(group)).filter(F.col(value) > F.col("usual"))
