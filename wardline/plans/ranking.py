"""Positions inside a group, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import settle


def _runs(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Range-partition on (group, order) and tag each row with its run.

    A hot group is cut into many sorted runs.  The tagged rows are checkpointed: run numbers must not
    change between their uses, also when an executor is lost.
    """
    keys = [F.col(c) for c in (*group, *order)]
    return settle(df.repartitionByRange(*keys).withColumn("_run", F.spark_partition_id()))


def _join_runs(local: DataFrame, table: DataFrame, group: list[str]) -> DataFrame:
    """Attach per-run values; the group is compared null-safely, as windows do."""
    right = table.select(F.col("_run").alias("_r_run"), *[F.col(c).alias(f"_r_{c}") for c in group], *[c for c in table.columns if c not in (*group, "_run")])
    cond = [F.col("_run") == F.col("_r_run"), *[F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in group]]
    return local.join(right, cond, "left").drop("_r_run", *[f"_r_{c}" for c in group])


def cumulative_within(df: DataFrame, group: Sequence[str], order: Sequence[str], weight: str, out: str = "upto") -> DataFrame:
    """Running sum of ``weight`` in each group up to and including the row; ``order`` is unique in a group.

    Each run sums its weights per group, the sums are accumulated over the runs of a group (one row per
    run), and a row's value is the run's offset plus the running sum inside the run.
    """
    group, order = list(group), list(order)
    tagged = _runs(df, group, order)
    runs = tagged.groupBy(*group, "_run").agg(F.sum(weight).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(*group, "_run", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*group, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_upto", F.sum(weight).over(inside))
    joined = _join_runs(local, offsets, group)
    return joined.select(*df.columns, (F.col("_base") + F.col("_upto")).alias(out))


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "rank0") -> DataFrame:
    """Zero-based position of each row in its group; ``order`` must end in a unique column."""
    ones = df.withColumn("_one", F.lit(1).cast("bigint"))
    placed = cumulative_within(ones, group, order, "_one", out="_upto1")
    return placed.select(*df.columns, (F.col("_upto1") - 1).cast("bigint").alias(out))


def lag_within(df: DataFrame, group: Sequence[str], order: Sequence[str], out: str = "previous") -> DataFrame:
    """Adds the previous row of the group as a struct (NULL for the first row).

    Inside a run this is a plain lag; a run's first row of a group takes the last row of the group's
    run before, found on a table with one row per (group, run).
    """
    group, order = list(group), list(order)
    tagged = _runs(df, group, order)
    row = F.struct(*df.columns)
    inside = Window.partitionBy(*group, "_run").orderBy(*order)
    tails = tagged.groupBy(*group, "_run").agg(F.max_by(row, F.struct(*order)).alias("_tail"))
    across = Window.partitionBy(*group).orderBy("_run")
    before = tails.select(*group, "_run", F.lag("_tail").over(across).alias("_before"))
    local = tagged.withColumn("_in_run", F.lag(row).over(inside))
    return _join_runs(local, before, group).select(*df.columns, F.coalesce("_in_run", "_before").alias(out))


def exact_median(df: DataFrame, group: Sequence[str], value: str, out: str = "median") -> DataFrame:
    """Exact median per group (mean of the two middle values for even counts), any group size.

    Equal values are counted first, so copies fold before the shuffle.
    """
    group = list(group)
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_k"))
    placed = cumulative_within(counted, group, [value], "_k", out="_hi").withColumn("_lo", F.col("_hi") - F.col("_k"))
    totals = counted.groupBy(*group).agg(F.sum("_k").alias("_total"))
    joined = placed.join(totals, group)

    def holds(pos):
        return (F.col("_lo") <= pos) & (pos < F.col("_hi"))

    low, high = F.expr("(_total - 1) div 2"), F.expr("_total div 2")
    half = F.col(value) / 2  # each middle value counts half; a value that is none may be infinite
    halves = F.when(holds(low) & holds(high), F.col(value)).when(holds(low) | holds(high), half)
    return joined.groupBy(*group).agg(F.sum(halves).alias(out))


def rank_by_hash(df: DataFrame, group: Sequence[str], key: str, out: str = "rank0", size: str = "group_size") -> DataFrame:
    """As ``rank_within`` for a unique hex hash column, with the group's size.

    Hash digits are uniform, so the first three digits cut every group into 4,096 even buckets and no
    sampling, sort of the whole, or checkpoint is needed.  The offset table has at most 4,096 rows a group.
    """
    group = list(group)
    tagged = df.withColumn("_p3", F.substring(key, 1, 3))
    buckets = tagged.groupBy(*group, "_p3").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_p3").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*group)
    offsets = buckets.select(
        *group, "_p3", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"), F.sum("_n").over(whole).alias(size)
    )
    inside = Window.partitionBy(*group, "_p3").orderBy(key)
    local = tagged.withColumn("_pos", F.row_number().over(inside) - 1)
    joined = local.join(offsets, [*group, "_p3"])
    return joined.select(*df.columns, (F.col("_base") + F.col("_pos")).cast("bigint").alias(out), size)
