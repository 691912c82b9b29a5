"""Order-independent hash of a group's rows, without ever holding a whole group in one task.

The items of a group are hashed, equal items are counted (partial aggregation folds copies before
the shuffle), and the counted hashes are combined in two steps: by the four leading hex digits of the
item hash, then by group.  Hash digits are uniform, so a group with a third of all rows spreads over
65,536 shuffle keys; a list holds one such share, or at most 65,536 bucket hashes.

Where the result is wanted by some leading columns (``colocate``), rows go to the task of their key once, and all three
steps happen there.  Only keys that hold very many rows, found by a count per hash bucket, are spread as above.  Hashes
travel as bytes, half as long as their digits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import sha_hex

DIGITS = 4
KEY_BUCKETS = 1 << 16  # hash buckets that keys are counted in
CROWDED = 1 << 16  # rows of a bucket from which on its keys are spread


def _fold(label: str, value: str) -> Column:
    parts = F.collect_list(F.concat(F.col(label), F.lit("="), F.col(value)))
    return sha_hex(F.concat_ws(",", F.array_sort(parts)))


def packed(digits: Column) -> Column:
    """Text as bytes that end in their kind: 1 for the bytes of 64 lower-case hex digits, 0 for any other text."""
    even = (F.length(digits) == 64) & (F.lower(F.hex(F.unhex(digits))) == digits)
    return F.when(even, F.concat(F.unhex(digits), F.unhex(F.lit("01")))).otherwise(F.concat(digits.cast("binary"), F.unhex(F.lit("00"))))


def unpacked(packed: Column) -> Column:
    size = F.octet_length(packed)
    return F.when(size.isNull(), None).when(
        F.substring(packed, size, F.lit(1)) == F.unhex(F.lit("01")), F.lower(F.hex(F.substring(packed, F.lit(1), F.lit(32))))
    ).otherwise(F.substring(packed, F.lit(1), size - 1).cast("string"))


def key_bucket(keys: Sequence[str], buckets: int = KEY_BUCKETS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def crowded(df: DataFrame, keys: Sequence[str], buckets: int = KEY_BUCKETS) -> tuple[list[int], int]:
    """(numbers of the buckets whose keys are to be spread, rows of the fullest bucket), from one pass over the keys.

    A bucket is crowded beyond ``CROWDED`` rows and eight times the mean, so there are at most ``buckets`` / 8 of them.
    """
    counted = df.select(key_bucket(keys, buckets).alias("_b")).groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    full = F.collect_list(F.when(F.col("_n") > CROWDED, F.struct("_b", "_n")))
    total, most, found = counted.agg(F.sum("_n"), F.max("_n"), full).first()
    bound = max(CROWDED, 8 * (total or 0) // buckets)
    return sorted(r[0] for r in found if r[1] > bound), most or 0


def counted_items(df: DataFrame, group: Sequence[str], item: Column, hashed: bool, colocate: Sequence[str] | None = None) -> DataFrame:
    """(group, _h, _n): the different items and how often each stands there.  With ``colocate`` dealt by these columns."""
    group = list(group)
    rows = df.select(*group, (item if hashed else sha_hex(item)).alias("_t")).select(*group, packed(F.col("_t")).alias("_h"))
    if colocate:
        rows = rows.repartition(*colocate)
    return rows.groupBy(*group, "_h").agg(F.count(F.lit(1)).alias("_n"))


def folded_items(counted: DataFrame, group: Sequence[str], out: str, count: str | None, spread: bool) -> DataFrame:
    """The digest of ``counted_items``.  ``spread`` deals the items of a group by their leading digits."""
    group = list(group)
    named = counted.select(*group, "_n", unpacked(F.col("_h")).alias("_t"))
    named = named.select(*group, "_n", F.substring("_t", 1, DIGITS).alias("_p"), F.col("_t").alias("_h"), F.col("_n").cast("string").alias("_ns"))
    if spread:
        named = named.repartition(*group, "_p")
    # a filter on the hash would be pushed down and compute it twice, so NULL items are left out here:
    # lists skip them, and a group of nothing else has no count
    real = F.sum(F.when(F.col("_h").isNotNull(), F.col("_n")))
    buckets = named.groupBy(*group, "_p").agg(_fold("_h", "_ns").alias("_d"), real.alias("_n"))
    folded = buckets.groupBy(*group).agg(_fold("_p", "_d").alias(out), F.sum("_n").alias("_total")).filter("_total is not null")
    return folded.select(*group, out, *([F.col("_total").alias(count)] if count else []))


def set_digest(
    df: DataFrame,
    group: Sequence[str],
    item: Column,
    out: str = "digest",
    count: str | None = None,
    hashed: bool = False,
    colocate: Sequence[str] | None = None,
    full: Sequence[int] | None = None,
) -> DataFrame:
    """One row per group: ``out`` (hex) and, if asked, ``count`` (rows with copies).

    ``item`` must be text that identifies the row's content; NULL items are left out.  ``hashed`` says
    that it already is a uniform hex hash.  ``colocate`` names the leading group columns the result is
    to be partitioned by, so that a following join or aggregation on them needs no further shuffle.  Crowded buckets of
    these columns (``full``, counted here if it is not given) are spread; with any, the result has no partitioning.
    """
    if not colocate:
        return folded_items(counted_items(df, group, item, hashed), group, out, count, spread=True)
    full = crowded(df, colocate)[0] if full is None else list(full)
    few, many = split(df, colocate, full)
    light = folded_items(counted_items(few, group, item, hashed, colocate), group, out, count, spread=False)
    if many is None:
        return light
    return light.unionByName(folded_items(counted_items(many, group, item, hashed), group, out, count, spread=True))


def split(df: DataFrame, keys: Sequence[str], full: Sequence[int], buckets: int = KEY_BUCKETS) -> tuple[DataFrame, DataFrame | None]:
    """(rows of other keys, rows of keys in the crowded buckets or None if there are none)."""
    if not full:
        return df, None
    mine = key_bucket(keys, buckets).isin(list(full))
    return df.filter(~mine), df.filter(mine)
