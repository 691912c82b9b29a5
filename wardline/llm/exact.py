"""Exact duplicates: group by a 128-bit content hash and compare the bytes inside each group."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import text_or_empty


def content_hash(text: Column) -> Column:
    """128 bits of the text's UTF-8 bytes."""
    return F.unhex(F.md5(text))


def exact_duplicates(
    docs: DataFrame, keep: str = "smallest", digest: Callable[[Column], Column] = content_hash
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``.

    Rows are grouped by ``digest`` of the text; inside a group the texts themselves are compared, so rows whose
    digests collide stay apart.  ``keep`` names the id that stays, ``smallest`` or ``largest``.

    The grouping folds copies before the shuffle, so a group with a third of all rows sends one row per input
    split.  Only the (digest, SHA-256) pairs of the groups return to the rows, by a join whose skewed side AQE splits.

    A null text is the empty text.  A null id is never preferred to another id; a group of null ids alone keeps them
    all.  Rows that repeat both id and text count one by one, and as copies of the kept row they are kept as well.
    No rows give no rows.  Other columns are ignored.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = docs.select(F.col("doc_id"), text_or_empty().alias("body")).select(
        "doc_id", "body", digest(F.col("body")).alias("digest")
    )
    groups = (
        rows.groupBy("digest", "body")
        .agg(best("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select(F.col("digest").alias("g_digest"), F.sha2("body", 256).alias("g_sha"), "keep_id", "group_size")
    )
    own = rows.select("doc_id", "digest", F.sha2("body", 256).alias("text_sha256"))
    same = (F.col("digest") == F.col("g_digest")) & (F.col("text_sha256") == F.col("g_sha"))
    return own.join(groups, same).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """The rows of ``docs`` that :func:`exact_duplicates` keeps, all columns as they are.

    Of rows that repeat id and text alike, all stay.  A decision holds for an id and a text together, so another text
    under the same id, null included, is not touched by it.  A group of null ids alone stays whole.
    """
    gone = exact_duplicates(docs, keep).where(~F.col("kept")).select(
        F.col("doc_id").alias("gone_id"), F.col("text_sha256").alias("gone_sha")
    )
    same = docs["doc_id"].eqNullSafe(gone["gone_id"]) & (F.sha2(text_or_empty(), 256) == gone["gone_sha"])
    return docs.join(gone, same, "left_anti")
