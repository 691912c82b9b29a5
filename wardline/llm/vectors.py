"""Rows of an embedding table that can be computed with, and arrays of them in tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def whole_vectors(table: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is not null, not empty and has no null or non-finite component.

    Inner products need one length: vectors of another length than most remaining rows have take no part, the longer
    length winning a tie.
    """
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = table.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite)
    lengths = rows.groupBy(F.size(vector).alias("length")).count()
    most = lengths.orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size(vector) == most["length"]) if most else rows


def floored(vector: str, scale: int, shift: int = 0) -> Column:
    """Whole numbers ``floor(scale * c) + shift``; a component beyond 64 bits is an error."""
    beyond = F.raise_error(F.lit("a component does not fit 64 bits")).cast("long")
    return F.transform(
        vector,
        lambda c: F.when(F.abs(c.cast("double") * scale) < 2.0**62, F.floor(c.cast("double") * scale)).otherwise(beyond) + F.lit(shift).cast("long"),
    )


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equally long lists without nulls as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)
