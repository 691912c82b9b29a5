"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders written inside each open :func:`scope`, the innermost last.
_OPEN: ContextVar[tuple[dict[str, SparkSession], ...]] = ContextVar("open scopes", default=())


@contextmanager
def scope() -> Iterator[None]:
    """Tables that are put down inside are removed at the end, so only eager steps may read them.

    A table put down with ``kept`` outlives the scope; it belongs to the next outer one, if there is any.
    """
    written: dict[str, SparkSession] = {}
    token = _OPEN.set((*_OPEN.get(), written))
    try:
        yield
    finally:
        _OPEN.reset(token)
        for path, spark in written.items():
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def put_down(df: DataFrame, name: str, kept: bool = False) -> DataFrame:
    """Write ``df`` as Parquet under ``spark.checkpoint.dir`` and go on from the copy.

    The copy cuts the lineage and outlives executors; each call takes a folder of its own.  Shuffle files of
    the write are given up as soon as it has ended.  The folder is removed with the :func:`scope` around, see there.
    """
    spark = df.sparkSession
    path = scratch_path(spark, f"{name}-{uuid.uuid4().hex}")
    around = _OPEN.get()[: -1 if kept else None]
    if around:
        around[-1][path] = spark
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def low32(name: str) -> Column:
    """Unsigned 32-bit value of a long that holds it in its low bits."""
    return F.col(name).bitwiseAND(F.lit(0xFFFFFFFF))


def batched(values: Iterable, size: int):
    """Lists of up to ``size`` values."""
    chunk = []
    for value in values:
        chunk.append(value)
        if len(chunk) == size:
            yield chunk
            chunk = []
    if chunk:
        yield chunk
