"""Session settings and the two helpers that touch the cluster: checkpointing and size-checked broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Settings the engine relies on. AQE coalesces small shuffles and splits skewed join partitions.
ENGINE_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: A table is broadcast by hint only if its plan's size estimate stays under this many bytes.
BROADCAST_BYTES = 16 << 20


def build_session(app: str = "wardline", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**ENGINE_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _ensure_checkpoint_dir(spark: SparkSession) -> None:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if configured is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        configured = tempfile.mkdtemp(prefix="wardline-checkpoint-")
    sc.setCheckpointDir(configured)


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and continue from the written copy.

    Used where a later step needs the *same* physical rows twice (partition ids) or where an
    iteration would otherwise grow its lineage without bound.
    """
    _ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the checkpoint folder, whose real size the optimiser then knows."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path inside the shared checkpoint folder, for tables a job writes and reads back."""
    _ensure_checkpoint_dir(spark)
    root = spark.sparkContext.getCheckpointDir()
    return os.path.join(root, name)


def plan_bytes(df: DataFrame) -> int:
    """Catalyst's size estimate of the optimised plan: file sizes for scans, exact for local rows."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if Catalyst's size estimate says that the table is small.

    Any other table, one without an estimate included, is returned as it is and joins by shuffle, where AQE still
    measures the real sizes and splits skewed partitions.
    """
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small configuration table as a local relation, whose size the optimiser knows."""
    if not rows:
        return spark.createDataFrame([], schema)
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema)
    named = [dict(zip(fields.names, row)) for row in rows]
    return spark.createDataFrame(pa.Table.from_pylist(named, schema=to_arrow_schema(fields)), fields)
