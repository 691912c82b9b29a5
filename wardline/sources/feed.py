"""The case change feed: ``new``, ``update`` and ``fire`` messages as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The message layout.
CASE_TYPE = (
    "struct<id:string,tenant_id:string,title:string,primary_entity:string,severity:string,disposition:string,"
    "risk_score:int,tactics:array<string>,created_at_ms:bigint,updated_at_ms:bigint,status:string,assignee:string>"
)
FEED_SCHEMA = f"seq bigint, kind string, case {CASE_TYPE}, event struct<id:string,at_ms:bigint,kind:string>"


def read_case_feed(spark: SparkSession, path: str, streaming: bool = True, max_files: int | None = None) -> DataFrame:
    reader = spark.readStream if streaming else spark.read
    reader = reader.schema(FEED_SCHEMA)
    if streaming and max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.json(path)
