"""Incremental reading of append-only shards: each batch joins the log, and the fold is that of the batch engine."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

LOG_TYPE = "seq bigint, id string, override boolean, fields map<string,string>"


def follow(spark: SparkSession, source: str, log: str, checkpoint: str, after: Callable[[DataFrame], None] | None = None) -> StreamingQuery:
    """Append new shard files (JSON lines of LOG_TYPE) to the log, one folder a batch.

    A batch that is tried again overwrites its own folder, so the log has
    every record once; `after` gets the whole log after each batch.
    """
    stream = spark.readStream.schema(LOG_TYPE).json(source)

    def each(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")
        if after is not None:
            after(spark.read.schema(LOG_TYPE).parquet(log))

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
