"""Resumable ingest: new files of a growing log, each item once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_items(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """Stream of a folder's JSON lines, first appearance of each key."""
    return spark.readStream.schema(schema).json(path).dropDuplicates([key])


def run_once(items: DataFrame, out: str, checkpoint: str) -> None:
    """Append what came since the last run; the checkpoint holds where that was."""
    items.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def to_do(log: DataFrame, done: DataFrame, failed: DataFrame, key: str, limit: int | None = None) -> DataFrame:
    """Items of a log that are neither done nor failed."""
    rest = log.join(done.select(key).unionByName(failed.select(key)).distinct(), key, "left_anti")
    return rest if limit is None else rest.limit(limit)


def index_stream(points: DataFrame, path: str, checkpoint: str) -> None:
    """Add the points of a stream (product_id, embedding, payload) to the index at `path`, as they came since the last run.

    A batch that is run again after a failure has the same number and is written to the same folder, so no point is added
    twice.
    """

    def add(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("point_id", F.expr("uuid()"))
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")

    points.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
