"""Incremental loads as Structured Streaming: new files of a folder, each row once, into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def read_folder(spark: SparkSession, folder: str, schema: StructType, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """A stream of the folder's files; those already loaded are known from the checkpoint of the query that reads it."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def load_new(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Takes all that is there now, in batches, and stops. Called again, it goes on where it stopped."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def once_per_key(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """The first row of each key; keys are remembered until the watermark has passed."""
    return stream.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def upsert_into(stream: DataFrame, apply, checkpoint: str) -> None:
    """apply(batch, number) for every micro-batch; it must give the same result if a batch comes twice."""
    stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
