"""Incremental ingest of chunk folders, and event-time counts, by Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def chunk_stream(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 64) -> DataFrame:
    """New Parquet chunks of ``folder`` as a stream; the checkpoint remembers those already read, which is the resume."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(spark: SparkSession, folder: str, schema: StructType, out: str, checkpoint: str) -> None:
    """Appends all chunks that are not in ``out`` yet, then stops."""
    q = chunk_stream(spark, folder, schema).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def windowed_counts(events: DataFrame, at: str, key: str, width: str, late: str) -> DataFrame:
    """(window_start, key, n): tumbling event-time windows; rows later than ``late`` behind the watermark are dropped by it."""
    rows = events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)
    return rows.groupBy(F.window(at, width), key).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), key, "n")
