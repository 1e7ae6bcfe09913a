"""The file audit over arriving files, and windowed counts of events with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from signalroom.sources import files, media


def arriving_files(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """A stream of the reports of new files below a path."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    rows = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_batch).load(path)
    return media.inspect(rows.where((F.col("length") <= files.MOST_BYTES) & ~files.is_generated(F.col("path"))))


def write_audit(reports: DataFrame, out: str, checkpoint: str) -> DataStreamWriter:
    return reports.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")


def windowed_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events and their values by type in tumbling windows; batch and streaming alike."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
