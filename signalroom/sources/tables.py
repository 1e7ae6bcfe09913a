"""Reading of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose rows lie in at least as many partitions as there are cores."""
    return spread(spark.read.parquet(path))


def spread(rows: DataFrame) -> DataFrame:
    """rows as they are, or dealt over all cores if they come from a few files with fewer row groups than cores.

    A row group is decoded by one task, so a small table of one row group would keep one core busy. Tables
    of many files are never dealt; of few files, footers tell how many tasks have rows.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if not rows.columns or len(rows.inputFiles()) >= cores or rows.select(F.spark_partition_id().alias("p")).distinct().count() >= cores:
        return rows
    return rows.repartition(cores)
