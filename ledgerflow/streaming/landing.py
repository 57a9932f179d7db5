"""Streams of files that land in a folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def landed_events(spark: SparkSession, folder: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they land, each once."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def windowed_counts(events: DataFrame, time: str, keys: list[str], size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Rows by window and keys; what is later than the watermark is dropped, so that state stays bounded."""
    window = F.window(F.col(time), size)
    rows = events.withWatermark(time, late).groupBy(window.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("w.start").alias("start"), *keys, "n")
