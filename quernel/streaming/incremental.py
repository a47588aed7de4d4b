"""Extension: the same operators on streams. The reference has no streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_folder(spark: SparkSession, folder: str, schema, pattern: str = "*.parquet", files: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)


def first_deliveries(stream: DataFrame, key: str, stamp: str, delay: str = "30 days") -> DataFrame:
    """The first delivery of each key; state is kept for ``delay`` behind the latest ``stamp``, later repeats pass again."""
    return stream.withWatermark(stamp, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, stamp: str, by: str, size: str = "5 minutes", slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by event-time window; late rows count until the watermark passes."""
    w = F.window(stamp, size, slide) if slide else F.window(stamp, size)
    return (
        stream.withWatermark(stamp, delay).groupBy(w.alias("w"), by)
        .agg(F.count("*").alias("n"), F.sum("value").alias("total"))
        .select(F.col("w.start").alias("start"), by, "n", "total")
    )


def sessions(stream: DataFrame, stamp: str, by: str, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    return (
        stream.withWatermark(stamp, delay).groupBy(F.session_window(stamp, gap).alias("w"), by).agg(F.count("*").alias("n"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), by, "n")
    )
