"""Incremental variants over files that arrive one by one: late records within a watermark, state of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_table(spark: SparkSession, folder: str, schema: str, files_per_batch: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def first_records(stream: DataFrame, time: str, keys: list[str], delay: str = "60 days") -> DataFrame:
    """Records without their second entries: of equal keys within the watermark only the first one passes."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, time: str, by: list[str], window: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Records and mean value for each window of event time and key, given out when the watermark has passed the window."""
    g = stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("w"), *by)
    return g.agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), *by, "n", "mean_value")


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all files there are and ends; a rerun goes on after them."""
    stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out).awaitTermination()
