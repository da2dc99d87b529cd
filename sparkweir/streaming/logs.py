"""Streams of log rows: first versions, counts by window, and an output that a repeated batch doesn't double."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def first_versions(stream: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """Each key's first row; rows of a key within the time allowed for late ones count as the same, and the state of older keys goes."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def window_counts(stream: DataFrame, at: str, size: str, late: str, by: list[str]) -> DataFrame:
    """Rows by window and column; a window comes out once no late row can be added."""
    counted = stream.withWatermark(at, late).groupBy(F.window(at, size).alias("window"), *by).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def write_once(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes what is there; a batch that is run again replaces its own rows."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
