"""Streams of prints: daily bars behind a watermark, and tables that keep each key's latest row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.window import keep_last


def daily_bars(prints: DataFrame, key: str = "user_id", lateness: str = "1 day") -> DataFrame:
    """(key, day, n, vwap, high, low) of a stream or table with ts, value and quantity; a day is final once the watermark is past it."""
    if prints.isStreaming:
        prints = prints.withWatermark("ts", lateness)
    vwap = F.sum(F.col("value") * F.col("quantity")) / F.nullif(F.sum("quantity"), F.lit(0.0))
    bars = prints.groupBy(key, F.window("ts", "1 day")).agg(F.count("*").alias("n"), F.coalesce(vwap, F.avg("value")).alias("vwap"), F.max("value").alias("high"), F.min("value").alias("low"))
    return bars.select(key, F.to_date("window.start").alias("day"), "n", "vwap", "high", "low")


def upsert_keep_last(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]):
    """A query that keeps at ``path`` the latest row of each key, late re-pulls included. Versions alternate between two folders,
    so that a table is never read and overwritten at once; the batch number says which is current, and a repeated batch is harmless."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        if number:
            batch = spark.read.parquet(f"{path}/v{(number - 1) % 2}").unionByName(batch, allowMissingColumns=True)
        keep_last(batch, keys, [F.col(c).desc_nulls_last() for c in order]).write.mode("overwrite").parquet(f"{path}/v{number % 2}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True)
