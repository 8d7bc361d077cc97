"""Bars over a stream of ticks: the batch definition with an event-time window and a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def streaming_bars(ticks: DataFrame, every: str = "1 day", late: str = "2 days") -> DataFrame:
    """asset, start, open, high, low, close, volume of ticks (asset, ts, price, size) no later than the watermark."""
    return (
        ticks.withWatermark("ts", late)
        .groupBy(F.window("ts", every).alias("w"), "asset")
        .agg(F.min_by("price", "ts").alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", "ts").alias("close"), F.sum("size").alias("volume"))
        .select("asset", F.col("w.start").alias("start"), "open", "high", "low", "close", "volume")
    )
