"""Bars from a stream of ticks: an extension that feeds the same panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tick_bars(ticks: DataFrame, window: str = "1 day", late: str = "2 days") -> DataFrame:
    """ticks(ts, stock_id, price, size), streaming or not -> a bar a stock and tumbling window; later ticks than `late` are dropped."""
    seen = ticks.withWatermark("ts", late) if ticks.isStreaming else ticks
    first, last = F.min_by("price", F.struct("ts", "price")), F.max_by("price", F.struct("ts", "price"))
    bars = seen.groupBy("stock_id", F.window("ts", window).alias("w")).agg(first.alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), last.alias("close"), F.sum("size").alias("volume_shares"))
    return bars.select("stock_id", F.col("w.start").cast("date").alias("d"), "open", "high", "low", "close", "volume_shares")
