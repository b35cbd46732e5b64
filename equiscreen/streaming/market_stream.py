"""Market metrics over a stream of price bars: windowed aggregates with a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_bars(bars: DataFrame, key: str = "ticker", stamp: str = "ts", close: str = "close", window: str = "1 day", late: str = "2 days") -> DataFrame:
    """Open, high, low, close, mean and count of each key and window; bars later than ``late`` are dropped."""
    at = F.struct(F.col(stamp), F.col(close))
    return (
        bars.where(F.col(close).isNotNull()).withWatermark(stamp, late).groupBy(F.window(stamp, window), key)
        .agg(F.count(F.lit(1)).alias("n"), F.min(close).alias("low"), F.max(close).alias("high"), F.avg(close).alias("mean"), F.min(at)[close].alias("open"), F.max(at)[close].alias("close"))
        .select(key, F.col("window.start").alias("start"), "n", "open", "high", "low", "close", "mean")
    )
