"""OHLCV bars from trades / ticks (the batch twin of the streaming bar builder T05)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def ohlcv(df: DataFrame, series_cols: Sequence[str], time_col: str, price_col: str,
          order_col: str, size_col: str | None = None, interval: str | None = None,
          out_time: str = "dt") -> DataFrame:
    """One bar per (series, time bucket): open/close = price of the first/last trade by
    ``order_col``, high/low, volume = sum(size) (or trade count). ``interval`` buckets the time
    column with a tumbling ``window``; None keeps the time column as the bucket.

    Partial aggregation (``min_by``/``max_by`` are mergeable) runs map-side, so a hot series
    only ships one partial row per task and bucket through the shuffle."""
    bucket = F.window(time_col, interval).start if interval else F.col(time_col)
    vol = F.sum(size_col) if size_col else F.count(F.lit(1))
    return (df.groupBy(*[F.col(c) for c in series_cols], bucket.alias(out_time))
              .agg(F.min_by(price_col, order_col).alias("open"),
                   F.max(price_col).alias("high"),
                   F.min(price_col).alias("low"),
                   F.max_by(price_col, order_col).alias("close"),
                   vol.cast("long").alias("volume"))
              .withColumn("price", F.col("close")))
