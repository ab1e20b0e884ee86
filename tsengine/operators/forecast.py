"""Forecast helpers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def next_dates(df: DataFrame, keys: Sequence[str], time_col: str = "dt", n: int = 5) -> DataFrame:
    """Per series, last date + 1 .. n days (``explode(sequence)`` of n rows per series)."""
    last = df.groupBy(*keys).agg(F.max(time_col).alias("_last"))
    return last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(n))).alias("step"), "_last") \
        .select(*keys, "step", (F.col("_last") + F.make_interval(days=F.col("step"))).alias(time_col))


def naive_trend_forecast(df: DataFrame, keys: Sequence[str], time_col: str = "dt", price: str = "price",
                         tail: int = 5, horizon: int = 5) -> DataFrame:
    """Last price + mean step over the last ``tail`` rows, repeated over ``horizon``
    future days: forecast_h = last + h (last - first_of_tail) / tail."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(time_col)
    t = df.select(*keys, time_col, price, F.first(price).over(w.rowsBetween(-(tail - 1), 0)).alias("_first"))
    last = t.groupBy(*keys).agg(F.max_by(F.struct(price, "_first", time_col), F.col(time_col)).alias("_l"))
    trend = (F.col(f"_l.{price}") - F.col("_l._first")) / F.lit(float(tail))
    base = last.select(*keys, F.col(f"_l.{price}").alias("_p"), F.col(f"_l.{time_col}").alias("_t"), trend.alias("trend"))
    e = base.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return e.select(*keys, "step", (F.col("_t") + F.make_interval(days=F.col("step"))).alias(time_col),
                    "trend", (F.col("_p") + F.col("step") * F.col("trend")).alias("forecast"))


def append_forecast(history: DataFrame, forecast: DataFrame) -> DataFrame:
    """History rows + forecast rows, missing columns NULL."""
    return history.withColumn("is_forecast", F.lit(False)).unionByName(
        forecast.withColumn("is_forecast", F.lit(True)), allowMissingColumns=True)


def merge_result_sets(results: DataFrame, keys: Sequence[str], run_col: str = "run") -> DataFrame:
    """A later run overrides the same key (dict.update): rank by run desc = 1."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(F.col(run_col).desc())
    return results.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")
