"""Per-series summaries.

What a summary needs of the end of a series is found by a rank limit, which drops the rows before it
in every task ahead of the shuffle; lags and frames then see a few rows a series, and ONE ``groupBy(series)``
whose ``max_by(..., time)`` picks the last row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsengine.frames import SeriesWindow
from tsengine.functions.core import safe_div
from tsengine.operators.rank import exact_quantiles


def _last(sw: SeriesWindow, c: str):
    return F.max_by(F.col(c), F.col(sw.time_col))


def _newest(df: DataFrame, sw: SeriesWindow, k: int) -> DataFrame:
    """The last ``k`` rows of each series."""
    back = Window.partitionBy(*sw.series_cols).orderBy(*[F.col(c).desc() for c in sw.order_cols])
    return df.withColumn("_newest", F.row_number().over(back)).where(F.col("_newest") <= k).drop("_newest")


def price_summary(df: DataFrame, sw: SeriesWindow, price: str = "price") -> DataFrame:
    """Rows, valid rows, first/last time, current, mean, median, std (ddof 1), min, max,
    volatility % = 100 std / mean (over the non-null prices)."""
    valid = F.col(price).isNotNull()
    median = exact_quantiles(df, sw.series_cols, [price], [0.5])
    stats = df.groupBy(*sw.series_cols).agg(
        F.count(F.lit(1)).alias("total_records"),
        F.count(price).alias("valid_price_records"),
        F.min(sw.time_col).alias("start_dt"), F.max(sw.time_col).alias("end_dt"),
        F.max_by(F.col(price), F.when(valid, F.col(sw.time_col))).alias("current"),
        F.avg(price).alias("mean"),
        F.stddev_samp(price).alias("std"), F.min(price).alias("min"), F.max(price).alias("max"),
        (F.lit(100.0) * safe_div(F.stddev_samp(price), F.avg(price))).alias("volatility_percent"))
    return stats.join(median, list(sw.series_cols)).select(
        *sw.series_cols, "total_records", "valid_price_records", "start_dt", "end_dt", "current", "mean", F.col(f"_q_{price}")[0].alias("median"),
        "std", "min", "max", "volatility_percent")


def _valid_positions(df: DataFrame, sw: SeriesWindow, price: str, cols: dict, k: int) -> DataFrame:
    v = _newest(df.filter(F.col(price).isNotNull()), sw, k)
    return v.select(*sw.series_cols, sw.time_col, price, *[c.alias(n) for n, c in cols.items()])


def recent_change(df: DataFrame, sw: SeriesWindow, price: str = "price", periods: Sequence[int] = (7, 30)) -> DataFrame:
    """Last - value k rows back (needs k + 1 valid rows) and the change in %."""
    st = _valid_positions(df, sw, price, {f"_lag{k}": F.lag(price, k).over(sw.w) for k in periods}, max(periods) + 1)
    aggs = []
    for k in periods:
        last = F.max_by(F.struct(F.col(price).alias("p"), F.col(f"_lag{k}").alias("b")), F.col(sw.time_col))
        aggs.append(last.alias(f"_s{k}"))
    g = st.groupBy(*sw.series_cols).agg(*aggs)
    out = [*sw.series_cols]
    for k in periods:
        p, b = F.col(f"_s{k}.p"), F.col(f"_s{k}.b")
        out += [(p - b).alias(f"last_{k}_days_change"),
                (safe_div(p - b, b) * 100.0).alias(f"last_{k}_days_change_percent")]
    return g.select(*out)


def tail_averages(df: DataFrame, sw: SeriesWindow, price: str = "price", ks: Sequence[int] = (5, 10, 20)) -> DataFrame:
    """Mean of the last k valid prices; NULL when the series has fewer than k (all NULL
    below the first k)."""
    st = _valid_positions(df, sw, price, {f"_m{k}": F.avg(price).over(sw.incl(k)) for k in ks}, max(ks))
    g = st.groupBy(*sw.series_cols).agg(F.count(F.lit(1)).alias("_n"),
                                        *[_last(sw, f"_m{k}").alias(f"_t{k}") for k in ks])
    return g.select(*sw.series_cols, *[F.when(F.col("_n") >= max(k, ks[0]), F.col(f"_t{k}")).alias(f"sma_{k}")
                                       for k in ks])


def latest_with_change(df: DataFrame, sw: SeriesWindow, price: str = "price") -> DataFrame:
    """Last row (OHLCV) with change and % vs the previous row (0 for a single row or a
    previous price of 0)."""
    st = _newest(df, sw, 2).select("*", F.lag(price, 1).over(sw.w).alias("_prev"))
    cols = [c for c in df.columns if c not in sw.series_cols]
    last = F.max_by(F.struct(*[F.col(c) for c in cols + ["_prev"]]), F.col(sw.time_col)).alias("_l")
    g = st.groupBy(*sw.series_cols).agg(last)
    p, prev = F.col(f"_l.{price}"), F.col("_l._prev")
    change = F.when(prev.isNull(), F.lit(0.0)).otherwise(p - prev)
    pct = F.when(prev.isNull() | (prev == 0), F.lit(0.0)).otherwise((p - prev) / prev * 100.0)
    return g.select(*sw.series_cols, *[F.col(f"_l.{c}").alias(c) for c in cols],
                    change.alias("change"), pct.alias("change_percent"))


def weekly_change_trend(df: DataFrame, sw: SeriesWindow, price: str = "price", back: int = 6) -> DataFrame:
    """100 (last - row 7th from the end) / that row, rounded to 2; trend up/down. With fewer
    than 7 rows the reference compares with itself (change 0, 'down')."""
    st = _newest(df, sw, back + 1).select(*sw.series_cols, sw.time_col, price, F.lag(price, back).over(sw.w).alias("_b"))
    g = st.groupBy(*sw.series_cols).agg(
        F.max_by(F.struct(F.col(price).alias("p"), F.col("_b").alias("b")), F.col(sw.time_col)).alias("_l"))
    p, b = F.col("_l.p"), F.coalesce(F.col("_l.b"), F.col("_l.p"))
    return g.select(*sw.series_cols, F.round(p, 2).alias("current_price"),
                    F.round(safe_div(p - b, b) * 100.0, 2).alias("weekly_change"),
                    F.when(p > b, "up").otherwise("down").alias("trend"))


def latest_per_source(quotes: DataFrame, source: str = "source", ts: str = "ts",
                      cols: Sequence[str] = ("price",)) -> DataFrame:
    """T02 batch twin: last quote per source (max_by on the timestamp, then the values, so that
    quotes with one timestamp give one answer; map-side partials)."""
    last = F.max_by(F.struct(*[F.col(c) for c in [ts, *cols]]), F.struct(*[F.col(c) for c in [ts, *cols]])).alias("_l")
    return quotes.groupBy(source).agg(last).select(source, *[F.col(f"_l.{c}").alias(c) for c in [ts, *cols]])


def cross_source_summary(latest: DataFrame, price: str = "price", ts: str = "ts") -> DataFrame:
    """Over the sources with price > 0: average (2 dp), max, min, spread (2 dp), count and
    the newest timestamp. Always one row (a global aggregate)."""
    v = latest.filter(F.col(price) > 0)
    return v.agg(F.round(F.avg(price), 2).alias("average"), F.max(price).alias("highest"),
                 F.min(price).alias("lowest"), F.round(F.max(price) - F.min(price), 2).alias("spread"),
                 F.count(F.lit(1)).alias("sources_count"), F.max(ts).alias("ts"))


def pick_source(quotes: DataFrame, bucket_col: str, priority: str = "priority", ts: str = "ts",
                cols: Sequence[str] = ("source", "price"), buckets: DataFrame | None = None,
                default: dict | None = None) -> DataFrame:
    """Per bucket, the quote of the most preferred source (lowest priority, newest ts);
    a bucket without quotes reuses the previous pick (cache), before any quote the default.
    ``buckets`` (one row per bucket) defines the output rows."""
    best = F.min_by(F.struct(*[F.col(c) for c in cols]), F.struct(F.col(priority), -F.unix_micros(F.col(ts).cast("timestamp"))))
    pick = quotes.groupBy(bucket_col).agg(best.alias("_p"))
    if buckets is None:
        return pick.select(bucket_col, *[F.col(f"_p.{c}").alias(c) for c in cols])
    from tsengine.plans.halo import ffill_global
    j = buckets.join(pick, bucket_col, "left").withColumn("fresh", F.col("_p").isNotNull())
    out = ffill_global(j, bucket_col, ["_p"]).withColumnRenamed("_p", "_c")
    default = default or {}
    return out.select(bucket_col, "fresh", *[F.coalesce(F.col(f"_c.{c}"), F.lit(default.get(c))).alias(c)
                                             for c in cols])


def prediction_range(forecast: DataFrame, keys: Sequence[str], pred: str = "pred",
                     std: str = "pred_std", price: str = "price") -> DataFrame:
    """A21 + A22 per key: min, max, mean of the forecast, average uncertainty (mean std),
    uncertainty score = avg std / last price (NULL when 0), band 0.95 min .. 1.05 max."""
    g = forecast.groupBy(*keys).agg(
        F.min(pred).alias("min_prediction"), F.max(pred).alias("max_prediction"),
        F.avg(pred).alias("mean_prediction"), F.avg(std).alias("avg_uncertainty"),
        F.max_by(F.col(price), F.col("dt")).alias("_last_price"))
    return g.select(*keys, "min_prediction", "max_prediction", "mean_prediction", "avg_uncertainty",
                    safe_div(F.col("avg_uncertainty"), F.col("_last_price")).alias("uncertainty_score"),
                    (F.col("min_prediction") * 0.95).alias("band_lower"),
                    (F.col("max_prediction") * 1.05).alias("band_upper"))
