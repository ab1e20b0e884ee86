"""Joins (J01–J06).

Equi joins only; the join strategy is left to Catalyst/AQE, which turns a sort-merge join into a
broadcast hash join at runtime when the measured size of one side is below
``spark.sql.autoBroadcastJoinThreshold`` (a checked bound, never a blind hint on a growing side).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsengine.frames import SeriesWindow
from tsengine.operators.clean import ffill
from tsengine.plans.halo import ffill_global


def pivot_indicators(long_df: DataFrame, names: Sequence[str], key: str = "indicator",
                     time_col: str = "dt", value: str = "value") -> DataFrame:
    """Long (indicator, dt, value) -> wide (dt, one column per indicator). One aggregation
    replaces the N-way full outer join on dt (same rows: every dt of any indicator). A fixed
    value list keeps Spark from a distinct-values pre-pass."""
    return long_df.groupBy(time_col).pivot(key, list(names)).agg(F.max(value))


def merge_indicators(long_df: DataFrame, names: Sequence[str], key: str = "indicator",
                     time_col: str = "dt", value: str = "value") -> DataFrame:
    """Full outer merge on dt, sorted, forward filled (global order, bucketed carry)."""
    wide = pivot_indicators(long_df, names, key, time_col, value)
    return ffill_global(wide, time_col, list(names))


def merge_indicators_outer(frames: Sequence[DataFrame], time_col: str = "dt") -> DataFrame:
    """J01, join form: chained FULL OUTER joins on dt (one shuffle per join; prefer the pivot)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.join(f, time_col, "full")
    return out


def attach_indicators(bars: DataFrame, wide: DataFrame, sw: SeriesWindow, cols: Sequence[str]) -> DataFrame:
    """Bars LEFT JOIN indicators on dt, then forward fill the indicator columns along the
    bar rows of each series (an indicator landing on a day without a bar is lost)."""
    j = bars.join(wide, sw.time_col, "left")
    return ffill(j, sw, list(cols))


def attach_indicators_asof(bars: DataFrame, wide: DataFrame, sw: SeriesWindow, cols: Sequence[str]) -> DataFrame:
    """Per bar, the latest value of each indicator at or before the bar time. The as-of
    step runs on the distinct bar times only (bounded by the calendar, not by the series count):
    bar times + indicator rows, forward filled in global time order (indicator rows first at equal
    time), then an equi join back on the time column — no range join, no per-series copy."""
    t = sw.time_col
    times = bars.select(t).distinct().withColumn("_is_bar", F.lit(1))
    u = times.unionByName(wide.select(t, *cols).withColumn("_is_bar", F.lit(0)), allowMissingColumns=True)
    filled = ffill_global(u, t, list(cols), order_extra=["_is_bar"])
    asof = filled.filter(F.col("_is_bar") == 1).drop("_is_bar")
    return bars.join(asof, t, "left")


def message_price_context(messages: DataFrame, summary_row: DataFrame, text_col: str,
                          keywords: Sequence[str], avg_col: str = "average", ts_col: str = "ts") -> DataFrame:
    """Every message gets the latest cross-source summary (average, ts) when it mentions
    a keyword. ``summary_row`` is a global aggregate — exactly one row — so broadcasting it is
    bounded by construction."""
    import re
    pat = "|".join(re.escape(k.lower()) for k in keywords)
    hit = F.lower(F.col(text_col)).rlike(pat)
    j = messages.crossJoin(F.broadcast(summary_row.select(avg_col, ts_col)))
    ctx = F.when(hit, F.struct(F.col(avg_col).alias("current_avg"), F.col(ts_col).alias("timestamp")))
    return j.select(*messages.columns, ctx.alias("price_context"))


def align_actuals(preds: DataFrame, actuals: DataFrame, sw: SeriesWindow, horizon: int = 1,
                  idx: str = "row_idx", y: str = "y") -> DataFrame:
    """Prediction at position i is scored against the actual at i + horizon - 1 (equi join
    on a computed key, both sides hash-partitioned on (series, position))."""
    a = actuals.select(*[F.col(c).alias(f"_a_{c}") for c in sw.series_cols],
                       F.col(idx).alias("_aidx"), F.col(y).alias("actual"))
    cond = [F.col(c) == F.col(f"_a_{c}") for c in sw.series_cols] + [F.col("_aidx") == F.col(idx) + F.lit(horizon - 1)]
    j = preds.join(a, cond, "inner")
    return j.select(*preds.columns, "actual")


def collect_model_predictions(long_preds: DataFrame, keys: Sequence[str], models: Sequence[str],
                              model_col: str = "model", pred_col: str = "pred") -> DataFrame:
    """Long (keys, model, pred) -> one column per model (fixed model list, no distinct pass)."""
    return long_preds.groupBy(*keys).pivot(model_col, list(models)).agg(F.first(pred_col))


def unpivot_predictions(wide: DataFrame, keys: Sequence[str], models: Sequence[str]) -> DataFrame:
    """J06 inverse: wide model columns -> (keys, model, pred)."""
    return wide.unpivot(list(keys), list(models), "model", "pred").filter(F.col("pred").isNotNull())


def with_key(df: DataFrame, cols: Sequence[str]) -> Column:
    return F.struct(*[F.col(c) for c in cols])
