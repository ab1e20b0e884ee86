"""Projection, filter and cleaning operators.

Per-series statistics (median, mean/std for the 3-sigma rule, row counts) are computed with a
``groupBy`` on the series key — partial aggregation runs map-side — and joined back on the key.
The per-series table has one row per series; the join is left to AQE, which broadcasts it only
when its measured size is under ``spark.sql.autoBroadcastJoinThreshold``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

from tsengine.frames import SeriesWindow
from tsengine.operators.rank import exact_quantiles


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, NumericType) and f.name not in exclude]


def ensure_price(df: DataFrame, price: str = "price", close: str = "close") -> DataFrame:
    """Price := close when the price column is missing."""
    if price in df.columns or close not in df.columns:
        return df
    return df.withColumn(price, F.col(close))


def dedupe_first(df: DataFrame, sw: SeriesWindow, order_cols: Sequence[str]) -> DataFrame:
    """Keep the FIRST row per (series, time) in input order ``order_cols`` (a total order;
    never a bare ``dropDuplicates``, which keeps an arbitrary row)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*sw.series_cols, sw.time_col).orderBy(*order_cols)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def sort_by_time(df: DataFrame, sw: SeriesWindow) -> DataFrame:
    """Ordering is part of every window; an explicit sort only at a sink."""
    return df.orderBy(*sw.series_cols, sw.time_col)


def ffill(df: DataFrame, sw: SeriesWindow, cols: Sequence[str]) -> DataFrame:
    """Last non-null value at or before the row."""
    f = sw.upto()
    return df.select(*[F.last(c, ignorenulls=True).over(f).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def bfill(df: DataFrame, sw: SeriesWindow, cols: Sequence[str]) -> DataFrame:
    """First non-null value at or after the row (last one of the reversed running frame)."""
    f = sw.after()
    return df.select(*[F.last(c, ignorenulls=True).over(f).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


def ffill_bfill(df: DataFrame, sw: SeriesWindow, cols: Sequence[str]) -> DataFrame:
    """P04 then P05 in one window stage: coalesce(last-before, first-after)."""
    up, after = sw.upto(), sw.after()
    return df.select(*[F.coalesce(F.last(c, True).over(up), F.last(c, True).over(after)).alias(c)
                       if c in cols else F.col(c) for c in df.columns])


def fill_forward_backward_zero(df: DataFrame, sw: SeriesWindow, cols: Sequence[str]) -> DataFrame:
    """P04 -> P05 -> P07 as one expression per column."""
    up, after = sw.upto(), sw.after()
    keys = set(sw.series_cols) | {sw.time_col}
    return df.select(*[
        F.coalesce(F.last(c, True).over(up), F.last(c, True).over(after), F.lit(0)).alias(c)
        if (c in cols and c not in keys) else F.col(c) for c in df.columns])


def series_stats(df: DataFrame, sw: SeriesWindow, aggs: dict[str, Column]) -> DataFrame:
    return df.groupBy(*sw.series_cols).agg(*[v.alias(k) for k, v in aggs.items()])


def fill_median(df: DataFrame, sw: SeriesWindow, cols: Sequence[str]) -> DataFrame:
    """NULLs take the series median (exact, linear interpolation) of their column."""
    types = {f.name: f.dataType for f in df.schema.fields}
    med = exact_quantiles(df, sw.series_cols, cols, [0.5]).select(*sw.series_cols, *[F.col(f"_q_{c}")[0].alias(f"_med_{c}") for c in cols])
    j = df.join(med, sw.series_cols, "left")

    def fill(c):
        m = F.col(f"_med_{c}")
        if isinstance(types[c], IntegralType):  # integer columns keep their type
            m = F.round(m).cast(types[c])
        return F.coalesce(F.col(c), m).alias(c)
    return j.select(*[fill(c) if c in cols else F.col(c) for c in df.columns])


def fill_zero(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P07."""
    return df.na.fill(0, subset=list(cols) if cols else None)


def drop_outliers_3sigma(df: DataFrame, sw: SeriesWindow, col: str = "price", k: float = 3.0,
                         min_rows: int = 10) -> DataFrame:
    """Only for series with more than ``min_rows`` rows and std > 0 (ddof 1), keep rows
    with ``mean - k std <= x <= mean + k std``. Rows with a NULL value are kept (pandas
    comparisons with NaN are False, so they are not outliers)."""
    st = series_stats(df, sw, {"_n": F.count(F.lit(1)), "_m": F.avg(col), "_s": F.stddev_samp(col)})
    j = df.join(st, sw.series_cols, "left")
    active = (F.col("_n") > min_rows) & (F.col("_s") > 0)
    x = F.col(col)
    out_lo = x < F.col("_m") - F.lit(k) * F.col("_s")
    out_hi = x > F.col("_m") + F.lit(k) * F.col("_s")
    is_out = F.coalesce(active & (out_lo | out_hi), F.lit(False))
    return j.filter(~is_out).select(*df.columns)


def drop_any_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P09 / P11 (``na.drop('any')`` on features + target)."""
    return df.na.drop("any", subset=list(cols) if cols else None)


def drop_sparse_rows(df: DataFrame, keep: float = 0.7) -> DataFrame:
    """P10: keep rows with at least ``keep`` x ncols non-null values."""
    return df.na.drop(thresh=int(math.ceil(keep * len(df.columns))))


def count_removed(before: DataFrame, after: DataFrame) -> int:
    """P11 report: removed row count (an action; call once at the end of a job)."""
    return before.count() - after.count()


def default_ohlc(df: DataFrame, price: str = "price") -> DataFrame:
    """open = price, high = 1.01 price, low = 0.99 price, close = price, volume = 1000,
    each only when missing or NULL."""
    defaults = {"open": F.col(price), "high": F.col(price) * 1.01, "low": F.col(price) * 0.99,
                "close": F.col(price), "volume": F.lit(1000).cast("long")}
    out = df
    for c, d in defaults.items():
        out = out.withColumn(c, F.coalesce(F.col(c), d) if c in df.columns else d)
    return out


def fix_ohlc_envelope(df: DataFrame) -> DataFrame:
    """high = max(o, h, l, c), low = min(o, h, l, c)."""
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    return df.withColumn("high", F.greatest(o, h, lo, c)).withColumn("low", F.least(o, h, lo, c))


def select_features(df: DataFrame, target: str = "target",
                    exclude: Sequence[str] = ("price", "dt", "date", "high", "low", "open", "close",
                                              "volume")) -> list[str]:
    """Every numeric column but the target, time and raw OHLCV."""
    return numeric_columns(df, exclude=[target, *exclude])


def trim_history(df: DataFrame, sw: SeriesWindow, min_periods: int = 60, horizon: int = 1) -> DataFrame:
    """Drop the first ``min_periods`` and last ``horizon`` rows of each series."""
    t = df.select("*", sw.row_idx().alias("_i"), sw.n_rows().alias("_n"))
    return t.filter((F.col("_i") >= min_periods) & (F.col("_i") < F.col("_n") - horizon)).drop("_i", "_n")


def to_numeric(df: DataFrame, col: str) -> DataFrame:
    """Unparsable values become NULL (``try_cast``) and are dropped."""
    return df.withColumn(col, F.col(col).try_cast("double")).filter(F.col(col).isNotNull())


def keyword_filter(df: DataFrame, col: str, keywords: Sequence[str]) -> DataFrame:
    """Case-insensitive 'contains any keyword' (a regex alternation of escaped literals)."""
    import re
    pat = "|".join(re.escape(k.lower()) for k in keywords)
    return df.filter(F.lower(F.col(col)).rlike(pat))


def project_quote_defaults(df: DataFrame) -> DataFrame:
    """high/low/open default to price, volume and change to 0."""
    p = F.col("price")
    out = df
    for c, d in {"high": p, "low": p, "open": p, "volume": F.lit(0).cast("long"),
                 "change": F.lit(0.0), "change_percent": F.lit(0.0)}.items():
        out = out.withColumn(c, F.coalesce(F.col(c), d) if c in df.columns else d)
    return out


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P20: one pass: NULL count per column, row count and complete-row count; returned long
    as (column, nulls, rows, complete_rows, all_null)."""
    cols = list(cols or df.columns)
    complete = F.sum(F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in cols]) == 0, 1)
                     .otherwise(0)) if len(cols) > 1 else F.sum(F.col(cols[0]).isNotNull().cast("int"))
    agg = df.agg(F.count(F.lit(1)).alias("rows"), complete.alias("complete_rows"),
                 *[F.sum(F.col(c).isNull().cast("long")).alias(f"n{i}") for i, c in enumerate(cols)])
    stack = ", ".join(f"'{c}', n{i}" for i, c in enumerate(cols))
    long = agg.select("rows", "complete_rows", F.expr(f"stack({len(cols)}, {stack}) as (column, nulls)"))
    return long.select("column", F.col("nulls").cast("long").alias("nulls"), "rows",
                       F.col("complete_rows").cast("long").alias("complete_rows"),
                       (F.col("nulls") == F.col("rows")).alias("all_null"))


def drop_all_null_columns(df: DataFrame, profile: DataFrame) -> DataFrame:
    """The profile is one row per column (bounded by the schema), so collecting it is
    safe."""
    dead = {r["column"] for r in profile.filter("all_null").select("column").collect()}
    return df.select(*[c for c in df.columns if c not in dead])


def min_rows_guard(df: DataFrame, sw: SeriesWindow, min_rows: int = 50) -> DataFrame:
    """Series with fewer than ``min_rows`` rows are dropped (semi join on the per-series
    count)."""
    ok = df.groupBy(*sw.series_cols).count().filter(F.col("count") >= min_rows).select(*sw.series_cols)
    return df.join(ok, sw.series_cols, "left_semi")
