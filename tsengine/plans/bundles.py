"""Feature bundles (W48–W52): many operators over ONE window specification.

Each bundle is a chain of ``select`` stages on the same ``partitionBy(series).orderBy(dt)``
spec — Catalyst plans one hash exchange on the series key, one sort, and stacked Window
operators, independent of the number of features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tsengine.frames import SeriesWindow
from tsengine.functions.calendar import calendar_parts, cyclical, default_calendar, period_end_flags
from tsengine.operators import features as W
from tsengine.operators.interact import capped_interactions, pair_interactions
from tsengine.operators.stages import Stages

RAW_COLS = ("price", "dt", "high", "low", "open", "close", "volume")


def _drop_private(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def quick_features(df: DataFrame, sw: SeriesWindow, price: str = "price") -> DataFrame:
    """SMA 5/10/20, pct 1/5, std 10, lags 1–3, next-row target; rows with any NULL dropped."""
    s = Stages([{
        "ma_5": W.sma(sw, price, 5), "ma_10": W.sma(sw, price, 10), "ma_20": W.sma(sw, price, 20),
        "price_change": W.pct_change(sw, price, 1), "price_change_5": W.pct_change(sw, price, 5),
        "volatility": W.frame_agg(sw, price, sw.incl(10), "std", 10),
        "price_lag_1": sw.lag(price, 1), "price_lag_2": sw.lag(price, 2), "price_lag_3": sw.lag(price, 3),
        "target": sw.lead(price, 1),
    }])
    out = s.apply(df)
    return out.na.drop("any", subset=s.names)


def past_feature_stages(sw: SeriesWindow, price: str = "price", time_col: str = "dt") -> Stages:
    """The leak-free feature set of W50 (every value uses rows strictly before the current one,
    calendar parts excepted), without interactions."""
    cal = calendar_parts(time_col)
    cyc = cyclical(time_col, doy_period=365.0)
    temporal = {k: cal[k] for k in ("day_of_week", "month", "quarter", "year", "day_of_year")}
    temporal.update({k: cyc[k] for k in ("day_of_week_sin", "day_of_week_cos", "month_sin",
                                         "month_cos", "day_of_year_sin", "day_of_year_cos")})
    return (Stages([temporal])
            + W.lag_features(sw, price, (1, 2, 3, 5, 7, 10, 14, 21, 30))
            + W.past_rolling(sw, price)
            + W.rsi_past(sw, price)
            + W.macd(sw, price, past=True)
            + W.bollinger_past(sw, price)
            + W.stochastic_past(sw, price)
            + W.williams_r(sw, price)
            + W.atr(sw, price)
            + W.past_returns(sw, price)
            + W.past_volatility(sw, price))


def past_feature_order(sw: SeriesWindow, price: str = "price") -> list[str]:
    """Column order the reference creates the past features in (used for interaction picks)."""
    groups = [
        ["day_of_week", "month", "quarter", "year", "day_of_year", "day_of_week_sin",
         "day_of_week_cos", "month_sin", "month_cos", "day_of_year_sin", "day_of_year_cos"],
        W.lag_features(sw, price, (1, 2, 3, 5, 7, 10, 14, 21, 30)).names,
        W.past_rolling(sw, price).names,
        ["rsi_14", "rsi_30", "macd", "macd_signal", "macd_histogram"],
        W.bollinger_past(sw, price).names,
        ["stoch_k", "stoch_d", "williams_r", "atr"],
        W.past_returns(sw, price).names,
        [n for n in W.past_volatility(sw, price).names if not n.startswith("_")],
    ]
    return [n for g in groups for n in g]


def engineer_past(df: DataFrame, sw: SeriesWindow, price: str = "price", horizon: int = 1,
                  min_history: int = 60, max_interactions: int = 15) -> DataFrame:
    """W50 (flagship): leak-free features + target ``horizon`` rows ahead; the first
    ``min_history`` and last ``horizon`` rows of each series are cut (P15), then rows with a NULL
    feature or target (P11)."""
    order = past_feature_order(sw, price)
    s = past_feature_stages(sw, price, sw.time_col)
    inter = capped_interactions(order, 10, max_interactions)
    s.add(len(s.stages), inter)
    s = s + Stages([{"_idx": sw.row_idx(), "_n": sw.n_rows(), "target": sw.lead(price, horizon)}])
    out = s.apply(df)
    feats = [c for c in order if c not in RAW_COLS] + list(inter)
    out = out.filter((F.col("_idx") >= min_history) & (F.col("_idx") < F.col("_n") - horizon))
    out = out.na.drop("any", subset=feats + ["target"])
    return out.select(*sw.series_cols, sw.time_col, *feats, "target")


def feature_contract_50(df: DataFrame, sw: SeriesWindow, has_date: bool = True) -> DataFrame:
    """The fixed 50-column contract (OHLC defaults, SMA/EMA/Bollinger, lag, rolling suite,
    position/z-score, calendar), then forward fill, backward fill and 0 (P04, P05, P07)."""
    cols = set(df.columns)
    base = {}
    if "open" not in cols:
        base["open"] = F.col("price")
    if "high" not in cols:
        base["high"] = F.col("price") * 1.01
    if "low" not in cols:
        base["low"] = F.col("price") * 0.99
    if "close" not in cols:
        base["close"] = F.col("price")
    if base:
        df = df.select("*", *[v.alias(k) for k, v in base.items()])
    c = "close"
    s0 = {f"sma_{k}": W.sma(sw, c, k, 1) for k in (5, 10, 20, 50)}
    s0.update(W.bollinger(sw, c, 20, 2.0, min_periods=1).stages[0])
    s0.update(W.lag_filled(sw, c).stages[0])
    s0.update(W.rolling_stats(sw, c, (5, 10, 20, 50), ("mean", "min", "max", "median", "q25", "q75"),
                              min_periods=1, prefix="price_rolling").stages[0])
    s0.update(W.position_zscore(sw, c, (20, 50, 100), soft=True).stages[0])
    if has_date:
        cal = calendar_parts(sw.time_col)
        cyc = cyclical(sw.time_col, 365.0)
        s0.update({"month": cal["month"], "day_of_year": cal["day_of_year"],
                   "week_of_year": cal["week_of_year"], "quarter": cal["quarter"],
                   "month_cos": cyc["month_cos"], "day_of_year_cos": cyc["day_of_year_cos"]})
    else:
        s0.update(default_calendar())
    s = Stages([s0]) + W.ema_stages(sw, c, 12, "ema_12") + W.ema_stages(sw, c, 26, "ema_26")
    out = _drop_private(s.apply(df))
    from tsengine.operators.clean import fill_forward_backward_zero
    num = [f.name for f in out.schema.fields if isinstance(f.dataType, NumericType)]
    return fill_forward_backward_zero(out, sw, num)


def engineer_incl(df: DataFrame, sw: SeriesWindow, price: str = "price", sparse_keep: float = 0.7) -> DataFrame:
    """Lags, strict rolling suite, momentum, volatility, position/z-score, trend/slope,
    calendar + cyclical + period flags, F01 interactions; rows below 70 % non-null dropped (P10).
    (Uses the current row: only valid with a lead target, see SURVEY Q1.)"""
    s = (W.lag_features(sw, price)
         + W.rolling_stats(sw, price)
         + W.momentum_features(sw, price)
         + W.annualised_vol(sw, price)
         + W.position_zscore(sw, price, (20, 50, 100), soft=False, out_prefix=price)
         + W.trend_features(sw, price))
    cal = calendar_parts(sw.time_col)
    cyc = cyclical(sw.time_col, 365.25)
    flags = period_end_flags(sw.time_col)
    s.add(0, {**cal, **cyc, **flags})
    out = _drop_private(s.apply(df))
    numeric = {f.name for f in out.schema.fields if isinstance(f.dataType, NumericType)}
    inter = pair_interactions(out.columns, numeric)
    out = out.select("*", *[v.alias(k) for k, v in inter.items()])
    from tsengine.operators.clean import drop_sparse_rows
    return drop_sparse_rows(out, sparse_keep)


def technical_indicators(df: DataFrame, sw: SeriesWindow, price: str = "price") -> DataFrame:
    """SMA 5/10/20 (+ adaptive 50), EMA 12/26, MACD + signal, RSI 14, Bollinger 20,
    pct 1/5/10, volatility 5/10/20 — strict windows."""
    s = Stages([{f"sma_{k}": W.sma(sw, price, k) for k in (5, 10, 20)}])
    s = s + W.sma_adaptive(sw, price)
    s = s + W.macd(sw, price, names={"ema_fast": "ema_12", "ema_slow": "ema_26"})
    s = s + W.rsi(sw, price, 14, "rsi")
    s = s + W.bollinger(sw, price, 20, 2.0)
    s.add(0, {"price_change": W.pct_change(sw, price, 1), "price_change_5": W.pct_change(sw, price, 5),
              "price_change_10": W.pct_change(sw, price, 10)})
    s = s + W.price_std(sw, price, (5, 10, 20))
    return _drop_private(s.apply(df))


def engineer_past_long(df: DataFrame, sw: SeriesWindow, price: str = "price", horizon: int = 1,
                       min_history: int = 60, max_interactions: int = 15, halo: int = 1024,
                       block_rows: int = 8192) -> DataFrame:
    """W50 for few, very long series (the reference's own single-series case) without a
    one-task window: features run on halo blocks (every frame / lag / EWM carry reaches back
    less than ``halo`` rows; EWM weights at ``halo`` rows are below 1e-17), the target is an equi
    join on the global row position (pos + horizon) and the trims use per-series counts."""
    from tsengine.plans.halo import add_blocks, drop_halo
    order = past_feature_order(sw, price)
    inter = capped_interactions(order, 10, max_interactions)
    blocked, bsw = add_blocks(df, sw, block_rows, halo)
    st = past_feature_stages(bsw, price, sw.time_col)
    st.add(len(st.stages), inter)
    feats_df = drop_halo(st.apply(blocked), keep_pos=True).withColumnRenamed("_pos", "_gpos")
    feats = [c for c in order if c not in RAW_COLS] + list(inter)
    pos = feats_df.select(*sw.series_cols, sw.time_col, "_gpos", *feats)
    nxt = blocked.filter(~F.col("_halo")).select(*[F.col(c).alias(f"_t_{c}") for c in sw.series_cols],
                                                 (F.col("_pos") - horizon).alias("_tpos"), F.col(price).alias("target"))
    cond = [F.col(c) == F.col(f"_t_{c}") for c in sw.series_cols] + [F.col("_gpos") == F.col("_tpos")]
    j = pos.join(nxt, cond, "left")
    n = df.groupBy(*sw.series_cols).agg(F.count(F.lit(1)).alias("_n"))
    j = j.join(n, sw.series_cols)
    out = j.filter((F.col("_gpos") >= min_history) & (F.col("_gpos") < F.col("_n") - horizon))
    out = out.na.drop("any", subset=feats + ["target"])
    return out.select(*sw.series_cols, sw.time_col, *feats, "target")
