"""Lag, rolling, momentum, volatility and technical-indicator features.

Every builder returns :class:`Stages` on a :class:`SeriesWindow`; ``apply(df)`` runs them.
"incl" frames end at the current row (pandas ``rolling(k)``); "past" frames end one row before
(pandas ``shift(1).rolling(k)``), fused into one frame ``rows(-k, -1)`` instead of a lag-of-lag.
pandas ``min_periods`` counts non-null values: ``SeriesWindow.mp``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsengine.frames import SeriesWindow
from tsengine.functions.core import EPS, safe_div, safe_ln, strict_greatest
from tsengine.functions.ewm import ewm_mean, ewm_stages
from tsengine.operators.stages import Stages

SQRT_252 = math.sqrt(252.0)

_AGGS = {
    "mean": F.avg,
    "std": F.stddev_samp,
    "min": F.min,
    "max": F.max,
    "sum": F.sum,
    "median": lambda c: F.percentile(c, 0.5),
    "q25": lambda c: F.percentile(c, 0.25),
    "q75": lambda c: F.percentile(c, 0.75),
}


def frame_agg(sw: SeriesWindow, c: Column | str, frame, stat: str, min_periods: int) -> Column:
    return sw.mp(c, frame, min_periods, _AGGS[stat])


# -- lags and leads -------------------------------------------------------------------------

def lag_features(sw: SeriesWindow, col: str = "price", lags: Sequence[int] = (1, 2, 3, 5, 10, 20)) -> Stages:
    """W01 / W02 (lags 1,2,3,5,7,10,14,21,30): ``{col}_lag_{k}``."""
    return Stages([{f"{col}_lag_{k}": sw.lag(col, k) for k in lags}])


def lag_filled(sw: SeriesWindow, col: str = "close", name: str = "price_lag_1") -> Stages:
    """Lag 1, the first row takes its own value."""
    return Stages([{name: F.coalesce(sw.lag(col, 1), F.col(col))}])


def lead_target(sw: SeriesWindow, col: str = "price", horizon: int = 1, name: str = "target") -> Stages:
    """Value ``horizon`` rows ahead."""
    return Stages([{name: sw.lead(col, horizon)}])


# -- rolling statistics (incl) ------------------------------------------------------------------

def rolling_stats(sw: SeriesWindow, col: str = "price", windows: Sequence[int] = (5, 10, 20, 50),
                  stats: Sequence[str] = ("mean", "std", "min", "max", "median", "q25", "q75"),
                  min_periods: int | None = None, prefix: str | None = None) -> Stages:
    """W05–W09 (strict, ``min_periods = k``) and W12 (``min_periods = 1``):
    ``{col}_rolling_{stat}_{k}``."""
    p = prefix or f"{col}_rolling"
    out = {}
    for k in windows:
        mp = k if min_periods is None else min_periods
        for s in stats:
            out[f"{p}_{s}_{k}"] = frame_agg(sw, col, sw.incl(k), s, mp)
    return Stages([out])


def sma(sw: SeriesWindow, col: str, k: int, min_periods: int | None = None) -> Column:
    return frame_agg(sw, col, sw.incl(k), "mean", k if min_periods is None else min_periods)


# -- past rolling (shift(1).rolling) -------------------------------------------------------------

def past_rolling(sw: SeriesWindow, col: str = "price",
                 windows: Sequence[int] = (3, 5, 7, 10, 14, 21, 30, 60)) -> Stages:
    """W10 + W11: sma/std/min/max/median over the k rows before, ``min_periods=max(1,k//2)``,
    and position = (lag1 - min)/(max - min + 1e-8)."""
    out = {}
    lag1 = sw.lag(col, 1)
    for k in windows:
        f, mp = sw.past(k), max(1, k // 2)
        mn = frame_agg(sw, col, f, "min", mp)
        mx = frame_agg(sw, col, f, "max", mp)
        out[f"{col}_sma_{k}"] = frame_agg(sw, col, f, "mean", mp)
        out[f"{col}_std_{k}"] = frame_agg(sw, col, f, "std", mp)
        out[f"{col}_min_{k}"] = mn
        out[f"{col}_max_{k}"] = mx
        out[f"{col}_median_{k}"] = frame_agg(sw, col, f, "median", mp)
        out[f"{col}_position_{k}"] = (lag1 - mn) / (mx - mn + F.lit(EPS))
    return Stages([out])


# -- position / z-score -----------------------------------------------------------------------

def position_zscore(sw: SeriesWindow, col: str = "close", windows: Sequence[int] = (20, 50, 100),
                    soft: bool = True, out_prefix: str = "price") -> Stages:
    """W13 (soft: min_periods 1, +1e-8 in divisors) and W14/W15 (strict: min_periods k,
    NULL when the divisor is 0)."""
    out = {}
    c = F.col(col)
    for k in windows:
        f = sw.incl(k)
        mp = 1 if soft else k
        mn, mx = frame_agg(sw, col, f, "min", mp), frame_agg(sw, col, f, "max", mp)
        mean, std = frame_agg(sw, col, f, "mean", mp), frame_agg(sw, col, f, "std", mp)
        if soft:
            out[f"{out_prefix}_position_{k}"] = (c - mn) / (mx - mn + F.lit(EPS))
            out[f"{out_prefix}_zscore_{k}"] = (c - mean) / (std + F.lit(EPS))
        else:
            out[f"{out_prefix}_position_{k}"] = safe_div(c - mn, mx - mn)
            out[f"{out_prefix}_zscore_{k}"] = safe_div(c - mean, std)
    return Stages([out])


# -- momentum (incl) -------------------------------------------------------------------------

def pct_change(sw: SeriesWindow, col: str, k: int) -> Column:
    """X / lag(x, k) - 1 (NULL on a 0 divisor)."""
    return safe_div(F.col(col), sw.lag(col, k)) - F.lit(1.0)


def momentum_features(sw: SeriesWindow, col: str = "price", roc: Sequence[int] = (1, 5, 10, 20),
                      diff: Sequence[int] = (5, 10, 20)) -> Stages:
    """W16 ``{col}_roc_k``, W17 ``{col}_momentum_k`` = x - lag k, W18 acceleration = diff of roc_1."""
    s0 = {f"{col}_roc_{k}": pct_change(sw, col, k) for k in roc}
    s0.update({f"{col}_momentum_{k}": F.col(col) - sw.lag(col, k) for k in diff})
    s1 = {f"{col}_acceleration": F.col(f"{col}_roc_1") - sw.lag(f"{col}_roc_1", 1)}
    return Stages([s0, s1])


# -- past momentum (on shift(1)) --------------------------------------------------------------

def past_returns(sw: SeriesWindow, col: str = "price",
                 periods: Sequence[int] = (1, 2, 3, 5, 7, 10, 14, 21, 30),
                 momentum: Sequence[int] = (5, 10, 20, 50), roc: Sequence[int] = (5, 10, 20)) -> Stages:
    """W19 return_kd, W20 log_return_kd, W21 momentum_k, W22 roc_k (x100), all on lag 1:
    ratio lag(1)/lag(k+1) in one pass (shift fusion)."""
    lag1 = sw.lag(col, 1)
    out = {}
    for k in periods:
        r = safe_div(lag1, sw.lag(col, k + 1))
        out[f"return_{k}d"] = r - F.lit(1.0)
        out[f"log_return_{k}d"] = safe_ln(r)
    for k in momentum:
        out[f"momentum_{k}"] = safe_div(lag1, sw.lag(col, k + 1)) - F.lit(1.0)
    for k in roc:
        lk = sw.lag(col, k + 1)
        out[f"roc_{k}"] = safe_div(lag1 - lk, lk) * F.lit(100.0)
    return Stages([out])


# -- volatility ---------------------------------------------------------------------------------

def annualised_vol(sw: SeriesWindow, col: str = "price", windows: Sequence[int] = (5, 10, 20, 50)) -> Stages:
    """W23 std of 1-step returns over k (strict) x sqrt(252); W24 ratios 5/20, 10/50;
    W25 vol of vol = std over 20 of volatility_20 (three stages)."""
    ret = f"_{col}_ret1"
    s0 = {ret: pct_change(sw, col, 1)}
    s1 = {f"{col}_volatility_{k}": frame_agg(sw, ret, sw.incl(k), "std", k) * F.lit(SQRT_252)
          for k in windows}
    s2 = {
        f"{col}_vol_ratio_5_20": safe_div(F.col(f"{col}_volatility_5"), F.col(f"{col}_volatility_20")),
        f"{col}_vol_ratio_10_50": safe_div(F.col(f"{col}_volatility_10"), F.col(f"{col}_volatility_50")),
        f"{col}_vol_of_vol": frame_agg(sw, f"{col}_volatility_20", sw.incl(20), "std", 20),
    }
    return Stages([s0, s1, s2])


def price_std(sw: SeriesWindow, col: str = "price", windows: Sequence[int] = (5, 10, 20),
              name: str = "volatility_{k}") -> Stages:
    """Strict rolling std of the price itself."""
    return Stages([{name.format(k=k): frame_agg(sw, col, sw.incl(k), "std", k) for k in windows}])


def past_volatility(sw: SeriesWindow, col: str = "price",
                    windows: Sequence[int] = (5, 10, 20, 30, 60)) -> Stages:
    """W27 volatility_k (annualised std of lagged returns, min_periods max(1,k//2)),
    W28 realized_vol_k = sum r^2, W29 vol_clustering = mean |r| over 10 (min_periods 1)."""
    ret = f"_{col}_pret1"
    s0 = {ret: safe_div(sw.lag(col, 1), sw.lag(col, 2)) - F.lit(1.0)}
    s1 = {}
    r = F.col(ret)
    for k in windows:
        f, mp = sw.incl(k), max(1, k // 2)
        s1[f"volatility_{k}"] = frame_agg(sw, ret, f, "std", mp) * F.lit(SQRT_252)
        s1[f"realized_vol_{k}"] = sw.mp(r * r, f, mp, F.sum)
    s1["vol_clustering"] = sw.mp(F.abs(r), sw.incl(10), 1, F.avg)
    return Stages([s0, s1])


# -- moving averages, MACD ----------------------------------------------------------------------

def ema(sw: SeriesWindow, col: str, span: float, min_periods: int = 1) -> Column:
    """Pandas ``ewm(span, adjust=True).mean()`` as ONE column (exact, bounded frame of
    K rows folded with ``aggregate``; O(n K)). Bundles use :func:`ema_stages`, by default in this form."""
    return ewm_mean(col, sw, span=span, min_periods=min_periods)


# EWM implementation used by the bundles:
# "frame"  = one column over a bounded exact frame folded in time order (Horner, the same
#            operation order as pandas' recursion: results equal to the last bit; O(n K) work)
# "stages" = O(n) block-carry stages (6 window levels, ~1e-14 relative; preferred for very
#            long series where K = 509 rows per output row is too much work)
EWM_IMPL = "frame"


def ema_stages(sw: SeriesWindow, col: str, span: float, out: str, min_periods: int = 1) -> Stages:
    """W31 as window stages (block-relative running sums + block carries), or a single
    bounded-frame column when ``EWM_IMPL == "frame"``."""
    if EWM_IMPL == "frame":
        return Stages([{out: ewm_mean(col, sw, span=span, min_periods=min_periods)}])
    return ewm_stages(sw, col, out, span=span, min_periods=min_periods)


def macd(sw: SeriesWindow, col: str = "price", fast: int = 12, slow: int = 26, signal: int = 9,
         past: bool = False, names: dict[str, str] | None = None) -> Stages:
    """W32 (on the price) / W33 (``past``: on lag 1, with histogram). EMAs come first (see
    ``EWM_IMPL``); MACD and its signal follow in later stages of the same window spec."""
    n = {"ema_fast": f"ema_{fast}", "ema_slow": f"ema_{slow}", "macd": "macd",
         "signal": "macd_signal", "hist": "macd_histogram"}
    n.update(names or {})
    src = col
    s = Stages()
    base = 0
    if past:
        src = f"_{col}_lag1"
        s.add(0, {src: sw.lag(col, 1)})
        base = 1
    emas = ema_stages(sw, src, fast, n["ema_fast"]) + ema_stages(sw, src, slow, n["ema_slow"])
    s = s + emas.shifted(base)
    lvl = base + emas.depth
    s.add(lvl, {n["macd"]: F.col(n["ema_fast"]) - F.col(n["ema_slow"])})
    sig = ema_stages(sw, n["macd"], signal, n["signal"])
    s = s + sig.shifted(lvl + 1)
    if past:
        s.add(lvl + 1 + sig.depth, {n["hist"]: F.col(n["macd"]) - F.col(n["signal"])})
    return s


# -- RSI ----------------------------------------------------------------------------------------

def _gain_loss(sw: SeriesWindow, src: Column, src_lag: Column):
    delta = src - src_lag
    # pandas delta.where(delta > 0, 0): a NULL delta counts as 0
    gain = F.when(delta > 0, delta).otherwise(F.lit(0.0))
    loss = F.when(delta < 0, -delta).otherwise(F.lit(0.0))
    return gain, loss


def rsi(sw: SeriesWindow, col: str = "price", window: int = 14, name: str = "rsi") -> Stages:
    """Simple means of gains/losses over ``window`` rows (strict). loss = 0 -> 100 when
    gain > 0, NULL when both are 0 (pandas inf / NaN)."""
    g, lo = f"_{name}_gain", f"_{name}_loss"
    gain, loss = _gain_loss(sw, F.col(col), sw.lag(col, 1))
    s0 = {g: gain, lo: loss}
    f = sw.incl(window)
    ag = sw.mp(F.col(g), f, window, F.avg)
    al = sw.mp(F.col(lo), f, window, F.avg)
    val = F.when(al == 0, F.when(ag > 0, F.lit(100.0))).otherwise(
        F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + safe_div(ag, al)))
    return Stages([s0, {name: val}])


def rsi_past(sw: SeriesWindow, col: str = "price", windows: Sequence[int] = (14, 30)) -> Stages:
    """On lag 1, min_periods 1, rs = gain / (loss + 1e-8)."""
    g, lo = f"_{col}_pgain", f"_{col}_ploss"
    gain, loss = _gain_loss(sw, sw.lag(col, 1), sw.lag(col, 2))
    s1 = {}
    for k in windows:
        f = sw.incl(k)
        rs = sw.mp(F.col(g), f, 1, F.avg) / (sw.mp(F.col(lo), f, 1, F.avg) + F.lit(EPS))
        s1[f"rsi_{k}"] = F.lit(100.0) - F.lit(100.0) / (F.lit(1.0) + rs)
    return Stages([{g: gain, lo: loss}, s1])


# -- Bollinger ----------------------------------------------------------------------------------

def bollinger(sw: SeriesWindow, col: str = "price", window: int = 20, k: float = 2.0,
              min_periods: int | None = None, width: bool = False, prefix: str = "bb") -> Stages:
    """middle/upper/lower (+ width) over the rows ending at the current row."""
    f = sw.incl(window)
    mp = window if min_periods is None else min_periods
    mid = frame_agg(sw, col, f, "mean", mp)
    std = frame_agg(sw, col, f, "std", mp)
    out = {f"{prefix}_middle": mid, f"{prefix}_upper": mid + F.lit(k) * std,
           f"{prefix}_lower": mid - F.lit(k) * std}
    if width:
        out[f"{prefix}_width"] = F.lit(2.0 * k) * std
    return Stages([out])


def bollinger_past(sw: SeriesWindow, col: str = "price", windows: Sequence[int] = (20, 50)) -> Stages:
    """On lag 1, min_periods 1; upper, lower, width, position (+1e-8)."""
    out = {}
    lag1 = sw.lag(col, 1)
    for w in windows:
        f = sw.past(w)
        mid = frame_agg(sw, col, f, "mean", 1)
        std = frame_agg(sw, col, f, "std", 1)
        up, lo = mid + F.lit(2.0) * std, mid - F.lit(2.0) * std
        out[f"bb_upper_{w}"] = up
        out[f"bb_lower_{w}"] = lo
        out[f"bb_width_{w}"] = up - lo
        out[f"bb_position_{w}"] = (lag1 - lo) / ((up - lo) + F.lit(EPS))
    return Stages([out])


# -- oscillators --------------------------------------------------------------------------------

def stochastic_past(sw: SeriesWindow, col: str = "price", high: str = "high", low: str = "low",
                    k_window: int = 14, d_window: int = 3) -> Stages:
    """%K from lagged high/low/price, %D = mean of %K over 3 rows (min_periods 1)."""
    f = sw.past(k_window)
    ll = sw.mp(F.col(low), f, 1, F.min)
    hh = sw.mp(F.col(high), f, 1, F.max)
    k = F.lit(100.0) * (sw.lag(col, 1) - ll) / (hh - ll + F.lit(EPS))
    return Stages([{"stoch_k": k}, {"stoch_d": sw.mp(F.col("stoch_k"), sw.incl(d_window), 1, F.avg)}])


def stochastic_close(sw: SeriesWindow, col: str = "price", k_window: int = 14, d_window: int = 3) -> Stages:
    """On the price itself, frames ending at the current row, strict windows."""
    f = sw.incl(k_window)
    ll = frame_agg(sw, col, f, "min", k_window)
    hh = frame_agg(sw, col, f, "max", k_window)
    k = F.lit(100.0) * safe_div(F.col(col) - ll, hh - ll)
    return Stages([{"stoch_k": k}, {"stoch_d": sw.mp(F.col("stoch_k"), sw.incl(d_window), d_window, F.avg)}])


def williams_r(sw: SeriesWindow, col: str = "price", high: str = "high", low: str = "low",
               window: int = 14) -> Stages:
    """-100 (HH - c)/(HH - LL + 1e-8) on lagged inputs, min_periods 1."""
    f = sw.past(window)
    hh = sw.mp(F.col(high), f, 1, F.max)
    ll = sw.mp(F.col(low), f, 1, F.min)
    return Stages([{"williams_r": F.lit(-100.0) * (hh - sw.lag(col, 1)) / (hh - ll + F.lit(EPS))}])


def atr(sw: SeriesWindow, col: str = "price", high: str = "high", low: str = "low",
        window: int = 14) -> Stages:
    """Mean of true range on lagged inputs; a NULL previous close gives a NULL range
    (``np.maximum`` propagates NaN)."""
    h1, l1, c2 = sw.lag(high, 1), sw.lag(low, 1), sw.lag(col, 2)
    tr = strict_greatest(h1 - l1, F.abs(h1 - c2), F.abs(l1 - c2))
    return Stages([{"_tr": tr}, {"atr": sw.mp(F.col("_tr"), sw.incl(window), 1, F.avg)}])


# -- trend ----------------------------------------------------------------------------------------

def trend_features(sw: SeriesWindow, col: str = "price", windows: Sequence[int] = (5, 10, 20)) -> Stages:
    """W42 trend sign vs SMA k (0 when the SMA is NULL); W43 least-squares slope over the k
    rows ending here (``regr_slope`` on the row index, strict)."""
    s0 = {"_idx": sw.row_idx().cast("double")}
    s1 = {}
    c = F.col(col)
    for k in windows:
        m = sma(sw, col, k)
        s1[f"{col}_trend_{k}"] = F.when(c > m, 1).when(c < m, -1).otherwise(0)
        f = sw.incl(k)
        s1[f"{col}_slope_{k}"] = F.when(F.count(c).over(f) >= k, F.regr_slope(c, F.col("_idx")).over(f))
    return Stages([s0, s1])


def row_index(sw: SeriesWindow, name: str = "row_idx", with_count: bool = True) -> Stages:
    """0-based position and series length."""
    out = {name: sw.row_idx()}
    if with_count:
        out["n_rows"] = sw.n_rows()
    return Stages([out])


def sequences(sw: SeriesWindow, cols: Sequence[str], length: int = 20, horizon: int = 1,
              target: str = "price") -> Stages:
    """The previous ``length`` feature rows as an array of structs, label ``horizon-1``
    rows ahead; only complete sequences are kept by :func:`complete_sequences`."""
    seq = F.collect_list(F.struct(*[F.col(c) for c in cols])).over(sw.past(length))
    lbl = F.col(target) if horizon == 1 else sw.lead(target, horizon - 1)
    return Stages([{"seq": seq, "label": lbl}])


def complete_sequences(df, length: int):
    return df.filter(F.size("seq") == length)


def sma_adaptive(sw: SeriesWindow, col: str = "price", cap: int = 50) -> Stages:
    """sma_50 over min(50, n // 3) rows when that is >= 20 (per series; a frame width must
    be literal, so the last ``cap`` values are collected and the tail of length k averaged)."""
    n = sw.n_rows()
    k = F.least(F.lit(cap), F.floor(n / 3).cast("int"))
    vals = F.collect_list(F.struct(F.col(col).alias("v"))).over(sw.incl(cap))
    s0 = {"_ad_k": k, "_ad_vals": vals}
    kk = F.col("_ad_k")
    tail = F.slice(F.col("_ad_vals"), -kk, kk)
    nn = F.aggregate(tail, F.lit(0), lambda a, e: a + F.when(e["v"].isNotNull(), 1).otherwise(0))
    ss = F.aggregate(tail, F.lit(0.0), lambda a, e: a + F.coalesce(e["v"], F.lit(0.0)))
    val = F.when((kk >= 20) & (F.size(F.col("_ad_vals")) >= kk) & (nn == kk), ss / kk)
    return Stages([s0, {f"sma_{cap}": val}])


def recent_trend(sw: SeriesWindow, col: str = "price", k: int = 5) -> Stages:
    """(last - first of the last k rows) / k and the naive forecast last + trend."""
    f = sw.incl(k)
    first = F.first(col).over(f)
    t = (F.col(col) - first) / F.lit(float(k))
    return Stages([{f"trend_{k}": t, f"naive_forecast_{k}": F.col(col) + t}])
