"""pandas parity of the window operators on random series with nulls, flat runs and ties."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tsengine.frames import SeriesWindow
from tsengine.functions.ewm import ewm_mean
from tsengine.operators import features as W
from tsengine.operators.stages import Stages

SW = SeriesWindow("series", "dt")


def _frame(spark, n=300, seed=1, nulls=True):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("a", "b"):
        p = 100 + np.cumsum(rng.normal(0, 1, n))
        p[20:30] = p[20]  # flat run
        if nulls:
            p[rng.choice(n, 15, replace=False)] = np.nan
        dts = pd.date_range("2020-01-01", periods=n, freq="D")
        for d, v in zip(dts, p):
            rows.append((s, d.to_pydatetime(), None if np.isnan(v) else float(v),
                         None if np.isnan(v) else float(v) + 1.0, None if np.isnan(v) else float(v) - 1.0))
    pdf = pd.DataFrame(rows, columns=["series", "dt", "price", "high", "low"])
    df = spark.createDataFrame(pdf).withColumn("dt", F.col("dt").cast("timestamp_ntz"))
    for c in ("price", "high", "low"):  # NaN from pandas -> NULL (the library's only missing marker)
        df = df.withColumn(c, F.when(~F.isnan(c), F.col(c)))
    return df, pdf


def _cmp(spark_df, pdf, cols, fn):
    got = spark_df.orderBy("series", "dt").toPandas()
    for s, g in pdf.groupby("series"):
        exp = fn(g.reset_index(drop=True))
        sub = got[got.series == s].reset_index(drop=True)
        for c in cols:
            a, b = sub[c].astype(float).values, exp[c].astype(float).values
            bad = np.where(np.isnan(a) != np.isnan(b))[0]
            assert len(bad) == 0, (c, s, bad[:5].tolist(), a[bad[:3]].tolist(), b[bad[:3]].tolist())
            np.testing.assert_allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True, err_msg=c)


def test_rolling_strict_and_past(spark):
    df, pdf = _frame(spark)
    out = (W.rolling_stats(SW, "price", (5, 20)) + W.past_rolling(SW, "price", (7, 10))).apply(df)

    def exp(g):
        p = g.price
        r = {}
        for k in (5, 20):
            ro = p.rolling(k)
            r.update({f"price_rolling_mean_{k}": ro.mean(), f"price_rolling_std_{k}": ro.std(),
                      f"price_rolling_median_{k}": ro.median(), f"price_rolling_q25_{k}": ro.quantile(0.25)})
        s1 = p.shift(1)
        for k in (7, 10):
            ro = s1.rolling(k, min_periods=max(1, k // 2))
            r.update({f"price_sma_{k}": ro.mean(), f"price_std_{k}": ro.std(), f"price_median_{k}": ro.median()})
        return pd.DataFrame(r)
    _cmp(out, pdf, ["price_rolling_mean_5", "price_rolling_std_20", "price_rolling_median_5",
                    "price_rolling_q25_20", "price_sma_7", "price_std_10", "price_median_10"], exp)


def test_ewm_matches_pandas(spark):
    df, pdf = _frame(spark, n=600)
    out = df.withColumn("e12", ewm_mean("price", SW, span=12)).withColumn("e26", ewm_mean("price", SW, span=26))
    _cmp(out, pdf, ["e12", "e26"], lambda g: pd.DataFrame({"e12": g.price.ewm(span=12, min_periods=1).mean(),
                                                         "e26": g.price.ewm(span=26, min_periods=1).mean()}))


def test_rsi_atr_past_match_pandas(spark):
    df, pdf = _frame(spark, nulls=False)
    out = (W.rsi_past(SW, "price") + W.atr(SW, "price") + W.stochastic_past(SW, "price")).apply(df)

    def exp(g):
        p1, h1, l1 = g.price.shift(1), g.high.shift(1), g.low.shift(1)
        d = p1.diff()
        gain = d.where(d > 0, 0).rolling(14, min_periods=1).mean()
        loss = (-d.where(d < 0, 0)).rolling(14, min_periods=1).mean()
        rsi = 100 - 100 / (1 + gain / (loss + 1e-8))
        tr = np.maximum(h1 - l1, np.maximum(np.abs(h1 - p1.shift(1)), np.abs(l1 - p1.shift(1))))
        ll, hh = l1.rolling(14, min_periods=1).min(), h1.rolling(14, min_periods=1).max()
        k = 100 * (p1 - ll) / (hh - ll + 1e-8)
        return pd.DataFrame({"rsi_14": rsi, "atr": tr.rolling(14, min_periods=1).mean(), "stoch_k": k,
                             "stoch_d": k.rolling(3, min_periods=1).mean()})
    _cmp(out, pdf, ["rsi_14", "atr", "stoch_k", "stoch_d"], exp)


def test_strict_rsi_flat_series(spark):
    rows = [("a", (pd.Timestamp("2020-01-01") + pd.Timedelta(days=i)).to_pydatetime(), 5.0) for i in range(20)]
    df = spark.createDataFrame(rows, "series string, dt timestamp_ntz, price double")
    out = W.rsi(SW, "price", 14).apply(df).orderBy("dt").toPandas()
    assert out.rsi.isna().all()  # 0/0 -> NULL, never NaN or an error


def test_slope_matches_polyfit(spark):
    df, pdf = _frame(spark, nulls=False)
    out = W.trend_features(SW, "price", (10,)).apply(df)

    def exp(g):
        x = np.arange(10)
        return pd.DataFrame({"price_slope_10": g.price.rolling(10).apply(lambda v: np.polyfit(x, v, 1)[0], raw=True)})
    _cmp(out, pdf, ["price_slope_10"], exp)


@pytest.mark.parametrize("k", [1, 5])
def test_pct_change(spark, k):
    df, pdf = _frame(spark, nulls=False)
    out = Stages([{"pc": W.pct_change(SW, "price", k)}]).apply(df)
    _cmp(out, pdf, ["pc"], lambda g: pd.DataFrame({"pc": g.price.pct_change(k)}))


def test_blocked_ewm_matches_pandas(spark):
    from tsengine.functions.ewm import ewm_stages
    df, pdf = _frame(spark, n=700)
    st = ewm_stages(SW, "price", "e12", span=12, block=64) + ewm_stages(SW, "price", "e26", span=26, block=64) \
        + ewm_stages(SW, "price", "e9", span=9)
    out = st.apply(df)
    _cmp(out, pdf, ["e12", "e26", "e9"], lambda g: pd.DataFrame({
        "e12": g.price.ewm(span=12, min_periods=1).mean(), "e26": g.price.ewm(span=26, min_periods=1).mean(),
        "e9": g.price.ewm(span=9, min_periods=1).mean()}))
