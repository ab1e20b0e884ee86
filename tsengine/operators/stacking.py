"""Stacking, blending, bootstrap intervals and recursive forecasts.

Meta models and blending weights are solved on m x m normal matrices (m = number of base
models) built by one aggregation; base predictions never leave the executors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.operators import linear as L
from tsengine.operators.rank import positions


def normal_matrix(df: DataFrame, cols: Sequence[str], y: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(P'P, P'y, n) of the prediction columns in ONE aggregation."""
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, a in enumerate(cols):
        aggs.append(F.sum(F.col(a) * F.col(y)).alias(f"b{i}"))
        for j in range(i, len(cols)):
            aggs.append(F.sum(F.col(a) * F.col(cols[j])).alias(f"a{i}_{j}"))
    r = df.na.drop(subset=[*cols, y]).agg(*aggs).first()
    m = len(cols)
    A = np.zeros((m, m))
    b = np.zeros(m)
    for i in range(m):
        b[i] = r[f"b{i}"] or 0.0
        for j in range(i, m):
            A[i, j] = A[j, i] = r[f"a{i}_{j}"] or 0.0
    return A, b, int(r["n"])


def nnls_normal(A: np.ndarray, b: np.ndarray, max_iter: int = 500, tol: float = 1e-12) -> np.ndarray:
    """Lawson–Hanson active set for min ||Pw - y||^2, w >= 0, given A = P'P and b = P'y."""
    m = len(b)
    w = np.zeros(m)
    passive = np.zeros(m, dtype=bool)
    for _ in range(max_iter):
        grad = b - A @ w
        cand = ~passive & (grad > tol * max(1.0, np.abs(b).max()))
        if not cand.any():
            break
        passive[np.argmax(np.where(cand, grad, -np.inf))] = True
        while True:
            idx = np.where(passive)[0]
            z = np.zeros(m)
            z[idx] = np.linalg.lstsq(A[np.ix_(idx, idx)], b[idx], rcond=None)[0]
            if (z[idx] > 0).all():
                w = z
                break
            neg = idx[z[idx] <= 0]
            alpha = np.min(w[neg] / (w[neg] - z[neg] + 1e-300))
            w = w + alpha * (z - w)
            passive &= w > tol
    return w


# fixed values: penalties of the blending methods
BLEND_ALPHA = {"linear": 0.0, "ridge": 1.0, "lasso": 0.1}


def blend_weights(wide: DataFrame, models: Sequence[str], y: str = "y", method: str = "linear",
                  alpha: float | None = None) -> dict[str, float]:
    """Non-negative weights without intercept on a hold-out, normalised to sum 1. With n rows,
    ``linear`` minimises ||Pw - y||^2, ``ridge`` that plus alpha ||w||^2, ``lasso`` its 1 / (2 n)
    part plus alpha sum(w): for w >= 0 all three are NNLS on shifted normal equations. Equal weights
    where all are 0."""
    alpha = BLEND_ALPHA[method] if alpha is None else alpha
    A, b, n = normal_matrix(wide, models, y)
    if method == "ridge":
        A = A + alpha * np.eye(len(models))
    elif method == "lasso":
        b = b - n * alpha
    w = nnls_normal(A, b)
    s = w.sum()
    w = w / s if s > 0 else np.full(len(models), 1.0 / len(models))
    return dict(zip(models, w.tolist()))


def apply_weights(wide: DataFrame, weights: dict[str, float], out: str = "blend_pred") -> DataFrame:
    expr = None
    for m, w in weights.items():
        term = F.lit(w) * F.col(m)
        expr = term if expr is None else expr + term
    return wide.withColumn(out, expr)


def kfold_oof_linear(df: DataFrame, features: Sequence[str], target: str, fold_col: str,
                     models: dict[str, tuple[str, dict]]) -> DataFrame:
    """Plain k-fold out-of-fold predictions; training Gram of fold f = total - G_f
    (exact, one pass)."""
    means = L.column_means(df, [*features, target])
    blocks = L.gram_blocks(df, features, target, [fold_col], means)
    total = None
    for g in blocks.values():
        total = g if total is None else total + g
    shift = np.array([means[c] for c in features])
    fits = {}
    for (f,), g in blocks.items():
        for name, (s, p) in models.items():
            fits[(f, name)] = L.SOLVERS[s](total - g, p).shifted(shift, means[target])
    coefs = L.coefficient_table(df.sparkSession, fits, [fold_col, "model"], features)
    return L.score(df, coefs, [fold_col], features, "pred")


def stack_meta(wide_oof: DataFrame, models: Sequence[str], y: str, alpha: float = 1.0,
               fill_zero: bool = True) -> L.LinearFit:
    """E03/E05 meta learner: ridge on the (out-of-fold) base predictions; a row a base model
    never validated contributes 0 (E05)."""
    w = wide_oof.select(*[F.coalesce(F.col(m), F.lit(0.0)).alias(m) if fill_zero else F.col(m) for m in models], y)
    blocks = L.gram_blocks(w.withColumn("_all", F.lit(0)), list(models), y, ["_all"])
    return L.solve_ridge(blocks[(0,)], alpha)


def apply_meta(wide: DataFrame, fit: L.LinearFit, models: Sequence[str], out: str = "stack_pred") -> DataFrame:
    expr = F.lit(fit.intercept)
    for m, c in zip(models, fit.coef):
        expr = expr + F.lit(float(c)) * F.coalesce(F.col(m), F.lit(0.0))
    return wide.withColumn(out, expr)


def temporal_stack(wide: DataFrame, models: Sequence[str], features: Sequence[str], meta_rows: Column,
                   y: str = "y", alpha: float = 1.0, out: str = "stack_pred") -> DataFrame:
    """Ridge meta learner on the base predictions and the features standardised on the meta rows
    (mean, population deviation; a constant one is only centred), fitted on ``meta_rows`` alone and
    applied to the rest. A missing feature counts as its mean, a missing prediction as 0."""
    stats = wide.where(meta_rows).agg(*[f(c).alias(f"{f.__name__}_{c}") for c in features for f in (F.avg, F.stddev_pop)]).first()
    scaled = wide.select("*", *[((F.col(c) - F.lit(stats[f"avg_{c}"])) / F.lit(stats[f"stddev_pop_{c}"] or 1.0)).alias(f"_z_{c}")
                                for c in features])
    inputs = [*models, *[f"_z_{c}" for c in features]]
    fit = stack_meta(scaled.where(meta_rows), inputs, y, alpha)
    return apply_meta(scaled.where(~meta_rows), fit, inputs, out).select(*wide.columns, out)


RANKS = 1024  # residuals of a group that a draw chooses from; a group with fewer is drawn from whole


def residual_ranks(residuals: DataFrame, group: Sequence[str], resid: str = "resid", ranks: int = RANKS) -> DataFrame:
    """group and ``_resid``: all residuals of a group in ascending order, or ``ranks`` of them at even steps of
    rank, the least and the largest included."""
    placed = positions(residuals.where(F.col(resid).isNotNull()).select(*group, F.col(resid).cast("double").alias("_v")), group, ["_v"])
    n, last = F.col("_total"), F.lit(ranks - 1)
    # rank p is the i-th step where floor(i (n - 1) / (ranks - 1)) = p for some i
    step = F.ceil(F.col("_pos") * last / (n - 1))
    kept = placed.where((n <= ranks) | (F.floor(step * (n - 1) / last) == F.col("_pos")))
    return kept.groupBy(*group).agg(F.sort_array(F.collect_list("_v")).alias("_resid"))


def bootstrap_interval(preds: DataFrame, residuals: DataFrame, keys: Sequence[str], group: Sequence[str],
                       B: int = 100, level: float = 0.95, seed: int = 42, pred: str = "pred",
                       resid: str = "resid") -> DataFrame:
    """E11 (re-aimed): residual bootstrap. Every prediction row draws B residuals of its group by hashes of (seed, b,
    row key) from the group's table of ranks, inside the row; interval = percentiles of pred + residual (linear
    interpolation). Rows are neither multiplied nor shuffled beyond the join with one row a group."""
    p = preds.join(residual_ranks(residuals, group, resid), list(group))
    drawn = F.transform(F.sequence(F.lit(1), F.lit(B)), lambda b: F.get("_resid", F.pmod(
        F.xxhash64(F.lit(seed), b, *[F.col(k) for k in keys]), F.size("_resid").cast("long")).cast("int")))
    rows = p.select(*keys, F.col(pred), F.sort_array(F.transform(drawn, lambda r: F.col(pred) + r)).alias("_d"))

    def quantile(q: float) -> Column:
        at = (B - 1) * q
        lo, hi = F.get("_d", F.lit(int(at))), F.get("_d", F.lit(min(int(at) + 1, B - 1)))
        return lo + (hi - lo) * F.lit(at - int(at))

    a = (1 - level) / 2
    return rows.select(*keys, pred, quantile(a).alias("lower"), quantile(1 - a).alias("upper"))


def recursive_forecast(bars: DataFrame, keys: Sequence[str], coef: dict[str, float], intercept: float,
                       feature_fn, tail_rows: int, steps: int, time_col: str = "dt", price: str = "price") -> DataFrame:
    """Per series (``applyInPandas`` over the last ``tail_rows`` rows only — bounded by the
    largest feature window, not by the series length), repeat: features of the tail -> linear
    prediction -> append as the next day's price. Close and price move together (Q7)."""
    from pyspark.sql import Window
    w = Window.partitionBy(*keys).orderBy(F.col(time_col).desc())
    tail = bars.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= tail_rows).drop("_r")
    names = list(coef)
    beta = np.array([coef[n] for n in names])
    key_fields = [f for f in bars.schema.fields if f.name in keys]
    schema = T.StructType([*key_fields, T.StructField("step", T.IntegerType()),
                           T.StructField(time_col, T.TimestampNTZType()), T.StructField("forecast", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time_col)
        prices = pdf[price].astype(float).tolist()
        t = pd.Timestamp(pdf[time_col].iloc[-1])
        out = []
        for s in range(1, steps + 1):
            feats = feature_fn(pd.Series(prices))
            yhat = float(intercept + beta @ np.array([feats[n] for n in names]))
            prices.append(yhat)
            prices = prices[-tail_rows:]
            out.append((*[pdf[k].iloc[0] for k in keys], s, t + pd.Timedelta(days=s), yhat))
        return pd.DataFrame(out, columns=[*keys, "step", time_col, "forecast"])

    return tail.select(*keys, time_col, price).groupBy(*keys).applyInPandas(run, schema)


def quick_feature_row(p: pd.Series) -> dict[str, float]:
    """W52 features of the LAST row of a price tail (pandas helper for E12)."""
    return {"ma_5": p.iloc[-5:].mean(), "ma_10": p.iloc[-10:].mean(), "ma_20": p.iloc[-20:].mean(),
            "price_change": p.iloc[-1] / p.iloc[-2] - 1.0, "price_change_5": p.iloc[-1] / p.iloc[-6] - 1.0,
            "volatility": p.iloc[-10:].std(ddof=1), "price_lag_1": p.iloc[-2], "price_lag_2": p.iloc[-3],
            "price_lag_3": p.iloc[-4]}
