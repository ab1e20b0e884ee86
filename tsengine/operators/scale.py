"""Scaling fitted on training rows only (F03–F06). ``fit_*`` returns a statistics table (one row
per group, or one row), ``apply_*`` joins it back on the group key — bounded by the number of
groups — and evaluates the affine map as plain column arithmetic."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.functions.core import safe_div
from tsengine.operators.rank import exact_quantiles


def _fit(df: DataFrame, by: Sequence[str], aggs: dict) -> DataFrame:
    cols = [v.alias(k) for k, v in aggs.items()]
    return df.groupBy(*by).agg(*cols) if by else df.agg(*cols)


def _join(df: DataFrame, stats: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.join(stats, list(by), "left") if by else df.crossJoin(F.broadcast(stats))  # one row


def fit_standard(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """F03 fit: mean and population std (ddof 0, as the reference's scaler)."""
    aggs = {}
    for c in cols:
        aggs[f"_mu_{c}"] = F.avg(c)
        aggs[f"_sd_{c}"] = F.stddev_pop(c)
    return _fit(df, by, aggs)


def apply_standard(df: DataFrame, stats: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """F03 transform: (x - mean) / std; a constant column (std 0) maps to 0."""
    j = _join(df, stats, by)
    out = [F.when(F.col(f"_sd_{c}") == 0, F.lit(0.0)).otherwise(
        (F.col(c) - F.col(f"_mu_{c}")) / F.col(f"_sd_{c}")).alias(c) if c in cols else F.col(c) for c in df.columns]
    return j.select(*out)


def inverse_standard(df: DataFrame, stats: DataFrame, cols: Sequence[str], by: Sequence[str] = (),
                     suffix: str = "") -> DataFrame:
    """x std + mean (e.g. a scaled target back to prices)."""
    j = _join(df, stats, by)
    return j.select(*df.columns, *[(F.col(c) * F.col(f"_sd_{c}") + F.col(f"_mu_{c}")).alias(c + suffix)
                                   for c in cols])


def fit_minmax(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    aggs = {}
    for c in cols:
        aggs[f"_lo_{c}"] = F.min(c)
        aggs[f"_hi_{c}"] = F.max(c)
    return _fit(df, by, aggs)


def apply_minmax(df: DataFrame, stats: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(x - min) / (max - min) into [0, 1]; a constant column maps to 0."""
    j = _join(df, stats, by)
    out = [F.coalesce(safe_div(F.col(c) - F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")),
                      F.when(F.col(c).isNotNull(), F.lit(0.0))).alias(c) if c in cols else F.col(c)
           for c in df.columns]
    return j.select(*out)


def fit_robust(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """F05 fit: exact quartiles and median (linear interpolation, as numpy)."""
    return exact_quantiles(df, by, cols, [0.25, 0.5, 0.75])


def apply_robust(df: DataFrame, stats: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(x - median) / (q75 - q25); IQR 0 maps to x - median (scale 1, as the reference)."""
    j = _join(df, stats, by)

    def tr(c):
        q = F.col(f"_q_{c}")
        iqr = q[2] - q[0]
        return F.when(iqr == 0, F.col(c) - q[1]).otherwise((F.col(c) - q[1]) / iqr).alias(c)
    return j.select(*[tr(c) if c in cols else F.col(c) for c in df.columns])
