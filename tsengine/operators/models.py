"""Model registry (M06–M13) on Spark ML, and the re-aimed models (additive forecaster, search).

Parameters that equal the reference's configuration are fixed values below.
"""

from __future__ import annotations

import importlib
import random
from collections.abc import Sequence

import numpy as np
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.operators import linear as L
from tsengine.operators.artefact import LinearEstimator
from tsengine.session import cut_lineage

# fixed values: the reference's model configurations
RF_PARAMS = {"numTrees": 200, "maxDepth": 15, "minInstancesPerNode": 2, "featureSubsetStrategy": "sqrt", "seed": 42}
GBT_PARAMS = {"maxIter": 200, "stepSize": 0.05, "maxDepth": 8, "subsamplingRate": 0.8, "seed": 42}
BOOSTED_PRESETS = {
    "xgboost": {"maxIter": 200, "stepSize": 0.05, "maxDepth": 8, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "maxBins": 256, "seed": 42},
    # this library's public defaults: 20 rows a leaf, 255 bins; its rows are drawn only when a bagging frequency is set
    "lightgbm": {"maxIter": 200, "stepSize": 0.05, "maxDepth": 8, "featureSubsetStrategy": "0.8", "minInstancesPerNode": 20, "maxBins": 255, "seed": 42},
    "catboost": {"maxIter": 200, "stepSize": 0.05, "maxDepth": 8, "featureSubsetStrategy": "all", "maxBins": 254, "seed": 42},
}
LINEAR_MODELS = {
    "linear_regression": ("linear_regression", {}),
    "ridge": ("ridge", {"alpha": 1.0}),
    "lasso": ("lasso", {"alpha": 0.1}),
    "elastic_net": ("elastic_net", {"alpha": 0.1, "l1_ratio": 0.5}),
    "bayesian_ridge": ("bayesian_ridge", {}),
}
HUBER_EPSILON = 1.35


def huber(**kw):
    """Huber loss regression (Spark ML ``loss='huber'``)."""
    return LinearRegression(loss="huber", epsilon=HUBER_EPSILON, regParam=kw.get("regParam", 1e-4),
                            elasticNetParam=0.0, maxIter=kw.get("maxIter", 100))


def random_forest(**kw):
    """M07."""
    return RandomForestRegressor(**{**RF_PARAMS, **kw})


def gradient_boosting(**kw):
    """M08."""
    return GBTRegressor(**{**GBT_PARAMS, **kw})


def boosted_preset(name: str, **kw):
    """M09 (re-aimed): the three further boosters as GBT parameter presets."""
    return GBTRegressor(**{**BOOSTED_PRESETS[name], **kw})


REGISTRY = {
    "huber": huber,
    "random_forest": random_forest,
    "gradient_boosting": gradient_boosting,
    **{k: (lambda k=k, **kw: boosted_preset(k, **kw)) for k in BOOSTED_PRESETS},
}


def _linear(name: str, **kw):
    solver, params = LINEAR_MODELS[name]
    p = {**params, **kw}
    renamed = {"l1_ratio": "l1Ratio"}
    return LinearEstimator(solver=solver, **{renamed.get(k, k): v for k, v in p.items()})


def estimator(name: str, **kw):
    """Name -> estimator with the registry's parameters, ``kw`` on top of them. The linear family are
    :class:`~tsengine.operators.artefact.LinearEstimator`, the rest Spark ML's."""
    return _linear(name, **kw) if name in LINEAR_MODELS else REGISTRY[name](**kw)


def save_models(models: dict, metrics: DataFrame, path: str, metric: str = "r2", model: str = "model") -> None:
    """Every fitted model under its name, and the pointer to the best: of ``metrics`` (a row a model), the largest
    ``metric``, of equals the last by name."""
    for name, fitted in models.items():
        fitted.write().overwrite().save(f"{path}/models/{name}")
    best = metrics.where(F.col(metric).isNotNull()).orderBy(F.col(metric).desc(), F.col(model).desc()).limit(1)
    kinds = {name: f"{type(m).__module__}.{type(m).__qualname__}" for name, m in models.items()}
    kind = F.coalesce(*[F.when(F.col(model) == n, F.lit(k)) for n, k in kinds.items()])
    best.select(F.col(model).alias("model"), kind.alias("kind"), F.lit(metric).alias("metric"), F.col(metric).cast("double").alias("value")).write.mode("overwrite").json(f"{path}/best")


def load_best(spark, path: str):
    """(name, model) that the pointer of :func:`save_models` names."""
    row = spark.read.schema("model string, kind string, metric string, value double").json(f"{path}/best").first()
    module, kind = row["kind"].rsplit(".", 1)
    return row["model"], getattr(importlib.import_module(module), kind).load(f"{path}/models/{row['model']}")


def spark_ridge(alpha: float, n: int, y_std_pop: float):
    """M02 on Spark ML: sklearn's Ridge(alpha) equals LinearRegression with
    regParam = alpha / (n * std_pop(y)), no standardization, normal solver."""
    return LinearRegression(regParam=alpha / (n * y_std_pop), elasticNetParam=0.0, standardization=False,
                            solver="normal")


def spark_lasso(alpha: float):
    """M03 on Spark ML: sklearn's Lasso(alpha) equals regParam = alpha, elasticNetParam = 1."""
    return LinearRegression(regParam=alpha, elasticNetParam=1.0, standardization=False, maxIter=1000, tol=1e-10)


# ---- M12 parameter search (re-aimed: seeded random search, linear trials from one Gram pass) -------
def linear_search_trials(n_trials: int = 15, seed: int = 42) -> list[tuple[str, str, dict]]:
    """Seeded log-uniform alphas for ridge / lasso / elastic net (l1 ratio uniform)."""
    rnd = random.Random(seed)
    out = []
    for i in range(n_trials):
        out.append((f"ridge_{i}", "ridge", {"alpha": 10 ** rnd.uniform(-3, 3)}))
        out.append((f"lasso_{i}", "lasso", {"alpha": 10 ** rnd.uniform(-3, 1)}))
        out.append((f"elastic_net_{i}", "elastic_net", {"alpha": 10 ** rnd.uniform(-3, 1), "l1_ratio": rnd.uniform(0.1, 0.9)}))
    return out


# ---- M10 additive forecaster (re-aimed) ----------------------------------------------------------
def additive_design(df: DataFrame, time_col: str = "dt", n_changepoints: int = 10, yearly: int = 10,
                    weekly: int = 3, t0=None, t1=None) -> tuple[DataFrame, list[str]]:
    """Piecewise-linear trend (hinges at evenly spaced changepoints over the first 80 % of the
    time range) + yearly / weekly Fourier terms as columns. ``t0``/``t1`` is the training range
    in days since epoch (computed by the caller with one aggregate)."""
    days = F.datediff(F.col(time_col), F.lit("1970-01-01").cast("date")).cast("double")
    span = max(t1 - t0, 1.0)
    t = (days - F.lit(t0)) / F.lit(span)
    cols = {"t": t}
    for i in range(n_changepoints):
        s = 0.8 * (i + 1) / (n_changepoints + 1)
        cols[f"cp_{i}"] = F.greatest(t - F.lit(s), F.lit(0.0))
    for k in range(1, yearly + 1):
        cols[f"ys_{k}"] = F.sin(F.lit(2 * np.pi * k / 365.25) * days)
        cols[f"yc_{k}"] = F.cos(F.lit(2 * np.pi * k / 365.25) * days)
    for k in range(1, weekly + 1):
        cols[f"ws_{k}"] = F.sin(F.lit(2 * np.pi * k / 7.0) * days)
        cols[f"wc_{k}"] = F.cos(F.lit(2 * np.pi * k / 7.0) * days)
    return df.select("*", *[v.alias(k) for k, v in cols.items()]), list(cols)


def additive_forecast(df: DataFrame, keys: Sequence[str], time_col: str = "dt", y: str = "price",
                      horizon: int = 30, alpha: float = 1.0, level: float = 0.8) -> DataFrame:
    """Fit trend + seasonality by ridge per series (one Gram pass), forecast ``horizon``
    days after the last date with a +- z residual-std band. Returns (keys, dt, yhat, lower, upper)."""
    from statistics import NormalDist
    rng = df.agg(F.min(time_col).alias("a"), F.max(time_col).alias("b")).first()
    epoch = np.datetime64("1970-01-01")
    t0 = float((np.datetime64(rng["a"]) - epoch) / np.timedelta64(1, "D"))
    t1 = float((np.datetime64(rng["b"]) - epoch) / np.timedelta64(1, "D"))
    X, feats = additive_design(df, time_col, t0=t0, t1=t1)
    zero = dict.fromkeys([*feats, y], 0.0)
    coefs = cut_lineage(L.group_fits(L.gram_table(X, feats, y, list(keys)), keys, {"trend": ("ridge", {"alpha": alpha})}, feats, y, zero)
                        .select(*keys, "intercept", "coef"))
    e = F.col(y) - F.col("yhat")
    sd = L.score(X, coefs, list(keys), feats, "yhat").groupBy(*keys).agg(
        F.sqrt(F.sum(e * e) / F.greatest(F.count(e) - 1, F.lit(1))).alias("resid_std"))
    last = df.groupBy(*keys).agg(F.max(time_col).alias("_last"))
    fut = last.select(*keys, F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"), "_last") \
        .select(*keys, (F.col("_last") + F.make_interval(days=F.col("step"))).alias(time_col))
    Xf, _ = additive_design(fut, time_col, t0=t0, t1=t1)
    pred = L.score(Xf, coefs, list(keys), feats, "yhat").join(sd, list(keys))
    z = NormalDist().inv_cdf(0.5 + level / 2.0)
    return pred.select(*keys, time_col, "yhat", (F.col("yhat") - z * F.col("resid_std")).alias("lower"),
                       (F.col("yhat") + z * F.col("resid_std")).alias("upper"))
