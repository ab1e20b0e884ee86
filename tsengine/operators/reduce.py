"""Dimension reduction and feature-count search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.operators import linear as L


def pca_variance(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), threshold: float = 0.95) -> DataFrame:
    """centre (Spark's PCA does not), fit with k = d, keep the fewest components whose
    cumulative explained variance exceeds ``threshold``; NULL features count as 0."""
    filled = df.na.fill(0.0, subset=list(features))
    va = VectorAssembler(inputCols=list(features), outputCol="_v").transform(filled)
    sc = StandardScaler(inputCol="_v", outputCol="_c", withMean=True, withStd=False).fit(va)
    cen = sc.transform(va)
    d = len(features)
    full = PCA(k=d, inputCol="_c", outputCol="_p").fit(cen)
    cum = np.cumsum(full.explainedVariance.toArray())
    k = int(np.searchsorted(cum, threshold, side="right") + 1)
    k = min(k, d)
    out = full.transform(cen).select(*keep, vector_to_array("_p").alias("_pa"))
    return out.select(*keep, *[F.col("_pa")[i].alias(f"pc_{i + 1}") for i in range(k)])


def _sum(gs):
    out = None
    for g in gs:
        out = g if out is None else out + g
    return out


def feature_count_search(blocks: dict[tuple, L.Gram], ranked: Sequence[int], n_blocks: int, ks: Sequence[int],
                         solver: str = "ridge", params: dict | None = None) -> list[tuple[int, float]]:
    """for each k, expanding-fold CV MSE using the top-k ranked features (block Grams over
    ALL features are computed once; each k is a sub-matrix)."""
    params = params or {"alpha": 1.0}
    folds = [([(b,) for b in range(f + 1)], [(f + 1,)]) for f in range(n_blocks - 1)]
    bl = {k: v for k, v in blocks.items()}
    res = []
    for k in ks:
        res.append((k, gram_cv_mse(bl, folds, list(ranked[:k]), solver, params)))
    return res


def gram_cv_mse(blocks, folds, subset, solver, params, standardize: bool = False):
    """Mean test MSE over folds for a feature subset, from block Grams only: the test SSE of
    coefficients b is [1 b -1] G_test [1 b -1]' (no scoring pass)."""
    idx = [0, *[i + 1 for i in subset]]
    trains, tests = [], []
    for train_keys, test_keys in folds:
        tr = _sum(blocks[k] for k in train_keys if k in blocks)
        te = [blocks[k] for k in test_keys if k in blocks]
        if tr is None or not te:
            continue
        sel = [*idx, tr.G.shape[0] - 1]
        trains.append(L.Gram(tr.G[np.ix_(sel, sel)]))
        tests.append(sum(t.G for t in te)[np.ix_(sel, sel)])
    mses = []
    for fit, tg in zip(L.solve_many(solver, trains, params, standardize), tests):
        w = np.concatenate([[fit.intercept], fit.coef, [-1.0]])
        mses.append(float(w @ tg @ w) / tg[0, 0])
    return float(np.mean(mses)) if mses else float("nan")


def gram_cv_mse_trials(blocks, folds, subset, solver, trials: Sequence[dict], standardize: bool = False) -> list[float]:
    """CV MSE of many parameter settings of one solver: every trial x fold problem is solved in
    ONE batch (lasso / EN coordinate descent vectorised over all of them)."""
    idx = [0, *[i + 1 for i in subset]]
    trains, tests = [], []
    for train_keys, test_keys in folds:
        tr = _sum(blocks[k] for k in train_keys if k in blocks)
        te = [blocks[k] for k in test_keys if k in blocks]
        if tr is None or not te:
            continue
        sel = [*idx, tr.G.shape[0] - 1]
        trains.append(L.Gram(tr.G[np.ix_(sel, sel)]))
        tests.append(sum(t.G for t in te)[np.ix_(sel, sel)])
    nf = len(trains)
    if nf == 0:
        return [float("nan")] * len(trials)
    grams = [g for _ in trials for g in trains]
    params = [p for p in trials for _ in trains]
    fits = L.solve_many(solver, grams, params, standardize)
    out = []
    for t in range(len(trials)):
        mses = []
        for f in range(nf):
            fit, tg = fits[t * nf + f], tests[f]
            w = np.concatenate([[fit.intercept], fit.coef, [-1.0]])
            mses.append(float(w @ tg @ w) / tg[0, 0])
        out.append(float(np.mean(mses)))
    return out
