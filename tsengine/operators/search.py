"""Parameter search for trees and boosters (M12) by successive halving over temporal folds.

Trials are drawn by seed from ranges. A rung is one more fold of the expanding cross-validation (H04), the
small ones first: all trials left are fitted on it side by side, and only the best share of them, by mean error so
far, sees the next. What a stopped trial reached stays in the result.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame

from tsengine.frames import SeriesWindow
from tsengine.operators import fits
from tsengine.operators import models as MD
from tsengine.operators import validate as V

# fixed values: the reference's search ranges, under the names that Spark ML has for them
RANGES = {
    "random_forest": {"numTrees": (50, 300), "maxDepth": (3, 20), "minInstancesPerNode": (1, 10), "featureSubsetStrategy": ["sqrt", "log2", "all"], "bootstrap": [True, False]},
    "gradient_boosting": {"maxIter": (50, 300), "maxDepth": (3, 10), "stepSize": (0.01, 0.3), "subsamplingRate": (0.6, 1.0), "minInstancesPerNode": (1, 10),
                          "featureSubsetStrategy": ["sqrt", "log2", "all"]},
    "xgboost": {"maxIter": (50, 300), "maxDepth": (3, 12), "stepSize": (0.01, 0.3), "subsamplingRate": (0.6, 1.0), "minInstancesPerNode": (1, 10)},
    "lightgbm": {"maxIter": (50, 300), "maxDepth": (3, 12), "stepSize": (0.01, 0.3), "subsamplingRate": (0.6, 1.0), "minInstancesPerNode": (5, 50)},
}
RESULT = "trial string, kind string, params string, rung long, status string, best boolean, mse double, r2 double, error string"


def draw(kind: str, n: int, seed: int = 42, ranges: dict | None = None) -> dict[str, tuple[str, dict]]:
    """``n`` trials of a kind: name -> (kind, parameters). A pair of numbers is a range, a list a choice."""
    rnd = random.Random(f"{kind}-{seed}")
    out = {}
    for i in range(n):
        params = {}
        for name, r in (RANGES[kind] if ranges is None else ranges).items():
            params[name] = rnd.choice(r) if isinstance(r, list) else rnd.randint(*r) if isinstance(r[0], int) else round(rnd.uniform(*r), 4)
        out[f"{kind}_{i}"] = (kind, params)
    return out


def successive_halving(df: DataFrame, sw: SeriesWindow, features: Sequence[str], target: str, trials: dict[str, tuple[str, dict]],
                       k: int = 5, eta: float = 3.0, parallel: int = fits.PARALLEL) -> DataFrame:
    """One row a trial: kind, params (JSON), rung (folds it was scored on), status (``finished`` on all folds,
    ``stopped`` before, ``failed``), mean mse and r2 over its folds; ``best`` marks the finished trial of least
    mse. After each fold the best 1 / ``eta`` of the trials go on, one at least."""
    spark = df.sparkSession
    data, folds, _ = V.cv_table(df, sw, features, target, k)
    scores: dict[str, list[tuple]] = {t: [] for t in trials}
    errors: dict[str, str] = {}

    def run(trial: str, fold: int):
        kind, params = trials[trial]
        estimator = MD.estimator(kind, **params)
        try:
            return V.fold_score(data, estimator, fold)
        except fits.FIT_ERRORS as e:
            return str(getattr(e, "java_exception", e)).splitlines()[0]

    def mean(trial: str, at: int) -> float:
        return sum(s[at] for s in scores[trial]) / len(scores[trial])

    left = list(trials)
    for i, fold in enumerate(folds):
        for t, got in fits.together(spark, {t: (lambda t=t, fold=fold: run(t, fold)) for t in left}, parallel).items():
            if isinstance(got, str):
                errors[t] = got
            else:
                scores[t].append(got)
        left = sorted((t for t in left if t not in errors), key=lambda t: (mean(t, 1), t))
        if i + 1 < len(folds):
            left = left[:max(1, math.ceil(len(left) / eta))]
    rows = []
    for t, (kind, params) in trials.items():
        s = scores[t]
        status = "failed" if t in errors else "finished" if len(s) == len(folds) and s else "stopped"
        rows.append((t, kind, json.dumps(params, sort_keys=True), len(s), status, bool(left) and t == left[0] and status == "finished",
                     mean(t, 1) if s else None, mean(t, 3) if s else None, errors.get(t)))
    return spark.createDataFrame(rows, RESULT)
