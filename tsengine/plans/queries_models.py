"""Registered model queries: Gram-based linear family (M01–M05, H10, M12, F11), Spark ML models
(M06–M09, A19–A20), stacking / blending / bootstrap / recursive forecasts (E03–E06, E11, E12),
additive forecaster (M10), PCA (F10). Only M01 (d = 1) has a SQL oracle; the rest are checked
by row counts and by numpy property tests in ``tests/``."""

from __future__ import annotations

import uuid
from statistics import NormalDist

import numpy as np
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsengine.frames import SeriesWindow
from tsengine.operators import fits
from tsengine.operators import linear as L
from tsengine.operators import metrics as M
from tsengine.operators import models as MD
from tsengine.operators import recursion as RC
from tsengine.operators import reduce as R
from tsengine.operators import search as SR
from tsengine.operators import select as SEL
from tsengine.operators import stacking as ST
from tsengine.operators import validate as V
from tsengine.operators.joins import collect_model_predictions
from tsengine.plans import bundles, fixtures
from tsengine.plans.oracle import BARS
from tsengine.plans.registry import register
from tsengine.plans.sql_features import quick_features_sql
from tsengine.session import cut_lineage, ensure_checkpoint_dir

SW = SeriesWindow("series", "dt")
QF = ["ma_5", "ma_10", "ma_20", "price_change", "price_change_5", "volatility", "price_lag_1", "price_lag_2", "price_lag_3"]


def _quick(spark, d):
    return bundles.quick_features(fixtures.bars(spark, d), SW)


def _past(spark, d):
    return bundles.engineer_past(fixtures.bars(spark, d), SW)


M01_SQL = f"""WITH q0 AS ({quick_features_sql()}),
 q AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY dt) - 1 AS row_idx, count(*) OVER (PARTITION BY series) AS n FROM q0),
 folds AS (SELECT series, fold, 252 + fold * 21 AS cut, least(252 + fold * 21 + 21, n - 1) AS test_to FROM
   (SELECT series, n, unnest(range(0, CASE WHEN n - 1 > 252 THEN (n - 1 - 252 - 1) // 21 + 1 ELSE 0 END)) AS fold FROM (SELECT DISTINCT series, n FROM q))),
 fits AS (SELECT f.series, f.fold, regr_slope(q.target, q.price_lag_1) AS b, regr_intercept(q.target, q.price_lag_1) AS a
   FROM folds f JOIN q ON q.series = f.series AND q.row_idx < f.cut GROUP BY f.series, f.fold)
SELECT q.series, q.dt, q.row_idx::BIGINT AS row_idx, f.fold::BIGINT AS fold, 'ols' AS model, q.target AS y, fits.a + fits.b * q.price_lag_1 AS pred
FROM q JOIN folds f ON q.series = f.series AND q.row_idx >= f.cut AND q.row_idx < f.test_to
JOIN fits ON fits.series = f.series AND fits.fold = f.fold"""


@register("m01_ols_walk_forward_d1", M01_SQL, exact=["series", "dt", "row_idx", "fold", "model"], ts=["dt"])
def q_ols(spark, d):
    """Gram-blocked expanding walk-forward OLS on one feature == per-fold regr_slope/intercept."""
    return V.walk_forward_linear(_quick(spark, d), SW, ["price_lag_1"], "target", {"ols": ("linear_regression", {})}).drop("error", "converged")


D2_SQL = M01_SQL[:M01_SQL.index(" fits AS")] + """ s AS (SELECT f.series, f.fold, count(*) AS m, avg(price_lag_1) AS mu, avg(ma_5) AS mv, avg(target) AS my,
   var_pop(price_lag_1) * count(*) AS uu, var_pop(ma_5) * count(*) AS vv, covar_pop(price_lag_1, ma_5) * count(*) AS uv,
   covar_pop(price_lag_1, target) * count(*) AS uy, covar_pop(ma_5, target) * count(*) AS vy
   FROM folds f JOIN q ON q.series = f.series AND q.row_idx < f.cut GROUP BY f.series, f.fold),
 r AS (SELECT series, fold, mu, mv, my, model, uu + alpha AS uu, vv + alpha AS vv, uv, uy, vy FROM s, (VALUES ('ols', 0.0::DOUBLE), ('ridge', 1e9::DOUBLE)) AS p(model, alpha)),
 fits AS (SELECT *, (vv * uy - uv * vy) / (uu * vv - uv * uv) AS b, (uu * vy - uv * uy) / (uu * vv - uv * uv) AS c FROM r)
SELECT q.series, q.dt, q.row_idx::BIGINT AS row_idx, f.fold::BIGINT AS fold, model, q.target AS y,
 my + b * (q.price_lag_1 - mu) + c * (q.ma_5 - mv) AS pred, NULL::VARCHAR AS error, TRUE AS converged
FROM q JOIN folds f ON q.series = f.series AND q.row_idx >= f.cut AND q.row_idx < f.test_to JOIN fits ON fits.series = f.series AND fits.fold = f.fold"""


@register("m01_m02_walk_forward_d2", D2_SQL, exact=["series", "dt", "row_idx", "fold", "model", "error", "converged"], ts=["dt"])
def q_two_features(spark, d):
    """Expanding walk-forward least squares and ridge on two features, solved per series and fold in tasks."""
    return V.walk_forward_linear(_quick(spark, d), SW, ["price_lag_1", "ma_5"], "target", {"ols": ("linear_regression", {}), "ridge": ("ridge", {"alpha": 1e9})})


@register("h10_walk_forward_linear_family")
def q_wf_family(spark, d):
    """H10 + M01–M05: all five linear models on the leak-free feature table, expanding
    walk-forward (252 / 21), fold metrics per (series, model, fold)."""
    past = _past(spark, d)
    feats = [c for c in past.columns if c not in ("series", "dt", "target")]
    preds = V.walk_forward_linear(past, SW, feats, "target", MD.LINEAR_MODELS)
    return M.regression_metrics(preds, ["series", "model", "fold"])


# fixed values: tree models of the reference's walk-forward analysis
WALK_TREES = {
    "random_forest": lambda: MD.random_forest(numTrees=100, maxDepth=10, minInstancesPerNode=1, featureSubsetStrategy="all"),
    "gradient_boosting": lambda: MD.gradient_boosting(maxIter=100, maxDepth=6, stepSize=0.1, subsamplingRate=1.0),
}
WALK_STEP = 126  # half a year of trading days between two fits
_walks: dict[tuple[str, str], tuple[DataFrame, DataFrame]] = {}


def _walk_trees(spark, d):
    """(feature table, predictions of all folds of both tree models); the two queries on them share the fits of a
    session. The feature table, a row a series and day, is written once: the input is read for it alone."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _walks:
        path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/walks/{uuid.uuid4().hex}"
        quick = cut_lineage(_quick(spark, d))
        _walks[key] = quick, V.walk_forward_trees(quick, SW, QF, "target", WALK_TREES, path, step=WALK_STEP)
    return _walks[key]


@register("h10b_walk_forward_trees")
def q_wf_trees(spark, d):
    """H10 for trees: metrics of every (series, model, fold) and, with a null fold, over all folds."""
    return V.evaluation(_walk_trees(spark, d)[1], ["series"])


H10C_SQL = f"""WITH q0 AS ({quick_features_sql()}),
 q AS (SELECT series, dt, target AS y, row_number() OVER (PARTITION BY series ORDER BY dt) - 1 AS row_idx, count(*) OVER (PARTITION BY series) AS n FROM q0)
SELECT series, dt, row_idx::BIGINT AS row_idx, ((row_idx - 252) // {WALK_STEP})::BIGINT AS fold, model, y, TRUE AS fitted,
 TRUE AS in_range
FROM q, (SELECT unnest(['random_forest', 'gradient_boosting']) AS model) WHERE row_idx >= 252 AND row_idx < n - 1 AND y IS NOT NULL"""


@register("h10c_walk_forward_tree_rows", H10C_SQL, exact=["series", "dt", "row_idx", "fold", "model", "fitted", "in_range"], ts=["dt"])
def q_wf_tree_rows(spark, d):
    """Invariants of the walk-forward predictions: every row after the first year is predicted once by each
    model, in its fold, and a forest's value lies within the targets of its training rows (blocks up to the fold;
    a booster's need not, and counts as within)."""
    quick, preds = _walk_trees(spark, d)
    blocks = V.with_walk_forward_blocks(quick, SW, 252, WALK_STEP).groupBy("_blk").agg(F.min("target").alias("lo"), F.max("target").alias("hi"))
    upto = Window.orderBy("_blk").rowsBetween(Window.unboundedPreceding, 0)  # one row a block
    seen = blocks.select(F.col("_blk").cast("long").alias("fold"), F.min("lo").over(upto).alias("lo"), F.max("hi").over(upto).alias("hi"))
    return preds.join(seen, "fold").select(
        "series", "dt", "row_idx", "fold", "model", "y", F.col("pred").isNotNull().alias("fitted"),
        ((F.col("model") != "random_forest") | F.col("pred").between(F.col("lo"), F.col("hi"))).alias("in_range"))


H04_SQL = f"""WITH q0 AS ({quick_features_sql()}),
 n AS (SELECT series, dt, target AS y, price_lag_1 AS x, row_number() OVER (PARTITION BY series ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM q0),
 b AS (SELECT *, CASE WHEN i < n - 5 * (n // 6) THEN 0 ELSE (i - (n - 5 * (n // 6))) // (n // 6) + 1 END AS blk FROM n),
 f AS (SELECT unnest(range(5)) AS fold),
 fits AS (SELECT fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, count(*) AS n_train FROM f JOIN b ON blk <= fold GROUP BY fold),
 e AS (SELECT fold, n_train, count(*) AS n, avg((y - a - b * x) * (y - a - b * x)) AS mse, avg(abs(y - a - b * x)) AS mae,
   1 - avg((y - a - b * x) * (y - a - b * x)) / var_pop(y) AS r2, sqrt(avg((y - a - b * x) * (y - a - b * x))) AS rmse
   FROM fits JOIN b ON blk = fold + 1 GROUP BY fold, n_train)
SELECT 'line' AS model, fold::BIGINT AS fold, n_train::BIGINT AS n_train, n::BIGINT AS n, mse, mae, r2, rmse FROM e
UNION ALL SELECT 'line', NULL, sum(n_train)::BIGINT, sum(n)::BIGINT, avg(mse), avg(mae), avg(r2), avg(rmse) FROM e"""


@register("h04_temporal_cv", H04_SQL, exact=["model", "fold", "n_train", "n"])
def q_temporal_cv(spark, d):
    """Five expanding folds with a scaler fitted on each; on one feature, least squares by SQL."""
    return V.temporal_cv(_quick(spark, d), SW, ["price_lag_1"], "target", {"line": lambda: LinearRegression(regParam=0.0, solver="normal")}, 5)


@register("m02_m05_holdout_linear")
def q_holdout_linear(spark, d):
    """M01–M05 on an 80/20 temporal hold-out of every series (pooled Gram), hold-out metrics."""
    preds, _ = V.holdout_linear(_past(spark, d).drop("day_of_week"), SW,
                                [c for c in _past(spark, d).columns if c not in ("series", "dt", "target", "day_of_week")],
                                "target", MD.LINEAR_MODELS)
    return M.regression_metrics(preds, ["model"])


def _holdout_ml(spark, d, estimators):
    """(predictions, models) of Spark ML estimators on an 80/20 hold-out of every series, fitted side by side."""
    q = _quick(spark, d).select("*", SW.row_idx().alias("row_idx"), SW.n_rows().alias("_n"))
    q = q.withColumn("is_train", F.col("row_idx") < F.floor(F.col("_n") * 0.8))
    data = fits.fit_table(q, QF, "target", ["series", "dt", "is_train"])
    models = fits.fit_all(data.where("is_train"), estimators)
    out = None
    for name, model in models.items():
        p = model.transform(data.where("NOT is_train")).select("series", "dt", F.lit(name).alias("model"), "y", "pred")
        out = p if out is None else out.unionByName(p)
    return out, models


@register("m06_huber")
def q_huber(spark, d):
    p, _ = _holdout_ml(spark, d, {"huber": MD.huber()})
    return M.regression_metrics(p, ["model"])


@register("m07_random_forest")
def q_rf(spark, d):
    p, _ = _holdout_ml(spark, d, {"random_forest": MD.random_forest()})
    return M.regression_metrics(p, ["model"])


@register("m08_gradient_boosting")
def q_gbt(spark, d):
    p, _ = _holdout_ml(spark, d, {"gradient_boosting": MD.gradient_boosting()})
    return M.regression_metrics(p, ["model"])


@register("m09_boosted_presets")
def q_presets(spark, d):
    """The three booster presets on the hold-out, with their full number of rounds."""
    p, _ = _holdout_ml(spark, d, {name: MD.boosted_preset(name) for name in MD.BOOSTED_PRESETS})
    return M.regression_metrics(p, ["model"])


@register("a20_model_importance")
def q_importance(spark, d):
    """Impurity importances of the forest in full, sorted."""
    _, models = _holdout_ml(spark, d, {"random_forest": MD.random_forest()})
    imp = models["random_forest"].featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(QF, imp)], "feature string, score double") \
        .orderBy(F.col("score").desc())


@register("a19_mean_importance")
def q_mean_importance(spark, d):
    """|coefficient| of the linear models + forest importances, averaged per feature
    (mean, std ddof 0, count), top 20."""
    q = _quick(spark, d)
    _, linear = V.holdout_linear(q, SW, QF, "target", MD.LINEAR_MODELS)
    rows = [(name[0], f, float(abs(b))) for name, fit in linear.items() for f, b in zip(QF, fit.coef)]
    _, models = _holdout_ml(spark, d, {"random_forest": MD.random_forest()})
    rows += [("random_forest", f, float(v)) for f, v in zip(QF, models["random_forest"].featureImportances.toArray())]
    scores = spark.createDataFrame(rows, "model string, feature string, score double")
    return M.mean_importance(scores)


@register("m12_param_search")
def q_search(spark, d):
    """M12 (re-aimed): seeded random search (15 trials per solver) over ridge/lasso/EN alphas,
    scored by 3-fold expanding temporal CV (H03) with a scaler fit on each fold's training rows
    (H04). Every trial's CV MSE comes from the same per-block Grams — one data pass for all."""
    past = _past(spark, d)
    feats = [c for c in past.columns if c not in ("series", "dt", "target")]
    idx = past.select("*", SW.row_idx().alias("row_idx"), SW.n_rows().alias("_n"))
    ts = F.floor(F.col("_n") / 4)
    start = F.col("_n") - 3 * ts
    blk = F.when(F.col("row_idx") < start, 0).otherwise(F.least(F.floor((F.col("row_idx") - start) / ts) + 1, F.lit(3)))
    b = idx.withColumn("_blk", blk.cast("int"))
    means = L.column_means(b, [*feats, "target"])
    blocks = L.gram_blocks(b, feats, "target", ["_blk"], means)
    folds = [([(x,) for x in range(f + 1)], [(f + 1,)]) for f in range(3)]
    rows = []
    trials = MD.linear_search_trials(15, 42)
    for solver in ("ridge", "lasso", "elastic_net"):
        ts = [t for t in trials if t[1] == solver]
        cvs = R.gram_cv_mse_trials(blocks, folds, list(range(len(feats))), solver, [t[2] for t in ts], standardize=True)
        for (name, _, params), cv in zip(ts, cvs):
            rows.append((name, solver, float(params.get("alpha", 0.0)), float(params.get("l1_ratio", 1.0)), cv))
    return spark.createDataFrame(rows, "trial string, solver string, alpha double, l1_ratio double, cv_mse double")


#: The registered search draws small trees from the same kinds of ranges: the reference's own take a fit of minutes.
SMALL = {"random_forest": {"numTrees": (10, 40), "maxDepth": (3, 8), "minInstancesPerNode": (1, 10), "featureSubsetStrategy": ["sqrt", "log2", "all"]},
         "gradient_boosting": {"maxIter": (5, 20), "maxDepth": (2, 4), "stepSize": (0.01, 0.3), "subsamplingRate": (0.6, 1.0), "minInstancesPerNode": (1, 10)}}


@register("m12b_tree_search")
def q_tree_search(spark, d):
    """M12 for trees and boosters: nine trials of each kind over three expanding folds; a third of them goes on after each."""
    trials = {t: v for kind, ranges in SMALL.items() for t, v in SR.draw(kind, 9, 42, ranges).items()}
    return SR.successive_halving(_quick(spark, d), SW, QF, "target", trials, 3)


@register("f11_feature_count_search")
def q_count_search(spark, d):
    """F-regression ranking once, then CV MSE of ridge on the top-k features for
    k = 10, 20, ... from ONE set of block Grams."""
    past = _past(spark, d)
    feats = [c for c in past.columns if c not in ("series", "dt", "target")]
    scores = SEL.f_regression_scores(past, feats, "target")
    ranked_names = [r["feature"] for r in SEL.top_k_features(scores, len(feats)).orderBy("rank").collect()]
    ranked = [feats.index(n) for n in ranked_names]
    b = V.with_walk_forward_blocks(past, SW, 252, 21, 1)
    means = L.column_means(b, [*feats, "target"])
    blocks = L.gram_blocks(b, feats, "target", ["_blk"], means)
    nb = max(k[0] for k in blocks) + 1
    ks = list(range(10, min(100, len(feats)) + 1, 10))
    res = R.feature_count_search(blocks, ranked, nb, ks, "ridge", {"alpha": 1.0})
    return spark.createDataFrame([(int(k), float(v)) for k, v in res], "k long, cv_mse double")


@register("f10_pca")
def q_pca(spark, d):
    q = _quick(spark, d)
    return R.pca_variance(q, QF, keep=["series", "dt", "target"], threshold=0.95)


def _base_preds_holdout(spark, d):
    q = _quick(spark, d)
    preds, _ = V.holdout_linear(q, SW, QF, "target", {k: v for k, v in MD.LINEAR_MODELS.items() if k != "bayesian_ridge"})
    return collect_model_predictions(preds, ["series", "dt", "row_idx", "y"], ["linear_regression", "ridge", "lasso", "elastic_net"])


BASE = ["linear_regression", "ridge", "lasso", "elastic_net"]


def _older_half(df):
    """``older``: the row is in the older half of its series' hold-out (what is fitted on it is never scored on it)."""
    by_time = Window.partitionBy("series").orderBy("row_idx")
    everything = Window.partitionBy("series")
    return df.withColumn("older", F.row_number().over(by_time) <= F.floor(F.count(F.lit(1)).over(everything) / 2))


def _blend(spark, d, method):
    wide = cut_lineage(_older_half(_base_preds_holdout(spark, d)))
    weights = ST.blend_weights(wide.where("older"), BASE, "y", method)
    return ST.apply_weights(wide.where("NOT older"), weights).select("series", "dt", "y", "blend_pred")


@register("e06_blending")
def q_blend(spark, d):
    """NNLS weights (sum 1) of the base models on the older half of each hold-out, applied to the rest."""
    return _blend(spark, d, "linear")


@register("e06_blending_ridge")
def q_blend_ridge(spark, d):
    return _blend(spark, d, "ridge")


@register("e06_blending_lasso")
def q_blend_lasso(spark, d):
    return _blend(spark, d, "lasso")


@register("e04_temporal_stacking")
def q_tstack(spark, d):
    """Base models fit on the first 80 %; ridge meta model on their predictions and the scaled
    features of the older half of each hold-out, applied to the rest."""
    wide = _older_half(_base_preds_holdout(spark, d)).join(_quick(spark, d).select("series", "dt", *QF), ["series", "dt"])
    return ST.temporal_stack(cut_lineage(wide), BASE, QF, F.col("older")).select("series", "dt", "y", "stack_pred")


@register("e03_stacking_kfold")
def q_kstack(spark, d):
    """3-fold (hash-assigned, non-temporal as the reference) out-of-fold base predictions,
    ridge meta model on them."""
    q = _quick(spark, d).withColumn("_fold", F.pmod(F.xxhash64(F.lit(42), "series", "dt"), F.lit(3)))
    oof = ST.kfold_oof_linear(q, QF, "target", "_fold", {k: MD.LINEAR_MODELS[k] for k in BASE})
    wide = collect_model_predictions(oof.withColumnRenamed("target", "y"), ["series", "dt", "y"], BASE)
    fit = ST.stack_meta(wide, BASE, "y")
    return ST.apply_meta(wide, fit, BASE).select("series", "dt", "y", "stack_pred")


@register("e05_oof_stacking")
def q_oof(spark, d):
    """On the older 80 % of each series, out-of-fold predictions of five expanding folds (0 where a row
    was never validated) and a ridge meta model on them; the bases, fitted again on all those rows, predict the
    rest, and the meta model their predictions."""
    q = _quick(spark, d).select("*", SW.row_idx().alias("i"), SW.n_rows().alias("n"))
    old = F.col("i") < F.floor(F.col("n") * 0.8)
    train = cut_lineage(q.where(old).drop("i", "n"))
    models = {k: MD.LINEAR_MODELS[k] for k in BASE}
    oof = collect_model_predictions(V.expanding_linear(train, SW, QF, "target", models, 5), ["series", "dt", "y"], BASE)
    rows = train.select("series", "dt", F.col("target").alias("y")).join(oof.drop("y"), ["series", "dt"], "left")
    meta = ST.stack_meta(rows, BASE, "y", fill_zero=True)
    fitted = L.group_fits(L.gram_table(train.withColumn("_all", F.lit(0)), QF, "target", ["_all"], means := L.column_means(train, [*QF, "target"])),
                          ["_all"], models, QF, "target", means)
    test = q.where(~old).select("series", "dt", F.col("target").alias("y"), *QF).withColumn("_all", F.lit(0))
    preds = L.score(test, cut_lineage(fitted.select("_all", "model", "intercept", "coef")), ["_all"], QF).select("series", "dt", "model", "y", "pred")
    return ST.apply_meta(collect_model_predictions(preds, ["series", "dt", "y"], BASE), meta, BASE).select("series", "dt", "y", "stack_pred")


@register("e11_bootstrap_interval")
def q_boot(spark, d):
    """Residual bootstrap (B = 100) around the ridge predictions of the later half of each
    hold-out, with the residuals of the older half."""
    q = _quick(spark, d)
    preds, _ = V.holdout_linear(q, SW, QF, "target", {"ridge": MD.LINEAR_MODELS["ridge"]})
    preds = cut_lineage(_older_half(preds))
    res = preds.where("older").select("series", (F.col("y") - F.col("pred")).alias("resid"), F.col("row_idx").alias("_rid"))
    return ST.bootstrap_interval(preds.where("NOT older"), res, ["series", "dt"], ["series"], B=100)


@register("e12_recursive_forecast")
def q_recursive(spark, d):
    """30 recursive one-step forecasts per series from an OLS fit on all rows."""
    q = _quick(spark, d)
    means = L.column_means(q, [*QF, "target"])
    g = L.gram_blocks(q.withColumn("_all", F.lit(0)), QF, "target", ["_all"], means)[(0,)]
    fit = L.solve_ridge(g, 1.0).shifted(np.array([means[c] for c in QF]), means["target"])
    return ST.recursive_forecast(fixtures.bars(spark, d), ["series"], dict(zip(QF, fit.coef.tolist())),
                                 fit.intercept, ST.quick_feature_row, 30, 30)


def _e12_sql(steps: int = 30, n: int = 5, z: float = NormalDist().inv_cdf(0.975)) -> str:
    fits = ", ".join(f"{{'r': regr_r2(target, {c}), 'f': '{c}', 'a': regr_intercept(target, {c}), 'b': regr_slope(target, {c}), 'k': {k + 1}}}" for k, c in enumerate(QF))
    x = ("[list_avg(p[-5:]), list_avg(p[-10:]), list_avg(p[-20:]), p[-1] / p[-2] - 1, p[-1] / p[-6] - 1, list_aggregate(p[-10:], 'stddev_samp'), p[-2], p[-3], p[-4]]")
    return f"""WITH RECURSIVE q AS ({quick_features_sql()}),
 fits AS (SELECT series, unnest([{fits}]) AS m FROM q GROUP BY series),
 tops AS (SELECT series, list({{'a': m.a, 'b': m.b, 'k': m.k}} ORDER BY m.r DESC, m.f) AS models
   FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY m.r DESC, m.f) AS i FROM fits) WHERE i <= {n} GROUP BY series),
 {BARS},
 tail AS (SELECT series, max(dt) AS last, list(price ORDER BY dt)[-20:] AS p FROM bars GROUP BY series),
 rec AS (SELECT series, last, models, 0 AS step, p, NULL::DOUBLE AS forecast, NULL::DOUBLE AS std FROM tail JOIN tops USING (series)
   UNION ALL SELECT series, last, models, step, p[2:] || [list_avg(v)], list_avg(v), list_aggregate(v, 'stddev_pop')
   FROM (SELECT series, last, models, step + 1 AS step, p, list_transform(models, lambda m: m.a + m.b * x[m.k]) AS v
     FROM (SELECT *, {x} AS x FROM rec WHERE step < {steps})))
SELECT series, step::BIGINT AS step, last + to_days(step::INTEGER) AS dt, forecast, std, forecast - {z!r} * std AS lower, forecast + {z!r} * std AS upper FROM rec WHERE step > 0"""


@register("e12b_ensemble_forecast", _e12_sql(), exact=["series", "step", "dt"], ts=["dt"])
def q_ensemble_forecast(spark, d):
    """30 recursive steps of the mean of each series' five best single-feature models, with the normal
    95 % band over the models."""
    state = RC.tails(fixtures.bars(spark, d), ["series"], RC.QUICK_TAIL).join(RC.top_models(_quick(spark, d), ["series"], QF, "target"), "series")
    return RC.ensemble_forecast(state, ["series"], RC.QUICK, 30)


@register("m10_additive_forecast")
def q_additive(spark, d):
    return MD.additive_forecast(fixtures.bars(spark, d), ["series"], "dt", "price", horizon=30)
