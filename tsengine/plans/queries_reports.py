"""Registered queries on written reports (S13, S14) and artefacts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tsengine.frames import SeriesWindow
from tsengine.operators import artefact
from tsengine.operators import metrics as M
from tsengine.operators import models as MD
from tsengine.plans import bundles, fixtures
from tsengine.plans.oracle import PREDS
from tsengine.plans.registry import register
from tsengine.plans.sql_features import quick_features_sql
from tsengine.session import cut_lineage, ensure_checkpoint_dir
from tsengine.sources import reports


def _write_reports(spark, d) -> str:
    """A folder with an old and a new report of three kinds, from the metrics of the pseudo-models; the old
    ones' metrics are off by 100."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reports/{uuid.uuid4().hex}"
    scores = M.regression_metrics(fixtures.preds(spark, d), ["model"]).select("model", "r2", "rmse", "mae", "mse")
    for day, off in (("20240101", 100.0), ("20240102", 0.0)):
        def m(c, off=off):
            return F.col(c) + F.lit(off)

        def section(names):
            return F.map_from_entries(F.collect_list(F.struct("model", F.struct(*[m(c).alias(n) for n, c in names.items()]))))
        plain, tested = {"r2": "r2", "rmse": "rmse", "mae": "mae", "cv_score": "mse"}, {"test_r2": "r2", "test_rmse": "rmse", "test_mae": "mae", "cv_mean": "mse"}
        optimized = scores.agg(section(plain).alias("model_results"), section({"r2": "r2", "cv_std": "mae"}).alias("ensemble_results"))
        deep = scores.agg(section(tested).alias("model_results"), section({"r2": "r2", "mae": "mae"}).alias("test_results"))
        for name, doc in (("optimized_training_results", optimized), ("deep_learning_results", deep)):
            doc.select(F.to_json(F.struct(F.lit(day).alias("timestamp"), *doc.columns)).alias("value")).coalesce(1).write.text(f"{folder}/{name}_{day}.json")
        scores.select(F.col("model").alias("Model"), m("r2").alias("Overall_R2"), m("rmse").alias("Overall_RMSE"), m("mae").alias("Overall_MAE"),
                      m("mse").alias("Mean_Fold_R2")).write.option("header", "true").csv(f"{folder}/walk_forward_summary_{day}.csv")
    return folder


@register("s13_read_result_sets",
          f"WITH {PREDS}\nSELECT * FROM (VALUES ('optimized_training', 'optimized_training_results_20240102.json', 1), "
          "('deep_learning', 'deep_learning_results_20240102.json', 1), ('walk_forward_summary', 'walk_forward_summary_20240102.csv', "
          "(SELECT count(DISTINCT model) FROM preds))) AS t(kind, name, docs)", exact=["kind", "name", "docs"], all_exact=True)
def q_result_sets(spark, d):
    """The newest report of each kind in a folder of JSON and CSV reports."""
    sets = reports.read_result_sets(spark, _write_reports(spark, d))
    return sets.groupBy("kind", "name").agg(F.count("doc").alias("docs"))


@register("s14_explode_result_sets", f"""WITH {PREDS},
 s AS (SELECT model, 1 - sum((y - pred) * (y - pred)) / nullif(var_pop(y) * count(*), 0) AS r2, sqrt(avg((y - pred) * (y - pred))) AS rmse,
   avg(abs(y - pred)) AS mae, avg((y - pred) * (y - pred)) AS mse FROM preds GROUP BY model)
SELECT 'optimized_training' AS kind, 'model_results' AS section, 'Individual' AS model_type, model, r2, rmse, mae, mse AS cv_score, NULL::DOUBLE AS cv_std FROM s
UNION ALL SELECT 'optimized_training', 'ensemble_results', 'Ensemble', model, r2, NULL, NULL, NULL, mae FROM s
UNION ALL SELECT 'deep_learning', 'model_results', 'Deep Learning', model, r2, rmse, mae, mse, NULL FROM s
UNION ALL SELECT 'deep_learning', 'test_results', 'Deep Learning', model, r2, NULL, mae, NULL, NULL FROM s
UNION ALL SELECT 'walk_forward_summary', 'rows', 'Traditional ML', model, r2, rmse, mae, mse, NULL FROM s""",
          exact=["kind", "section", "model_type", "model"])
def q_explode_sets(spark, d):
    """Three layouts of reports in one table."""
    return reports.explode_result_sets(reports.read_result_sets(spark, _write_reports(spark, d)))


SW = SeriesWindow("series", "dt")
QF = ["ma_5", "ma_10", "ma_20", "price_change", "price_change_5", "volatility", "price_lag_1", "price_lag_2", "price_lag_3"]
_EACH = ", ".join(f"{{'r': regr_r2(target, {c}), 'f': '{c}', 'a': regr_intercept(target, {c}), 'b': regr_slope(target, {c})}}" for c in QF)


@register("s19_artefact_roundtrip", f"""WITH q0 AS ({quick_features_sql()}),
 q AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM q0),
 best AS (SELECT m FROM (SELECT unnest([{_EACH}]) AS m FROM q WHERE i < floor(n * 0.8)) ORDER BY m.r DESC, m.f LIMIT 1)
SELECT series, dt, m.f AS feature, m.a + m.b * CASE m.f {' '.join(f"WHEN '{c}' THEN {c}" for c in QF)} END AS pred, TRUE AS same FROM q, best WHERE i >= floor(n * 0.8)""",
          exact=["series", "dt", "feature", "same"], ts=["dt"])
def q_artefact(spark, d):
    """Scaler, selection of the best feature of nine and least squares, fitted on the older 80 % of each series,
    saved and loaded; the loaded model's predictions, and whether they are the fitted one's to the bit."""
    q = bundles.quick_features(fixtures.bars(spark, d), SW).select("*", SW.row_idx().alias("i"), SW.n_rows().alias("n"))
    cut = F.floor(F.col("n") * 0.8)
    fitted = artefact.LinearEstimator(featureCols=QF, labelCol="target", predictionCol="fitted", solver="linear_regression", k=1).fit(q.where(F.col("i") < cut))
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/models/{uuid.uuid4().hex}"
    fitted.write().save(path)
    loaded = artefact.LinearArtefact.load(path)
    out = loaded.transform(fitted.transform(q.where(F.col("i") >= cut)), {loaded.predictionCol: "pred"})
    return out.select("series", "dt", F.lit(loaded.selected()[0]).alias("feature"), "pred", F.col("pred").eqNullSafe(F.col("fitted")).alias("same"))


M13_SQL = f"""WITH q0 AS ({quick_features_sql()}),
 q AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY dt) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM q0),
 t AS (SELECT avg(price_lag_1) AS mx, avg(target) AS my, regr_slope(target, price_lag_1) AS b, count(*) AS k FROM q WHERE i < floor(n * 0.8)),
 p AS (SELECT model, series, dt, target AS y, my + f * b * (price_lag_1 - mx) AS pred FROM q, t,
   (VALUES ('linear_regression', 1.0::DOUBLE), ('ridge', 0.5::DOUBLE)) AS m(model, f) WHERE i >= floor(n * 0.8)),
 s AS (SELECT model, 1 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) AS r2 FROM p GROUP BY model)
SELECT series, dt, model, pred FROM p WHERE model = (SELECT model FROM s ORDER BY r2 DESC, model DESC LIMIT 1)"""


@register("m13_best_model_pointer", M13_SQL, exact=["series", "dt", "model"], ts=["dt"])
def q_registry(spark, d):
    """Two models of the registry, least squares and a ridge whose penalty is the number of training rows (which halves
    the slope), fitted on the older 80 %, saved, and the better one on the rest loaded by its pointer."""
    q = bundles.quick_features(fixtures.bars(spark, d), SW).select("*", SW.row_idx().alias("i"), SW.n_rows().alias("n"))
    cut = F.floor(F.col("n") * 0.8)
    train, test = cut_lineage(q.where(F.col("i") < cut)), q.where(F.col("i") >= cut)
    own = {"linear_regression": {}, "ridge": {"alpha": float(train.count())}}
    fitted = {name: MD.estimator(name, featureCols=["price_lag_1"], labelCol="target", predictionCol="pred", **kw).fit(train) for name, kw in own.items()}
    scored = None
    for name, model in fitted.items():
        one = model.transform(test).select(F.lit(name).alias("model"), F.col("target").alias("y"), "pred")
        scored = one if scored is None else scored.unionByName(one)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/registry/{uuid.uuid4().hex}"
    MD.save_models(fitted, M.regression_metrics(scored, ["model"]), path)
    name, best = MD.load_best(spark, path)
    return best.transform(test).select("series", "dt", F.lit(name).alias("model"), "pred")
