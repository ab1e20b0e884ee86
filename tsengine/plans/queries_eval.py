"""Registered validation, metric, ensemble, scaling and selection queries (H*, A08–A19, E*, F03–F09,
C06, M11, O03–O04). Predictions come from three deterministic pseudo-models (``fixtures.preds``)
so every metric is SQL-checkable without training."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsengine.frames import SeriesWindow
from tsengine.operators import ensemble as E
from tsengine.operators import folds as H
from tsengine.operators import forecast as FC
from tsengine.operators import metrics as M
from tsengine.operators import scale as SC
from tsengine.operators import select as SEL
from tsengine.plans import bundles, fixtures
from tsengine.plans.oracle import BARS, PREDS
from tsengine.plans.registry import register
from tsengine.plans.sql_features import quick_features_sql

SW = SeriesWindow("series", "dt")
FOLD_EXACT = ["series", "fold", "train_from", "train_to", "test_from", "test_to", "train_size", "test_size"]
COUNTS_SQL = f"WITH {BARS},\n counts AS (SELECT series, count(*) AS n FROM bars GROUP BY series)"


def _counts(spark, d):
    return H.series_counts(fixtures.bars(spark, d), SW)


def _fold_sql(body: str) -> str:
    return (COUNTS_SQL + f",\n ft AS ({body})\nSELECT series, fold::BIGINT AS fold, train_from::BIGINT AS train_from, "
            "train_to::BIGINT AS train_to, test_from::BIGINT AS test_from, test_to::BIGINT AS test_to, "
            "(train_to - train_from)::BIGINT AS train_size, (test_to - test_from)::BIGINT AS test_size FROM ft")


def _fold_reg(name, sql_body, fn):
    register(name, _fold_sql(sql_body), exact=FOLD_EXACT, all_exact=True)(lambda spark, d: fn(_counts(spark, d)))


_fold_reg("h01_holdout", "SELECT series, 0 AS fold, 0 AS train_from, floor(n * 0.8) AS train_to, floor(n * 0.8) AS test_from, n AS test_to FROM counts",
          lambda c: H.holdout(c, ["series"]))
_fold_reg("h02_train_val_test",
          "SELECT series, 0 AS fold, 0 AS train_from, floor(floor(n * 0.8) * 0.8) AS train_to, floor(floor(n * 0.8) * 0.8) AS test_from, "
          "floor(n * 0.8) AS test_to FROM counts UNION ALL SELECT series, 1, 0, floor(n * 0.8), floor(n * 0.8), n FROM counts",
          lambda c: H.train_val_test(c, ["series"]))
_fold_reg("h03_expanding_splits",
          "SELECT series, fold, 0 AS train_from, n - 5 * (n // 6) + fold * (n // 6) AS train_to, n - 5 * (n // 6) + fold * (n // 6) AS test_from, "
          "n - 5 * (n // 6) + fold * (n // 6) + n // 6 AS test_to FROM (SELECT *, unnest(range(0, 5)) AS fold FROM counts) WHERE n // 6 > 0",
          lambda c: H.expanding_splits(c, ["series"], 5))
WF_BODY = ("SELECT series, fold, {train_from} AS train_from, 252 + fold * 21 AS train_to, 252 + fold * 21 AS test_from, "
           "least(252 + fold * 21 + 21, n - 1) AS test_to FROM (SELECT *, unnest(range(0, CASE WHEN n - 1 > 252 THEN (n - 1 - 252 - 1) // 21 + 1 ELSE 0 END)) AS fold FROM counts)")
_fold_reg("h05_walk_forward_splits", WF_BODY.format(train_from="0"), lambda c: H.walk_forward_splits(c, ["series"]))
_fold_reg("h05b_walk_forward_rolling", WF_BODY.format(train_from="greatest(0, fold * 21)"),
          lambda c: H.walk_forward_splits(c, ["series"], expanding=False))
_fold_reg("h06_walk_forward_equal",
          "SELECT * FROM (SELECT series, fold, 0 AS train_from, (n // 6) * (fold + 2) AS train_to, (n // 6) * (fold + 2) AS test_from, "
          "least((n // 6) * (fold + 3), n) AS test_to FROM (SELECT *, unnest(range(0, 5)) AS fold FROM counts)) WHERE test_to > test_from",
          lambda c: H.walk_forward_equal(c, ["series"], 5))
_fold_reg("h07_walk_forward_sliding",
          "SELECT * FROM (SELECT series, fold, fold * ((n - floor(n * 0.2)::BIGINT) // 5) AS train_from, (fold * ((n - floor(n * 0.2)::BIGINT) // 5) + ((n - floor(n * 0.2)::BIGINT) // 5) + CASE WHEN fold = 4 THEN (n - floor(n * 0.2)::BIGINT) % 5 ELSE 0 END) AS train_to, (fold * ((n - floor(n * 0.2)::BIGINT) // 5) + ((n - floor(n * 0.2)::BIGINT) // 5) + CASE WHEN fold = 4 THEN (n - floor(n * 0.2)::BIGINT) % 5 ELSE 0 END) AS test_from, "
          "least((fold * ((n - floor(n * 0.2)::BIGINT) // 5) + ((n - floor(n * 0.2)::BIGINT) // 5) + CASE WHEN fold = 4 THEN (n - floor(n * 0.2)::BIGINT) % 5 ELSE 0 END) + floor(n * 0.2)::BIGINT // 5, n) AS test_to, n FROM (SELECT *, unnest(range(0, 5)) AS fold FROM counts)) "
          "WHERE test_from < n AND test_to > test_from",
          lambda c: H.walk_forward_sliding(c, ["series"], 5))
_fold_reg("h08_reverse_holdout", "SELECT series, 0 AS fold, floor(n * 0.2) AS train_from, n AS train_to, 0 AS test_from, floor(n * 0.2) AS test_to FROM counts",
          lambda c: H.reverse_holdout(c, ["series"]))


@register("h09_random_split",
          f"WITH {BARS}\nSELECT *, ('0x' || substr(md5('42|' || series || '|' || CAST(dt AS VARCHAR)), 1, 8))::BIGINT % 10000 < 2000 AS is_test FROM bars",
          exact=["series", "dt", "volume", "is_test"], ts=["dt"])
def q_random(spark, d):
    return H.random_split(fixtures.bars(spark, d), ["series", "dt"], 0.2, 42)


# ---- metrics over pseudo-model predictions ----------------------------------------------------------
MET_SQL = ("count(*)::BIGINT AS n, sum((y - pred) * (y - pred)) / count(*) AS mse, avg(abs(y - pred)) AS mae, "
           "CASE WHEN var_pop(y) * count(*) > 0 THEN 1.0 - sum((y - pred) * (y - pred)) / (var_pop(y) * count(*)) ELSE 0.0 END AS r2, "
           "sqrt(sum((y - pred) * (y - pred)) / count(*)) AS rmse")
SCORED_SQL = (PREDS + ",\n counts AS (SELECT series, count(*) AS n FROM bars GROUP BY series),\n folds AS ("
              + WF_BODY.format(train_from="0") + "),\n scored AS (SELECT p.*, f.fold FROM preds p JOIN folds f ON p.series = f.series "
              "AND p.row_idx >= f.test_from AND p.row_idx < f.test_to),\n"
              f" fm AS (SELECT series, model, fold, {MET_SQL} FROM scored GROUP BY series, model, fold)")


def _scored(spark, d):
    p = fixtures.preds(spark, d)
    folds = H.walk_forward_splits(_counts(spark, d), ["series"])
    return H.assign(p, folds, SW, "test"), folds


def _fm(spark, d):
    scored, folds = _scored(spark, d)
    return M.fold_metrics(scored, ["series", "model"], folds)


@register("a08_regression_metrics", f"WITH {PREDS}\nSELECT series, model, {MET_SQL} FROM preds GROUP BY series, model",
          exact=["series", "model", "n"])
def q_metrics(spark, d):
    return M.regression_metrics(fixtures.preds(spark, d), ["series", "model"])


@register("a09_fold_metrics",
          "WITH " + SCORED_SQL + ",\n fsz AS (SELECT series, fold, train_to - train_from AS train_size, test_to - test_from AS test_size FROM folds)\n"
          "SELECT fm.*, fsz.train_size::BIGINT AS train_size, fsz.test_size::BIGINT AS test_size FROM fm JOIN fsz USING (series, fold)",
          exact=["series", "model", "fold", "n", "train_size", "test_size"])
def q_fold_metrics(spark, d):
    return _fm(spark, d)


FSTAT_SQL = ("avg(r2) AS r2_mean, stddev_samp(r2) AS r2_std, avg(rmse) AS rmse_mean, stddev_samp(rmse) AS rmse_std, "
             "avg(mae) AS mae_mean, stddev_samp(mae) AS mae_std, count(r2)::BIGINT AS successful_folds, count(*)::BIGINT AS total_folds, "
             "count(r2) / count(*) AS success_rate")


@register("a10_fold_statistics", "WITH " + SCORED_SQL + f"\nSELECT series, model, {FSTAT_SQL} FROM fm GROUP BY series, model",
          exact=["series", "model", "successful_folds", "total_folds"])
def q_fold_stats(spark, d):
    return M.fold_statistics(_fm(spark, d), ["series", "model"])


@register("a11_cv_score", "WITH " + SCORED_SQL + "\nSELECT series, model, avg(mse) AS cv_score, stddev_pop(mse) AS cv_std FROM fm GROUP BY series, model",
          exact=["series", "model"])
def q_cv(spark, d):
    return M.cv_score(_fm(spark, d), ["series", "model"])


SUMMARY_SQL = (SCORED_SQL + f",\n pooled AS (SELECT series, model, {MET_SQL} FROM scored GROUP BY series, model),\n"
               f" fst AS (SELECT series, model, {FSTAT_SQL} FROM fm GROUP BY series, model),\n"
               " summ AS (SELECT * FROM pooled JOIN fst USING (series, model))")


@register("a12_walk_forward_summary", "WITH " + SUMMARY_SQL + "\nSELECT * FROM summ",
          exact=["series", "model", "n", "successful_folds", "total_folds"])
def q_wf_summary(spark, d):
    scored, _ = _scored(spark, d)
    return M.walk_forward_summary(scored, _fm(spark, d), ["series", "model"])


@register("a13_best_model", "WITH " + SUMMARY_SQL + "\nSELECT series, arg_max(model, r2) AS best_model, max(r2) AS best_r2 FROM summ GROUP BY series",
          exact=["series", "best_model"])
def q_best(spark, d):
    return M.best_model(q_wf_summary(spark, d), ["series"], "r2")


FAM_SQL = "CASE " + " ".join(f"WHEN model IN ({', '.join(repr(m) for m in ms)}) THEN '{f}'"
                             for f, ms in (M.FAMILIES | M.TYPES).items()) + " ELSE 'other' END"
RESULTS_SQL = (SUMMARY_SQL + ",\n cv AS (SELECT series, model, avg(mse) AS cv_score, stddev_pop(mse) AS cv_std FROM fm GROUP BY series, model),\n"
               f" results AS (SELECT s.series AS method, s.model, {FAM_SQL.replace('model', 's.model')} AS model_type, s.r2, s.rmse, s.mae, "
               "cv.cv_score, cv.cv_std FROM summ s JOIN cv USING (series, model))")


def results_table(spark, d):
    """Tidy result table (method = series, model, model_type = family, metrics, cv)."""
    s = q_wf_summary(spark, d)
    cv = M.cv_score(_fm(spark, d), ["series", "model"])
    j = s.join(cv, ["series", "model"])
    return j.select(F.col("series").alias("method"), "model", M.family_of(F.col("model")).alias("model_type"),
                    "r2", "rmse", "mae", "cv_score", "cv_std")


@register("a14_best_by_category",
          "WITH " + RESULTS_SQL + ",\n b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY method, model_type "
          "ORDER BY r2 DESC, model) AS rn FROM results WHERE r2 IS NOT NULL) WHERE rn = 1)\n"
          "SELECT method, model_type, model, r2, row_number() OVER (PARTITION BY method ORDER BY r2 DESC, model) = 1 AS is_overall_best FROM b",
          exact=["method", "model_type", "model", "is_overall_best"])
def q_best_cat(spark, d):
    return M.best_by_category(results_table(spark, d), ["method"], "model_type")


LB_SQL = ("round(avg(r2), 4) AS r2_mean, round(stddev_samp(r2), 4) AS r2_std, round(max(r2), 4) AS r2_max, "
          "round(avg(rmse), 4) AS rmse_mean, round(stddev_samp(rmse), 4) AS rmse_std, round(min(rmse), 4) AS rmse_min, "
          "round(avg(mae), 4) AS mae_mean, count(*)::BIGINT AS count")


@register("a15_leaderboard_by_model", "WITH " + RESULTS_SQL + f"\nSELECT model, {LB_SQL} FROM results GROUP BY model",
          exact=["model", "count"])
def q_lb_model(spark, d):
    return M.leaderboard(results_table(spark, d), "model")


@register("a15b_leaderboard_by_type", "WITH " + RESULTS_SQL + f"\nSELECT model_type, {LB_SQL} FROM results GROUP BY model_type",
          exact=["model_type", "count"])
def q_lb_type(spark, d):
    return M.leaderboard(results_table(spark, d), "model_type")


@register("a16_top_n", "WITH " + RESULTS_SQL + "\nSELECT * FROM results WHERE r2 IS NOT NULL ORDER BY r2 DESC, method, model LIMIT 5",
          exact=["method", "model", "model_type"])
def q_top(spark, d):
    return M.top_n(results_table(spark, d), "r2", 5, True, ["method", "model"])


@register("a17_stability_score",
          "WITH " + RESULTS_SQL + "\nSELECT *, -cv_std / (abs(cv_score) + 1e-6) AS stability FROM results WHERE cv_score IS NOT NULL AND cv_std IS NOT NULL",
          exact=["method", "model", "model_type"])
def q_stab(spark, d):
    return M.stability_score(results_table(spark, d))


@register("a18_family_insight",
          "WITH " + RESULTS_SQL + "\nSELECT model_type AS family, arg_max(model, r2) AS best_model, max(r2) AS best_r2, avg(r2) AS avg_r2, "
          "count(*)::BIGINT AS models FROM results GROUP BY model_type", exact=["family", "best_model", "models"])
def q_family(spark, d):
    return M.family_insight(results_table(spark, d))


# ---- ensembles and intervals ---------------------------------------------------------------------
KEYS = ["series", "dt"]


@register("e01_ensemble_mean", f"WITH {PREDS}\nSELECT series, dt, avg(pred) AS ensemble_pred, max(y) AS y FROM preds GROUP BY series, dt",
          exact=KEYS, ts=["dt"])
def q_mean(spark, d):
    return E.ensemble_mean(fixtures.preds(spark, d), KEYS, extra=["y"])


@register("e02_voting",
          "WITH " + SCORED_SQL + ",\n cv AS (SELECT series, model, avg(mse) AS cv_score FROM fm GROUP BY series, model),\n"
          " chosen AS (SELECT series, model FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY cv_score, model) AS rk FROM cv) WHERE rk <= 2)\n"
          "SELECT series, dt, avg(pred) AS voting_pred, count(*)::BIGINT AS n_models, max(y) AS y FROM preds SEMI JOIN chosen USING (series, model) GROUP BY series, dt",
          exact=KEYS + ["n_models"], ts=["dt"])
def q_voting(spark, d):
    cv = M.cv_score(_fm(spark, d), ["series", "model"])
    return E.voting(fixtures.preds(spark, d), cv, KEYS, ["series"], top=2, extra=["y"])


@register("e08_interval_percentile",
          f"WITH {PREDS}\nSELECT series, dt, avg(pred) AS mean_pred, quantile_cont(pred, 0.025) AS lower, quantile_cont(pred, 0.975) AS upper, "
          "stddev_pop(pred) AS std FROM preds GROUP BY series, dt", exact=KEYS, ts=["dt"])
def q_pint(spark, d):
    return E.interval_percentile(fixtures.preds(spark, d), KEYS, 0.95)


@register("e09_interval_multi",
          f"WITH {PREDS}\n"
          + " UNION ALL ".join(
              f"SELECT series, dt, {lv}::DOUBLE AS level, quantile_cont(pred, {(1 - lv) / 2!r}) AS lower, "
              f"quantile_cont(pred, {1 - (1 - lv) / 2!r}) AS upper, quantile_cont(pred, {1 - (1 - lv) / 2!r}) - "
              f"quantile_cont(pred, {(1 - lv) / 2!r}) AS width FROM preds GROUP BY series, dt" for lv in (0.68, 0.95, 0.99)),
          exact=KEYS, ts=["dt"])
def q_multi(spark, d):
    return E.interval_multi(fixtures.preds(spark, d), KEYS)


_Z = E.z_value(0.95)


@register("e10_interval_normal",
          f"WITH {PREDS}\nSELECT series, dt, avg(pred) AS mean_pred, stddev_pop(pred) AS std, avg(pred) - {_Z!r} * stddev_pop(pred) AS lower, "
          f"avg(pred) + {_Z!r} * stddev_pop(pred) AS upper FROM preds GROUP BY series, dt", exact=KEYS, ts=["dt"])
def q_nint(spark, d):
    return E.interval_normal(fixtures.preds(spark, d), KEYS, 0.95)


@register("e13_evaluate_ensembles",
          f"WITH {PREDS},\n ens AS (SELECT series, dt, 'mean' AS model, avg(pred) AS pred, max(y) AS y FROM preds GROUP BY series, dt\n"
          "  UNION ALL SELECT series, dt, model, pred, y FROM preds)\n"
          f"SELECT series, model, {MET_SQL} FROM ens GROUP BY series, model", exact=["series", "model", "n"])
def q_eval_ens(spark, d):
    p = fixtures.preds(spark, d)
    ens = E.ensemble_mean(p, KEYS, extra=["y"]).select(*KEYS, F.lit("mean").alias("model"),
                                                        F.col("ensemble_pred").alias("pred"), "y")
    allp = p.select(*KEYS, "model", "pred", "y").unionByName(ens)
    return M.regression_metrics(allp, ["series", "model"])


def _dyn_sql():
    from tsengine.functions.core import ewm_frame_rows
    k, r = ewm_frame_rows(0.3), 0.3
    w = "PARTITION BY series, model ORDER BY fold"
    return ("WITH " + SCORED_SQL + f""",
 a AS (SELECT series, model, fold, mse, avg(mse) OVER ({w} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS avg_mse FROM fm),
 b AS (SELECT *, (1.0 / (avg_mse + 1e-8)) / sum(1.0 / (avg_mse + 1e-8)) OVER (PARTITION BY series, fold) AS t,
         count(*) OVER (PARTITION BY series, fold) AS m FROM a),
 b2 AS (SELECT *, row_number() OVER ({w}) AS u FROM b),
 c AS (SELECT *, list_filter(list(CASE WHEN u > 1 THEN t END) OVER ({w} ROWS BETWEEN {k} PRECEDING AND CURRENT ROW), lambda x: x IS NOT NULL) AS h FROM b2)
SELECT series, model, fold::BIGINT AS "update", mse, avg_mse,
  CASE WHEN u = 1 THEN 1.0::DOUBLE / m ELSE list_reduce(h, lambda acc, x: acc * {1.0 - r!r}::DOUBLE + {r!r}::DOUBLE * x,
              CASE WHEN u <= {k + 1} THEN 1.0 / m ELSE 0.0 END::DOUBLE) END AS weight FROM c""")


@register("e07_dynamic_weights", _dyn_sql(), exact=["series", "model", "update"])
def q_dyn(spark, d):
    fm = _fm(spark, d).select("series", "model", F.col("fold").alias("update"), "mse")
    return E.dynamic_weights(fm, ["series"], window=3, rate=0.3)


# ---- scaling / selection on the quick feature table ---------------------------------------------------
QF = ["ma_5", "ma_10", "volatility", "price_change", "price_lag_1"]
QF_SQL = "WITH q AS (" + quick_features_sql().replace("WITH ", "WITH ", 1) + ")"


def _qf(spark, d):
    q = bundles.quick_features(fixtures.bars(spark, d), SW)
    return q.withColumn("row_idx", SW.row_idx())


def _train(df):
    n = df.groupBy("series").agg(F.count(F.lit(1)).alias("_n"))
    return df.join(n, "series").filter(F.col("row_idx") < F.floor(F.col("_n") * 0.8)).drop("_n")


def _qf_sql(body, train=True):
    tr = ",\n tr AS (SELECT * FROM q WHERE row_idx < floor(n * 0.8))" if train else ""
    return (f"WITH q0 AS ({quick_features_sql()}),\n q AS (SELECT series, dt, {', '.join(QF)}, target, "
            "row_number() OVER (PARTITION BY series ORDER BY dt) - 1 AS row_idx, count(*) OVER (PARTITION BY series) AS n FROM q0)"
            + tr + ("\n" if not body.startswith(",") else "") + body)


@register("f03_standard_scale",
          _qf_sql("SELECT q.series, q.dt, " + ", ".join(
              f"round(CASE WHEN s.sd_{c} = 0 THEN 0.0 ELSE (q.{c} - s.mu_{c}) / s.sd_{c} END, 6) AS {c}" for c in QF)
              + " FROM q JOIN (SELECT series, " + ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in QF)
              + " FROM tr GROUP BY series) s USING (series)"), exact=["series", "dt"], ts=["dt"])
def q_std(spark, d):
    q = _qf(spark, d)
    stats = SC.fit_standard(_train(q), QF, ["series"])
    out = SC.apply_standard(q.select("series", "dt", *QF), stats, QF, ["series"])
    # z-scores near 0 carry the cancellation error of the mean: compare at 1e-6 absolute
    return out.select("series", "dt", *[F.round(c, 6).alias(c) for c in QF])


@register("f04_minmax_scale",
          _qf_sql("SELECT q.series, q.dt, " + ", ".join(
              f"coalesce((q.{c} - s.lo_{c}) / NULLIF(s.hi_{c} - s.lo_{c}, 0), CASE WHEN q.{c} IS NOT NULL THEN 0.0 END) AS {c}" for c in QF)
              + " FROM q JOIN (SELECT series, " + ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in QF)
              + " FROM tr GROUP BY series) s USING (series)"), exact=["series", "dt"], ts=["dt"])
def q_minmax(spark, d):
    q = _qf(spark, d)
    stats = SC.fit_minmax(_train(q), QF, ["series"])
    return SC.apply_minmax(q.select("series", "dt", *QF), stats, QF, ["series"])


@register("f05_robust_scale",
          _qf_sql("SELECT q.series, q.dt, " + ", ".join(
              f"CASE WHEN s.q3_{c} - s.q1_{c} = 0 THEN q.{c} - s.md_{c} ELSE (q.{c} - s.md_{c}) / (s.q3_{c} - s.q1_{c}) END AS {c}" for c in QF)
              + " FROM q JOIN (SELECT series, " + ", ".join(
                  f"quantile_cont({c}, 0.25) AS q1_{c}, quantile_cont({c}, 0.5) AS md_{c}, quantile_cont({c}, 0.75) AS q3_{c}" for c in QF)
              + " FROM tr GROUP BY series) s USING (series)"), exact=["series", "dt"], ts=["dt"])
def q_robust(spark, d):
    q = _qf(spark, d)
    stats = SC.fit_robust(_train(q), QF, ["series"])
    return SC.apply_robust(q.select("series", "dt", *QF), stats, QF, ["series"])


@register("f06_inverse_scale",
          _qf_sql("SELECT q.series, q.dt, q.target, (q.target - s.mu) / s.sd * s.sd + s.mu AS target_restored FROM q JOIN "
                  "(SELECT series, avg(target) AS mu, stddev_pop(target) AS sd FROM tr GROUP BY series) s USING (series)"),
          exact=["series", "dt"], ts=["dt"])
def q_inverse(spark, d):
    q = _qf(spark, d)
    stats = SC.fit_standard(_train(q), ["target"], ["series"])
    scaled = SC.apply_standard(q.select("series", "dt", "target"), stats, ["target"], ["series"])
    back = SC.inverse_standard(scaled, stats, ["target"], ["series"], suffix="_restored")
    return back.drop("target").join(q.select("series", "dt", "target"), ["series", "dt"])


@register("f07_f_regression_topk",
          _qf_sql(",\n sc AS (SELECT series, feature, score FROM (SELECT series, count(*) AS n, "
                  + ", ".join(f"corr({c}, target) AS r_{c}" for c in QF) + " FROM q GROUP BY series) g, LATERAL (VALUES "
                  + ", ".join(f"('{c}', r_{c} * r_{c} / (1.0 - r_{c} * r_{c}) * (n - 2))" for c in QF) + ") v(feature, score))\n"
                  "SELECT series, feature, score, rank::BIGINT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY series "
                  "ORDER BY score DESC NULLS LAST, feature) AS rank FROM sc) WHERE rank <= 3", train=False),
          exact=["series", "feature", "rank"])
def q_freg(spark, d):
    q = _qf(spark, d)
    return SEL.top_k_features(SEL.f_regression_scores(q, QF, "target", ["series"]), 3, ["series"])


def _mi_sql():
    cols = QF + ["target"]
    rng = ", ".join(f"min({c}) AS lo_{c}, max({c}) AS hi_{c}" for c in cols)
    binned = ", ".join(f"CASE WHEN hi_{c} = lo_{c} THEN 0 ELSE least(floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * 10), 9) END AS b_{c}"
                       for c in cols)
    unp = " UNION ALL ".join(f"SELECT series, '{c}' AS feature, b_{c} AS bx, b_target AS byy FROM bq WHERE b_{c} IS NOT NULL AND b_target IS NOT NULL"
                             for c in QF)
    return _qf_sql(f",\n rg AS (SELECT series, {rng} FROM q GROUP BY series),\n bq AS (SELECT q.series, {binned} FROM q JOIN rg USING (series)),\n"
                   f" lng AS ({unp}),\n cxy AS (SELECT series, feature, bx, byy, count(*) AS nxy FROM lng GROUP BY ALL),\n"
                   " t AS (SELECT *, sum(nxy) OVER (PARTITION BY series, feature) AS n, sum(nxy) OVER (PARTITION BY series, feature, bx) AS nx, "
                   "sum(nxy) OVER (PARTITION BY series, feature, byy) AS ny FROM cxy)\n"
                   "SELECT series, feature, sum((nxy / n) * ln(nxy * n / (nx * ny))) AS score FROM t GROUP BY series, feature",
                   train=False)


@register("f08_mutual_info_binned", _mi_sql(), exact=["series", "feature"])
def q_mi(spark, d):
    return SEL.mutual_info_scores(_qf(spark, d), QF, "target", 10, ["series"])


# ---- forecast helpers, set operations -----------------------------------------------------------------
@register("c06_next_dates",
          f"WITH {BARS}\nSELECT series, step::BIGINT AS step, mx + step * INTERVAL 1 DAY AS dt FROM (SELECT series, max(dt) AS mx FROM bars GROUP BY series), "
          "unnest(range(1, 6)) t(step)", exact=["series", "step", "dt"], ts=["dt"], all_exact=True)
def q_next(spark, d):
    return FC.next_dates(fixtures.bars(spark, d), ["series"], "dt", 5).select("series", F.col("step").cast("long"), "dt")


NAIVE_SQL = (f"WITH {BARS},\n t AS (SELECT series, dt, price, first_value(price) OVER (PARTITION BY series ORDER BY dt ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS f FROM bars),\n"
             " l AS (SELECT series, arg_max(price, dt) AS p, arg_max(f, dt) AS f, max(dt) AS t FROM t GROUP BY series),\n"
             " fc AS (SELECT series, step::BIGINT AS step, t + step * INTERVAL 1 DAY AS dt, (p - f) / 5.0 AS trend, p + step * ((p - f) / 5.0) AS forecast "
             "FROM l, unnest(range(1, 6)) u(step))")


@register("m11_naive_trend_forecast", NAIVE_SQL + "\nSELECT * FROM fc", exact=["series", "step", "dt"], ts=["dt"])
def q_naive(spark, d):
    return FC.naive_trend_forecast(fixtures.bars(spark, d), ["series"], "dt", "price", 5, 5)


@register("o03_append_forecast",
          NAIVE_SQL + "\nSELECT series, dt, price, NULL::DOUBLE AS forecast, false AS is_forecast FROM bars UNION ALL "
          "SELECT series, dt, NULL::DOUBLE, forecast, true FROM fc", exact=["series", "dt", "is_forecast"], ts=["dt"])
def q_append(spark, d):
    hist = fixtures.bars(spark, d).select("series", "dt", "price")
    fc = FC.naive_trend_forecast(fixtures.bars(spark, d), ["series"], "dt", "price", 5, 5).select("series", "dt", "forecast")
    return FC.append_forecast(hist, fc)


@register("o04_merge_result_sets",
          "WITH " + RESULTS_SQL + ",\n runs AS (SELECT 1 AS run, method, model, r2 FROM results UNION ALL "
          "SELECT 2 AS run, method, model, r2 + 0.5 FROM results WHERE model <> 'lag1')\n"
          "SELECT run::BIGINT AS run, method, model, r2 FROM (SELECT *, row_number() OVER (PARTITION BY method, model ORDER BY run DESC) AS rn FROM runs) WHERE rn = 1",
          exact=["run", "method", "model"])
def q_merge_runs(spark, d):
    r = results_table(spark, d).select("method", "model", "r2")
    runs = r.withColumn("run", F.lit(1).cast("long")).unionByName(
        r.filter(F.col("model") != "lag1").withColumn("r2", F.col("r2") + 0.5).withColumn("run", F.lit(2).cast("long")))
    return FC.merge_result_sets(runs, ["method", "model"], "run").select("run", "method", "model", "r2")
