"""Sources / sinks round trips, linear algebra against numpy, model and streaming smoke tests."""

import os
import tempfile
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import SF
from tsengine.frames import SeriesWindow
from tsengine.operators import clean as P
from tsengine.operators import linear as L
from tsengine.operators import stacking as ST
from tsengine.plans import bundles, fixtures
from tsengine.sources import bars as SB
from tsengine.sources import results as RS

SW = SeriesWindow("series", "dt")


def _xy(spark, n=400, d=4, seed=3):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d)) * [1, 10, 100, 0.1] + [5, -3, 1000, 0]
    y = X @ np.array([1.5, -0.2, 0.01, 30.0]) + 7 + rng.normal(0, 0.5, n)
    pdf = pd.DataFrame(X, columns=[f"x{i}" for i in range(d)]).assign(y=y, g=0)
    return spark.createDataFrame(pdf), X, y


def test_gram_ols_ridge_match_numpy(spark):
    df, X, y = _xy(spark)
    feats = [f"x{i}" for i in range(4)]
    g = L.gram_blocks(df, feats, "y", ["g"], L.column_means(df, [*feats, "y"]))[(0,)]
    means = L.column_means(df, [*feats, "y"])
    shift = np.array([means[c] for c in feats])
    ols = L.solve_ridge(g, 0.0).shifted(shift, means["y"])
    A = np.c_[np.ones(len(X)), X]
    ref = np.linalg.lstsq(A, y, rcond=None)[0]
    np.testing.assert_allclose(ols.coef, ref[1:], rtol=1e-9)
    np.testing.assert_allclose(ols.intercept, ref[0], rtol=1e-9)
    alpha = 3.0
    Xc, yc = X - X.mean(0), y - y.mean()
    rb = np.linalg.solve(Xc.T @ Xc + alpha * np.eye(4), Xc.T @ yc)
    np.testing.assert_allclose(L.solve_ridge(g, alpha).coef, rb, rtol=1e-9)


def test_lasso_batch_equals_single_and_kkt(spark):
    df, X, y = _xy(spark)
    feats = [f"x{i}" for i in range(4)]
    g = L.gram_blocks(df, feats, "y", ["g"])[(0,)]
    a = L.solve_elastic_net(g, 0.5, 1.0, max_iter=20000, tol=1e-12)
    b = L.solve_elastic_net_batch([g, g], 0.5, 1.0, max_iter=20000, tol=1e-12)[1]
    np.testing.assert_allclose(a.coef, b.coef, rtol=1e-9, atol=1e-12)
    # KKT of (1/2n)||y - Xb - c||^2 + alpha ||b||_1
    Xc, yc = X - X.mean(0), y - y.mean()
    grad = Xc.T @ (yc - Xc @ a.coef) / len(y)
    nz = np.abs(a.coef) > 1e-12
    np.testing.assert_allclose(grad[nz], 0.5 * np.sign(a.coef[nz]), atol=1e-6)
    assert (np.abs(grad[~nz]) <= 0.5 + 1e-6).all()


def test_bayesian_ridge_close_to_ols_with_much_data(spark):
    df, X, y = _xy(spark, n=2000)
    feats = [f"x{i}" for i in range(4)]
    g = L.gram_blocks(df, feats, "y", ["g"])[(0,)]
    br, ols = L.solve_bayesian_ridge(g), L.solve_ridge(g, 0.0)
    np.testing.assert_allclose(br.coef, ols.coef, rtol=1e-2)


def test_kfold_oof_matches_direct_fits(spark):
    df, X, y = _xy(spark, n=300)
    feats = [f"x{i}" for i in range(4)]
    df = df.withColumn("fold", (F.monotonically_increasing_id() % 3).cast("int"))
    oof = ST.kfold_oof_linear(df, feats, "y", "fold", {"ols": ("linear_regression", {})}).toPandas()
    p = df.toPandas()
    for f in range(3):
        tr = p[p.fold != f]
        A = np.c_[np.ones(len(tr)), tr[feats].to_numpy()]
        beta = np.linalg.lstsq(A, tr.y.to_numpy(), rcond=None)[0]
        te = oof[oof.fold == f]
        np.testing.assert_allclose(te.pred.to_numpy(), np.c_[np.ones(len(te)), te[feats].to_numpy()] @ beta, rtol=1e-8)


def test_result_sets_round_trip(spark):
    tidy = spark.createDataFrame([("r1", "ridge", 0.1, 0.9, 1.0, 0.5, 0.2), ("r1", "lasso", 0.2, 0.8, 2.0, 0.6, 0.3),
                                  ("r2", "ridge", 0.3, float("nan"), 3.0, 0.7, 0.4)],
                                 "run string, model string, mse double, r2 double, rmse double, mae double, cv_score double")
    reports = [RS.to_report(tidy, "run", "model", ["r2", "rmse", "mae"], lay) for lay in RS.LAYOUTS]
    back = RS.explode_result_sets(reports).toPandas()
    assert len(back) == 9 and back.r2.isna().sum() == 3  # NaN became NULL in every layout
    assert set(back.layout) == set(RS.LAYOUTS)


def test_csv_and_latest_file(spark):
    d = tempfile.mkdtemp(prefix="tsengine-io-")
    pdf = pd.DataFrame({"date": ["2020-01-01", "2020-01-02"], "open": [1.0, 2.0], "high": [1.0, 2.0], "low": [1.0, 2.0],
                        "close": [1.0, 2.0], "volume": [1, 2], "price": [1.0, 2.0]})
    pdf.to_csv(os.path.join(d, "gold_old.csv"), index=False)
    time.sleep(1.1)
    pdf.to_csv(os.path.join(d, "gold_new.csv"), index=False)
    newest = SB.latest_file(spark, d, "gold").first()["path"]
    assert newest.endswith("gold_new.csv")
    bars = SB.read_bars_csv(spark, newest, series="g").toPandas()
    assert list(bars.columns[:2]) == ["series", "dt"] and len(bars) == 2


def test_null_profile_and_drop_all_null(spark):
    b = fixtures.bars(spark, SF).withColumn("empty", F.lit(None).cast("double"))
    prof = P.null_profile(b, ["price", "empty"])
    out = P.drop_all_null_columns(b, prof)
    assert "empty" not in out.columns and "price" in out.columns


def test_contract_without_dates(spark):
    b = fixtures.bars(spark, SF).limit(200)
    out = bundles.feature_contract_50(b, SW, has_date=False)
    r = out.select("month", "week_of_year").first()
    assert (r["month"], r["week_of_year"]) == (6, 26)
    assert out.select([F.sum(F.col(c).isNull().cast("int")) for c in out.columns[2:]]).first() == tuple([0] * (len(out.columns) - 2))


def test_model_save_load(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression
    df, _, _ = _xy(spark, n=100)
    pipe = Pipeline(stages=[VectorAssembler(inputCols=["x0", "x1"], outputCol="features"),
                            LinearRegression(featuresCol="features", labelCol="y")]).fit(df)
    path = tempfile.mkdtemp(prefix="tsengine-model-") + "/m"
    RS.save_model(pipe, path, ["x0", "x1"])
    again = RS.load_model(path)
    a = pipe.transform(df).select("prediction").toPandas().prediction
    b = again.transform(df).select("prediction").toPandas().prediction
    np.testing.assert_allclose(a, b)


def test_streaming_bars_equal_batch(spark):
    from tsengine.operators.bars import ohlcv
    from tsengine.streaming import jobs as T
    d = tempfile.mkdtemp(prefix="tsengine-stream-")
    ticks = fixtures.ticks(spark, SF)
    ticks.repartition(3).write.mode("overwrite").parquet(d)  # three landed files
    src = spark.readStream.schema(ticks.schema).parquet(d)
    table = T.run_available_now(T.bars_from_ticks_stream(src, "1 hour", "10 minutes"), "test_t05", "complete")
    got = spark.table(table).withColumn("dt", F.col("dt").cast("timestamp_ntz")).orderBy("series", "dt").toPandas()
    exp = ohlcv(ticks, ["series"], "ts", "price", "seq", "size", interval="1 hour").drop("price") \
        .orderBy("series", "dt").toPandas()
    pd.testing.assert_frame_equal(got[exp.columns].reset_index(drop=True), exp.reset_index(drop=True), check_dtype=False)


def test_scheduled_refresh_gate(spark):
    from tsengine.streaming import jobs as T
    ledger = spark.createDataFrame([("a", pd.Timestamp("2024-01-01 00:00:00").to_pydatetime())],
                                   "source string, refreshed_at timestamp_ntz")
    ran = []
    assert T.scheduled_refresh(spark, ledger, "2024-01-01 00:10:00", 60, lambda: ran.append(1)) is False
    assert T.scheduled_refresh(spark, ledger, "2024-01-01 02:00:00", 60, lambda: ran.append(1)) is True
    assert ran == [1]


def test_walk_forward_ml_smoke(spark):
    from tsengine.operators import models as MD
    from tsengine.operators import validate as V
    q = bundles.quick_features(fixtures.bars(spark, SF), SW)
    out = V.walk_forward_ml(q, SW, ["ma_5", "price_lag_1"], "target", lambda: MD.random_forest(numTrees=5, maxDepth=3),
                            initial=150, step=50, max_folds=2, name="rf")
    assert out.count() > 0


def test_standardized_gram_solution_maps_back(spark):
    df, X, y = _xy(spark)
    feats = [f"x{i}" for i in range(4)]
    g = L.gram_blocks(df, feats, "y", ["g"])[(0,)]
    a = L.solve_many("ridge", [g], {"alpha": 0.0}, standardize=True)[0]
    b = L.solve_ridge(g, 0.0)
    np.testing.assert_allclose(a.coef, b.coef, rtol=1e-8)
    np.testing.assert_allclose(a.intercept, b.intercept, rtol=1e-8)


def test_search_batch_equals_per_trial(spark):
    from tsengine.operators import reduce as R
    df, X, y = _xy(spark, n=600)
    feats = [f"x{i}" for i in range(4)]
    df = df.withColumn("b", (F.monotonically_increasing_id() % 4).cast("int"))
    blocks = L.gram_blocks(df, feats, "y", ["b"])
    folds = [([(x,) for x in range(f + 1)], [(f + 1,)]) for f in range(3)]
    trials = [{"alpha": a} for a in (0.01, 0.1, 1.0)]
    batch = R.gram_cv_mse_trials(blocks, folds, [0, 1, 2, 3], "lasso", trials, standardize=True)
    one = [R.gram_cv_mse(blocks, folds, [0, 1, 2, 3], "lasso", t, standardize=True) for t in trials]
    np.testing.assert_allclose(batch, one, rtol=1e-6)
