"""The linear artefact against numpy and through files; cross-validation of any estimator."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from tsengine.frames import SeriesWindow
from tsengine.operators import artefact
from tsengine.operators import validate as V


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    x = rng.normal([5, 1e6, 0, 3], [1, 1e3, 0.01, 0], (200, 4))
    y = 2 * x[:, 0] + 0.001 * x[:, 1] + rng.normal(0, 0.5, 200)
    rows = [(*map(float, r), float(t)) for r, t in zip(x, y)] + [(None, 1.0, 1.0, 3.0, 1.0), (1.0, 1.0, 1.0, 3.0, None)]
    return x, y, spark.createDataFrame(rows, "a double, b double, c double, flat double, y double").repartition(3)


NAMES = ["a", "b", "c", "flat"]


@pytest.mark.parametrize(("solver", "alpha"), [("linear_regression", 0.0), ("ridge", 3.0)])
def test_fit_equals_numpy(data, solver, alpha):
    x, y, df = data
    model = artefact.LinearEstimator(featureCols=NAMES, labelCol="y", solver=solver, alpha=alpha, k=2).fit(df)
    assert model.selected() == ["a", "b"]  # the constant feature and the noise go
    z = (x[:, :2] - x[:, :2].mean(0)) / x[:, :2].std(0)
    coef = np.linalg.solve(z.T @ z + alpha * np.eye(2), z.T @ (y - y.mean()))
    got = {round(r.a, 9): r.prediction for r in model.transform(df).collect() if r.a is not None and r.b != 1.0}
    for row, want in zip(x, y.mean() + z @ coef):
        assert got[round(row[0], 9)] == pytest.approx(want, rel=1e-9)
    assert [r.prediction for r in model.transform(df).where("a IS NULL").collect()] == [None]


def test_round_trip(spark, data, tmp_path):
    _, _, df = data
    estimator = artefact.LinearEstimator(featureCols=NAMES, labelCol="y", predictionCol="p", solver="lasso", alpha=0.01, k=3)
    estimator.write().save(f"{tmp_path}/e")
    again = artefact.LinearEstimator.load(f"{tmp_path}/e")
    fitted = Pipeline(stages=[again]).fit(df)
    fitted.write().save(f"{tmp_path}/p")
    loaded = PipelineModel.load(f"{tmp_path}/p")
    assert loaded.stages[0].features() == NAMES and len(loaded.stages[0].selected()) == 3
    key = lambda r: str((r.a, r.b))
    assert [r.p for r in sorted(loaded.transform(df).collect(), key=key)] == [r.p for r in sorted(estimator.fit(df).transform(df).collect(), key=key)]


def test_no_rows(data):
    with pytest.raises(ValueError, match="no row"):
        artefact.LinearEstimator(featureCols=["a"], labelCol="y").fit(data[2].where("a < 0"))


def test_temporal_cv(spark):
    sw = SeriesWindow("series", "dt")
    rows = spark.range(100).select(F.when(F.col("id") < 97, "long").otherwise("short").alias("series"), F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("dt"),
                                   F.col("id").cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("target"))
    got = V.temporal_cv(rows, sw, ["x"], "target", {"tree": lambda: DecisionTreeRegressor(maxDepth=2), "line": lambda: LinearRegression(regParam=0.0, solver="normal")}, 3).collect()
    by = {(r.model, r.fold): r for r in got}
    assert set(by) == {(m, f) for m in ("tree", "line") for f in (0, 1, 2, None)}
    # the series of three rows is too short for folds: its rows train only
    for fold, cut in ((0, 25), (1, 49), (2, 73)):
        x, y = np.arange(97.0), np.arange(97.0) % 5
        train = np.concatenate([np.arange(cut), [97, 98, 99]])
        b, a = np.polyfit(train, train % 5, 1)
        e = y[cut:cut + 24] - a - b * x[cut:cut + 24]
        r = by["line", fold]
        assert (r.n_train, r.n) == (cut + 3, 24) and r.mse == pytest.approx((e ** 2).mean()) and r.r2 == pytest.approx(1 - (e ** 2).mean() / y[cut:cut + 24].var())
    assert by["line", None].mse == pytest.approx(np.mean([by["line", f].mse for f in range(3)]))
