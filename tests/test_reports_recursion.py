"""Report folders of mixed layouts, and the recursive ensemble against numpy."""

from __future__ import annotations

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsengine.operators import recursion as RC
from tsengine.sources import reports


def put(folder, name, text, age):
    (folder / name).write_text(text)
    os.utime(folder / name, (1_700_000_000 - age,) * 2)


def test_newest_of_each_kind(spark, tmp_path):
    put(tmp_path, "optimized_training_results_1.json", json.dumps({"model_results": {"old": {"r2": 9}}}), 50)
    put(tmp_path, "optimized_training_results_0.json", '{"model_results": {"ridge": {"r2": NaN, "rmse": 2, "mae": "1.5"}, "odd": {"r2": [1, -Infinity]}}, "ensemble_results": {}}', 10)
    put(tmp_path, "deep_learning_results_2.json", '{"validation_results": {"lstm": {"r2": 0.5, "test_r2": 0.25}}, "note": "NaN: NaN, stays"}', 10)
    put(tmp_path, "deep_learning_results_1.json", "{}", 10)  # as old: the name decides
    put(tmp_path, "walk_forward_results_1.json", "no json", 1)
    put(tmp_path, "walk_forward_summary_1.csv", 'Model,Overall_R2,Overall_MAE,Std_Fold_R2\n"a, b",0.5,nan,\nlasso,,inf,0.1\n', 1)
    put(tmp_path, "walk_forward_summary_1.json", "{}", 0)
    put(tmp_path, "notes.txt", "x", 0)
    (tmp_path / "deep").mkdir()
    sets = reports.read_result_sets(spark, str(tmp_path))
    names = {(r.kind, r.name) for r in sets.select("kind", "name").distinct().collect()}
    assert names == {("optimized_training", "optimized_training_results_0.json"), ("deep_learning", "deep_learning_results_2.json"),
                     ("walk_forward", "walk_forward_results_1.json"), ("walk_forward_summary", "walk_forward_summary_1.csv")}
    assert sets.where("kind = 'walk_forward'").select(F.col("doc").isNull()).first()[0]
    got = {(r.section, r.model): tuple(r)[4:] for r in reports.explode_result_sets(sets).collect() if r.model is not None}
    assert got == {("model_results", "ridge"): (None, 2.0, 1.5, None, None), ("model_results", "odd"): (None,) * 5, ("validation_results", "lstm"): (0.5,) + (None,) * 4,
                   ("rows", "a, b"): (0.5,) + (None,) * 4, ("rows", "lasso"): (None, None, None, None, 0.1)}


def test_empty_folder(spark, tmp_path):
    put(tmp_path, "notes.txt", "x", 0)
    sets = reports.read_result_sets(spark, str(tmp_path))
    assert sets.count() == 0 and reports.explode_result_sets(sets).count() == 0


def features(p):
    p = np.asarray(p)
    return np.array([p[-5:].mean(), p[-10:].mean(), p[-20:].mean(), p[-1] / p[-2] - 1, p[-1] / p[-6] - 1, p[-10:].std(ddof=1), p[-2], p[-3], p[-4]])


def test_ensemble_forecast(spark):
    rng = np.random.default_rng(3)
    rows, models = [], []
    for s in "ab":
        prices = 100 + rng.normal(0, 5, 60).cumsum()
        rows += [(s, f"2024-01-{1 + k % 28:02d}" if k < 28 else f"2024-0{2 + (k - 28) // 28}-{1 + (k - 28) % 28:02d}", float(p)) for k, p in enumerate(prices)]
        models += [(s, [(f"m{k}", float(rng.normal(0, 3)), [float(x) for x in rng.normal(0, 0.15, 9)]) for k in range(5)])]
    rows += [("short", f"2024-01-{k:02d}", 1.0) for k in range(1, 11)] + [("a", "2024-03-30", None)]
    bars = spark.createDataFrame(rows, "series string, d string, price double").withColumn("dt", F.to_timestamp("d").cast("timestamp_ntz"))
    fits = spark.createDataFrame(models + [("short", [])], "series string, models array<struct<name:string,intercept:double,coef:array<double>>>")
    tails = RC.tails(bars, ["series"], RC.QUICK_TAIL)
    assert {r.series for r in tails.collect()} == {"a", "b"}
    got = RC.ensemble_forecast(tails.join(fits, "series", "left"), ["series"], RC.QUICK, 40, 0.9).orderBy("series", "step").collect()
    assert len(got) == 80
    for s, ms in models:
        p = [r[2] for r in sorted(rows) if r[0] == s and r[2] is not None][-20:]
        for r in (r for r in got if r.series == s):
            v = np.array([a + np.dot(b, features(p)) for _, a, b in ms])
            assert r.forecast == pytest.approx(v.mean(), rel=1e-9) and r.std == pytest.approx(v.std(), rel=1e-9)
            assert r.upper - r.forecast == pytest.approx(1.6448536269514722 * v.std(), rel=1e-9)
            p = p[1:] + [v.mean()]


def test_top_models_are_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (50, 2))
    y = 3 * x[:, 0] + 1 + rng.normal(0, 0.1, 50)
    df = spark.createDataFrame([("a", float(p), float(q), float(r), 7.0) for (p, q), r in zip(x, y)], "series string, u double, v double, y double, flat double")
    m = RC.top_models(df, ["series"], ["u", "v", "flat"], "y", 5).first().models
    assert [k.name for k in m] == ["u", "v"]  # a constant feature has no fit
    b, a = np.polyfit(x[:, 0], y, 1)
    assert m[0].intercept == pytest.approx(a) and m[0].coef == pytest.approx([b, 0.0, 0.0])
