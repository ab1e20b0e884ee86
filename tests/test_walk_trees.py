"""Walk-forward evaluation of tree models: every fold, failed folds, agreement with single fits."""

from __future__ import annotations

import pytest
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.sql import functions as F

from tsengine.frames import SeriesWindow
from tsengine.operators import fits
from tsengine.operators import validate as V

SW = SeriesWindow("series", "dt")


@pytest.fixture(scope="module")
def table(spark):
    rows = spark.range(120).select(
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("series"), F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("dt"),
        (F.col("id") % 7).cast("double").alias("x1"), F.sin("id").alias("x2"))
    return rows.withColumn("target", F.col("x1") * 2 + F.col("x2")).cache()


def walk(table, models, path, **kw):
    return V.walk_forward_trees(table, SW, ["x1", "x2"], "target", models, str(path), **{"initial": 20, "step": 10, **kw})


def test_every_fold(spark, table, tmp_path):
    got = walk(table, {"tree": lambda: DecisionTreeRegressor(maxDepth=4, seed=1), "line": lambda: LinearRegression(regParam=0.0)}, tmp_path / "w").collect()
    # series a has 40 rows, b 80: rows from 20 up to the last but one
    assert len(got) == 2 * (19 + 59) and len({(r.series, r.row_idx, r.model) for r in got}) == len(got)
    assert all(r.fold == (r.row_idx - 20) // 10 and r.error is None for r in got)
    assert all(abs(r.pred - r.y) < 1e-6 for r in got if r.model == "line")
    data = fits.fit_table(V.with_walk_forward_blocks(table, SW, 20, 10), ["x1", "x2"], "target", ["series", "row_idx", "_blk", "fold"])
    one = fits.ready(DecisionTreeRegressor(maxDepth=4, seed=1)).fit(data.where("_blk <= 2")).transform(data.where("fold = 2"))
    assert {(r.series, r.row_idx): r.pred for r in one.collect()} == {(r.series, r.row_idx): r.pred for r in got if r.model == "tree" and r.fold == 2}


def test_rolling_window(table, tmp_path):
    lines = {"line": lambda: LinearRegression()}
    late = table.withColumn("target", F.when(F.col("dt") < "1970-02-10", F.lit(1e6)).otherwise(F.col("target")))
    wide = {(r.series, r.row_idx): r.pred for r in walk(late, lines, tmp_path / "e").collect()}
    near = {(r.series, r.row_idx): r.pred for r in walk(late, lines, tmp_path / "r", window_blocks=1).collect()}
    assert wide.keys() == near.keys() and wide[("b", 78)] > 1000 > near[("b", 78)]


def test_failed_folds_stay(table, tmp_path):
    # two categories are too many for one bin: Spark refuses the fit, not the estimator
    got = walk(table, {"bad": lambda: DecisionTreeRegressor(maxBins=2, maxDepth=31), "tree": lambda: DecisionTreeRegressor(maxDepth=2)}, tmp_path / "f")
    rows = got.collect()
    assert {(r.model, r.pred is None, r.error is None) for r in rows} == {("bad", True, False), ("tree", False, True)}
    out = {(r.model, r.series, r.fold): r for r in V.evaluation(got, ["series"]).collect()}
    assert out["bad", "b", 0].r2 is None and "Depth" in out["bad", "b", 0].error
    assert (out["bad", "b", None].successful_folds, out["bad", "b", None].total_folds) == (0, 6) if ("bad", "b", None) in out else True
    assert (out["tree", "b", None].successful_folds, out["tree", "b", None].total_folds) == (6, 6)
    fold = [r for r in rows if r.model == "tree" and r.series == "a" and r.fold == 1]
    assert abs(out["tree", "a", 1].mse - sum((r.y - r.pred) ** 2 for r in fold) / len(fold)) < 1e-12


def test_errors_of_the_caller_are_raised(table, tmp_path):
    with pytest.raises(TypeError):
        walk(table, {"x": lambda: DecisionTreeRegressor(no_such=1)}, tmp_path / "x")


def test_no_folds(table, tmp_path):
    assert walk(table, {"x": lambda: DecisionTreeRegressor()}, tmp_path / "n", initial=500).count() == 0


def test_registered_walk_reads_its_input_once(spark, monkeypatch):
    from tests.conftest import SF01
    from tsengine.plans import queries_models as Q
    tables = []
    monkeypatch.setattr(Q, "_walks", {})
    monkeypatch.setattr(Q, "WALK_TREES", {"random_forest": lambda: DecisionTreeRegressor(maxDepth=2, seed=1), "gradient_boosting": lambda: DecisionTreeRegressor(maxDepth=1, seed=1)})
    quick = Q._quick
    monkeypatch.setattr(Q, "_quick", lambda *a: tables.append(quick(*a)) or tables[-1])
    rows, metrics = Q.q_wf_tree_rows(spark, SF01), Q.q_wf_trees(spark, SF01)
    assert len(tables) == 1 and not any("orders.parquet" in f for d in (rows, metrics) for f in d.inputFiles())
    n = tables[0].count()
    assert 0 < rows.count() == 2 * (n - 5 * 253) and rows.where("NOT fitted OR NOT in_range").count() == 0  # first year, last row
    assert metrics.where("fold IS NULL").count() == 10
