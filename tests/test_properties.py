"""Properties: no look-ahead, series independence, partition independence, folds, weights,
nested intervals, one window exchange per bundle, halo / bucketed paths equal the direct ones."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from conftest import SF
from tsengine.frames import SeriesWindow
from tsengine.operators import ensemble as E
from tsengine.operators import folds as H
from tsengine.operators import features as W
from tsengine.operators import stacking as ST
from tsengine.plans import bundles, fixtures
from tsengine.plans.halo import blocked_features, ffill_global, global_row_index

SW = SeriesWindow("series", "dt")


def _sorted(df, cols=("series", "dt")):
    return df.orderBy(*cols).toPandas().reset_index(drop=True)


def test_no_look_ahead(spark):
    b = fixtures.bars(spark, SF)
    import datetime
    cut = datetime.datetime(1999, 6, 1)
    base = bundles.engineer_past(b, SW, horizon=1).drop("target")
    changed = b.withColumn("price", F.when(F.col("dt") > cut, F.col("price") * 3.0).otherwise(F.col("price")))
    other = bundles.engineer_past(changed, SW, horizon=1).drop("target")
    a = _sorted(base.filter(F.col("dt") <= cut))
    c = _sorted(other.filter(F.col("dt") <= cut))
    pd.testing.assert_frame_equal(a, c)


def test_series_independence_and_partitions(spark):
    b = fixtures.bars(spark, SF)
    full = _sorted(bundles.quick_features(b, SW).filter(F.col("series") == "1-URGENT"))
    alone = _sorted(bundles.quick_features(b.filter(F.col("series") == "1-URGENT").repartition(3), SW))
    pd.testing.assert_frame_equal(full, alone)


def test_single_window_exchange(spark):
    b = fixtures.bars(spark, SF)
    plan = bundles.engineer_past(b, SW)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan
    # the aggregation building the bars and the window of the bundle share ONE exchange
    assert plan.count("Exchange hashpartitioning") <= 2


def test_folds_disjoint_and_forward(spark):
    c = H.series_counts(fixtures.bars(spark, SF), SW)
    for t in (H.walk_forward_splits(c, ["series"], 50, 10), H.expanding_splits(c, ["series"], 5),
              H.walk_forward_equal(c, ["series"], 5), H.walk_forward_sliding(c, ["series"], 5)):
        p = t.toPandas()
        assert len(p) > 0
        assert (p.train_to <= p.test_from).all() and (p.test_to > p.test_from).all()


def test_blend_weights_simplex(spark):
    rng = np.random.default_rng(0)
    y = rng.normal(size=500)
    pdf = pd.DataFrame({"y": y, "m1": y + rng.normal(0, 0.1, 500), "m2": y + rng.normal(0, 1, 500),
                        "m3": -y})
    w = ST.blend_weights(spark.createDataFrame(pdf), ["m1", "m2", "m3"], "y")
    v = np.array(list(w.values()))
    assert (v >= 0).all() and abs(v.sum() - 1) < 1e-12 and w["m1"] > w["m2"] and w["m3"] == 0


def test_intervals_nest(spark):
    p = fixtures.preds(spark, SF)
    m = E.interval_multi(p, ["series", "dt"]).toPandas()
    piv = m.pivot_table(index=["series", "dt"], columns="level", values=["lower", "upper"])
    assert (piv["lower"][0.99] <= piv["lower"][0.95] + 1e-9).all()
    assert (piv["lower"][0.95] <= piv["lower"][0.68] + 1e-9).all()
    assert (piv["upper"][0.68] <= piv["upper"][0.95] + 1e-9).all()


def test_halo_blocks_equal_direct(spark):
    b = fixtures.bars_one(spark, SF)
    stages = lambda sw: W.rolling_stats(sw, "price", (5, 20), ("mean", "std")) + W.lag_features(sw, "price", (1, 3))
    direct = _sorted(stages(SW).apply(b))
    blocked = blocked_features(b, SW, stages, halo=20, block_rows=97)
    got = _sorted(blocked.select(*direct.columns))
    pd.testing.assert_frame_equal(direct, got, check_exact=False, rtol=1e-12)


def test_global_row_index_and_ffill(spark):
    b = fixtures.bars_one(spark, SF)
    idx = global_row_index(b, SW).orderBy("dt").toPandas()
    assert (idx["_pos"].values == np.arange(len(idx))).all()
    ind = fixtures.indicators(spark, SF)
    from tsengine.operators.joins import pivot_indicators
    wide = pivot_indicators(ind, ["disc", "qty", "ret"])
    got = ffill_global(wide, "dt", ["qty"]).orderBy("dt").toPandas()
    exp = wide.orderBy("dt").toPandas()["qty"].ffill()
    np.testing.assert_allclose(got["qty"].values, exp.values, equal_nan=True)


def test_time_window_filter_reaches_the_scan(spark):
    """S10 on the bars view: the dt predicate is pushed through the aggregation into the parquet
    scan of orders (partition / row-group pruning), and only the needed columns are read."""
    from tsengine.sources.bars import history_window
    df = history_window(fixtures.bars(spark, SF), "2001-01-01 00:00:00", 90)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThanOrEqual(o_orderdate" in plan
    assert "o_custkey" not in plan.split("ReadSchema")[1]


def test_ols_on_columns_of_unlike_magnitude():
    """Least squares from a Gram agrees with numpy's on the rows when columns differ by 1e7."""
    import numpy as np

    from tsengine.operators import linear as L
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 6)) * np.array([1e5, 1e5, 1.0, 1e-2, 1e3, 1.0])
    x[:, 1] = x[:, 0] + rng.normal(size=400)
    y = x @ np.array([2.0, -1.0, 30.0, 500.0, 0.1, -7.0]) + rng.normal(size=400)
    m = np.column_stack([np.ones(400), x - x.mean(0), y - y.mean()])
    fit = L.solve_ridge(L.Gram(m.T @ m), 0.0).shifted(x.mean(0), y.mean())
    want = np.linalg.lstsq(np.column_stack([np.ones(400), x]), y, rcond=None)[0]
    assert np.allclose(x @ fit.coef + fit.intercept, np.column_stack([np.ones(400), x]) @ want, rtol=1e-6, atol=1e-4)


def test_blend_weights_lasso_is_a_non_negative_lasso(spark):
    rng = np.random.default_rng(1)
    y = rng.normal(5, 1, size=400)
    P = np.column_stack([y + rng.normal(0, 0.3, 400), y + rng.normal(0, 0.6, 400), rng.normal(0, 1, 400)])
    df = spark.createDataFrame(pd.DataFrame(P, columns=["m1", "m2", "m3"]).assign(y=y))
    w = np.zeros(3)
    for _ in range(5000):  # coordinate descent on 1 / (2 n) ||Pw - y||^2 + alpha sum(w)
        for j in range(3):
            r = y - P @ w + P[:, j] * w[j]
            w[j] = max(0.0, (P[:, j] @ r - 400 * 0.1) / (P[:, j] @ P[:, j]))
    got = ST.blend_weights(df, ["m1", "m2", "m3"], "y", "lasso")
    np.testing.assert_allclose(list(got.values()), w / w.sum(), rtol=1e-6, atol=1e-9)


def test_temporal_stack_fits_on_meta_rows_alone(spark):
    rng = np.random.default_rng(2)
    n, cut = 300, 200
    X, p = rng.normal(3, 2, (n, 2)), rng.normal(0, 1, n)
    y = 2 * p + X @ [0.5, -1.0] + rng.normal(0, 0.1, n)
    df = spark.createDataFrame(pd.DataFrame({"i": range(n), "p": p, "a": X[:, 0], "b": X[:, 1], "y": y}))
    got = ST.temporal_stack(df, ["p"], ["a", "b"], F.col("i") < cut).orderBy("i").toPandas()
    Z = np.column_stack([p, (X - X[:cut].mean(0)) / X[:cut].std(0)])
    c = Z[:cut] - Z[:cut].mean(0)
    beta = np.linalg.solve(c.T @ c + np.eye(3), c.T @ (y[:cut] - y[:cut].mean()))
    np.testing.assert_allclose(got.stack_pred, y[:cut].mean() + (Z[cut:] - Z[:cut].mean(0)) @ beta, rtol=1e-7)


def test_a_fold_that_fails_keeps_its_rows_and_the_reason(spark):
    from tsengine.operators import models as MD
    from tsengine.operators import validate as V
    q = bundles.quick_features(fixtures.bars(spark, SF), SW)
    out = V.walk_forward_ml(q, SW, ["ma_5"], "target", lambda: MD.random_forest(numTrees=1, maxDepth=1, maxBins=2, featureSubsetStrategy="none"),
                            initial=150, step=1000, name="rf")
    r = out.agg(F.count(F.lit(1)).alias("n"), F.count("pred").alias("p"), F.count("error").alias("e")).first()
    assert r.n > 0 and r.p == 0 and r.e == r.n
