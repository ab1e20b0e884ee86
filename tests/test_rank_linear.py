"""Exact quantiles and positions of hot groups; the linear family solved in tasks."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tsengine.frames import SeriesWindow
from tsengine.operators import folds as H
from tsengine.operators import linear as L
from tsengine.operators import models as MD
from tsengine.operators import rank
from tsengine.operators import validate as V

SW = SeriesWindow("series", "dt")


def test_exact_quantiles(spark):
    rng = random.Random(2)
    rows = [("hot", 5.0, None) for _ in range(300)] + [("hot", rng.random() * 10, rng.random()) for _ in range(200)]
    rows += [(None, float(k), -float(k)) for k in range(4)] + [("one", 1.5, 2.5), ("none", None, None)]
    df = spark.createDataFrame(rows, "k string, a double, b double").repartition(5)
    qs = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.k: r for r in rank.exact_quantiles(df, ["k"], ["a", "b"], qs).collect()}
    assert set(got) == {"hot", None, "one", "none"} and got["none"]._q_a == [None] * 5
    for k in ("hot", None, "one"):
        for i, c in ((1, "a"), (2, "b")):
            assert got[k][f"_q_{c}"] == pytest.approx(np.quantile([r[i] for r in rows if r[0] == k and r[i] is not None], qs).tolist())
    whole = rank.exact_quantiles(df, [], ["a"], [0.5]).first()
    assert whole._q_a == pytest.approx([np.median([r[1] for r in rows if r[1] is not None])])
    assert rank.exact_quantiles(df.limit(0), ["k"], ["a"], [0.5]).count() == 0


def test_positions(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("k"), (F.col("id") % 7).alias("v"), "id")
    got = rank.positions(df, ["k"], ["v"]).collect()
    for k in ("hot", "cold"):
        mine = sorted((r for r in got if r.k == k), key=lambda r: r._pos)
        assert [r._pos for r in mine] == list(range(len(mine))) and {r._total for r in mine} == {len(mine)}
        assert [r.v for r in mine] == sorted(r.v for r in mine)


@pytest.mark.parametrize("role", ["test", "train"])
def test_assign_equals_the_range_join(spark, role):
    rows = spark.range(500).select(F.when(F.col("id") % 4 == 0, "a").otherwise("b").alias("series"), F.col("id").alias("dt")).withColumn("row_idx", SW.row_idx())
    folds = H.walk_forward_splits(H.series_counts(rows, SW), ["series"], 40, 9, expanding=False)
    got = sorted((r.series, r.row_idx, r.fold) for r in H.assign(rows, folds, SW, role).collect())
    want = sorted((r.series, i, r.fold) for r in folds.collect() for i in range(r[f"{role}_from"], r[f"{role}_to"]))
    assert got == want


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows = []
    for s, n in (("a", 90), ("b", 45), ("gap", 60)):
        for k in range(n):
            x = rng.normal(0, 1, 3)
            # the first 25 rows of one series have no target: its first folds have nothing to train on
            rows.append((s, k, *map(float, x), None if s == "gap" and k < 25 else float(x @ [1.0, -2.0, 0.5] + rng.normal(0, 0.1))))
    return spark.createDataFrame(rows, "series string, dt int, x0 double, x1 double, x2 double, target double").repartition(4)


X = ["x0", "x1", "x2"]


@pytest.mark.parametrize("window", [None, 2])
def test_walk_forward_solved_in_tasks(table, window):
    models = {"ols": ("linear_regression", {}), "ridge": ("ridge", {"alpha": 2.0}), "lasso": ("lasso", {"alpha": 0.01})}
    got = V.walk_forward_linear(table, SW, X, "target", models, 20, 5, 1, window is None, window).collect()
    rows = {s: sorted((r for r in table.collect() if r.series == s), key=lambda r: r.dt) for s in ("a", "b", "gap")}
    assert len(got) == 3 * sum(len(v) - 21 for v in rows.values())
    for r in got:
        blocks = [0 if i < 20 else (i - 20) // 5 + 1 for i in range(len(rows[r.series]))]
        train = [t for t, b in zip(rows[r.series], blocks, strict=True) if b <= r.fold and (window is None or b > r.fold - window) and t.target is not None]
        if len(train) < 2:
            assert r.pred is None and r.error in ("fewer than two training rows", "no training rows") and r.series == "gap"
            continue
        assert r.error is None and r.converged
        if r.model != "lasso" and len(train) > 4:
            z, y = np.array([[t.x0, t.x1, t.x2] for t in train]), np.array([t.target for t in train])
            c = z - z.mean(0)
            b = np.linalg.solve(c.T @ c + (2.0 if r.model == "ridge" else 0.0) * np.eye(3), c.T @ (y - y.mean()))
            me = rows[r.series][r.row_idx]
            assert r.pred == pytest.approx(y.mean() + (np.array([me.x0, me.x1, me.x2]) - z.mean(0)) @ b, rel=1e-7, abs=1e-7)
    assert any(r.error for r in got)


def test_no_convergence_is_told(table):
    means = L.column_means(table, [*X, "target"])
    gram = L.gram_blocks(table.withColumn("_all", F.lit(0)), X, "target", ["_all"], means)[(0,)]
    assert not L.solve_elastic_net(gram, 1e-6, max_iter=1, tol=0.0).converged and L.solve_elastic_net(gram, 0.1).converged
    assert [f.converged for f in L.solve_elastic_net_batch([gram, gram], [1e-9, 1e9], max_iter=1, tol=1e-12)] == [False, True]


def test_grams_of_many_tasks(spark):
    df = spark.range(0, 4000, 1, 40).select(F.lit(1).alias("g"), F.col("id").cast("double").alias("x"), (F.col("id") * 2).cast("double").alias("y"))
    g = L.gram_blocks(df, ["x"], "y", ["g"])[(1,)]
    n = np.arange(4000.0)
    assert np.allclose(g.G, np.stack([np.ones(4000), n, 2 * n]) @ np.stack([np.ones(4000), n, 2 * n]).T)


def test_no_collect_of_series(spark, table, monkeypatch):
    """The walk-forward of the linear family brings no row of a series or a block to the driver."""
    from pyspark.sql import DataFrame
    seen = []
    monkeypatch.setattr(DataFrame, "collect", lambda self: seen.append(self))
    monkeypatch.setattr(DataFrame, "toPandas", lambda self: seen.append(self))
    V.walk_forward_linear(table, SW, X, "target", {"ols": MD.LINEAR_MODELS["linear_regression"]}, 20, 5)
    assert not seen or all("avg(" in str(df.columns) or len(df.columns) == 4 for df in seen)


def test_bootstrap_draws_from_all_residuals(spark):
    from tsengine.operators import stacking as ST
    rng = np.random.default_rng(4)
    res = [("a", float(v)) for v in rng.normal(0, 3, 5000)] + [("b", float(v)) for v in (-1, 0, 2)] + [("a", None)]
    residuals = spark.createDataFrame(res, "g string, resid double").repartition(4)
    table = {r.g: r._resid for r in ST.residual_ranks(residuals, ["g"]).collect()}
    every = sorted(v for g, v in res if g == "a" and v is not None)
    assert table["b"] == [-1.0, 0.0, 2.0] and table["a"] == [every[i * 4999 // 1023] for i in range(1024)]
    preds = spark.createDataFrame([(g, k, 10.0) for g in ("a", "b") for k in range(200)], "g string, k int, pred double")
    got = ST.bootstrap_interval(preds, residuals, ["g", "k"], ["g"], B=400).collect()
    assert len(got) == 400 and {(r.lower, r.upper) for r in got if r.g == "b"} == {(9.0, 12.0)}
    a = np.array([(r.lower, r.upper) for r in got if r.g == "a"])
    assert np.abs(a.mean(0) - 10 - np.quantile(every, [0.025, 0.975])).max() < 0.25
    assert a.std(0).max() > 0  # rows draw for themselves


def test_fill_over_ranges(spark):
    from tsengine.plans.halo import ffill_global, global_row_index
    rng = random.Random(3)
    rows = [(k, None if rng.random() < 0.9 else float(k), None if k < 400 else 1) for k in range(1000)]
    df = spark.createDataFrame(rows, "t int, a double, b int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.t: (r.a, r.b) for r in ffill_global(df, "t", ["a", "b"]).collect()}
        index = {r.t: r._pos for r in global_row_index(df.withColumn("s", F.lit("x")), SeriesWindow("s", "t")).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    last = None
    for k, a, b in rows:
        last = a if a is not None else last
        assert got[k] == (last, b) and index[k] == k
