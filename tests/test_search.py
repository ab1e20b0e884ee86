"""Successive halving: who goes on, what is reported, agreement with plain cross-validation."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tsengine.frames import SeriesWindow
from tsengine.operators import models as MD
from tsengine.operators import search as SR
from tsengine.operators import validate as V

SW = SeriesWindow("series", "dt")


def test_draw(spark):
    a, b = SR.draw("random_forest", 20), SR.draw("random_forest", 20)
    assert a == b and a != SR.draw("random_forest", 20, 7) and len({json.dumps(v[1]) for v in a.values()}) == 20
    for kind in SR.RANGES:
        for k, params in SR.draw(kind, 5).values():
            MD.estimator(k, **params)


def test_halving(spark):
    df = spark.range(160).select(F.lit("s").alias("series"), F.timestamp_seconds(F.col("id") * 86400).cast("timestamp_ntz").alias("dt"),
                                 (F.col("id") % 8).cast("double").alias("x"), F.sin("id").alias("noise"))
    df = df.withColumn("target", F.when(F.col("x") < 4, F.col("x")).otherwise(-F.col("x")))
    deep = {f"deep_{k}": ("random_forest", {"numTrees": 3, "maxDepth": 5, "seed": k, "featureSubsetStrategy": "all"}) for k in range(3)}
    flat = {f"flat_{k}": ("random_forest", {"numTrees": 1, "maxDepth": 0, "seed": k}) for k in range(5)}
    bad = {"bad": ("random_forest", {"maxDepth": 31})}
    got = {r.trial: r for r in SR.successive_halving(df, SW, ["x", "noise"], "target", {**flat, **deep, **bad}, 3).collect()}
    assert len(got) == 9 and got["bad"].status == "failed" and "Depth" in got["bad"].error and got["bad"].rung == 0
    assert all((got[t].rung, got[t].status) == (1, "stopped") for t in flat)
    assert sorted(got[t].rung for t in deep) == [2, 2, 3]  # of eight three go on, of three one
    best = [r for r in got.values() if r.best]
    assert len(best) == 1 and best[0].status == "finished" and best[0].trial in deep
    kind, params = deep[best[0].trial]
    cv = V.temporal_cv(df, SW, ["x", "noise"], "target", {"t": lambda: MD.estimator(kind, **params)}, 3).where("fold IS NULL").first()
    assert abs(cv.mse - best[0].mse) < 1e-12 and abs(cv.r2 - best[0].r2) < 1e-12
    assert SR.successive_halving(df.limit(0), SW, ["x", "noise"], "target", flat, 3).where("rung = 0 AND status = 'stopped' AND NOT best").count() == 5
