"""Univariate feature scoring and selection (F07–F09): one aggregation computes the score of
every feature (per group), ``stack`` unpivots to (feature, score), a window picks the top k."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _unpivot(wide: DataFrame, keys: Sequence[str], cols: Sequence[str], prefix: str) -> DataFrame:
    stack = ", ".join(f"'{c}', `{prefix}{c}`" for c in cols)
    return wide.select(*keys, F.expr(f"stack({len(cols)}, {stack}) as (feature, score)"))


def f_regression_scores(df: DataFrame, features: Sequence[str], target: str = "target",
                        by: Sequence[str] = ()) -> DataFrame:
    """F = r^2 / (1 - r^2) (n - 2), r = corr(x_j, y) over complete rows, one pass for all j."""
    aggs = [F.count(F.lit(1)).alias("_n")] + [F.corr(c, target).alias(f"_r_{c}") for c in features]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    sc = g.select(*by, "_n", *[(F.col(f"_r_{c}") ** 2 / (F.lit(1.0) - F.col(f"_r_{c}") ** 2)
                                * (F.col("_n") - 2)).alias(f"_f_{c}") for c in features])
    return _unpivot(sc, list(by), features, "_f_")


def mutual_info_scores(df: DataFrame, features: Sequence[str], target: str = "target", bins: int = 10,
                       by: Sequence[str] = ()) -> DataFrame:
    """F08 (re-aimed): binned mutual information with equal-width bins on x and y:
    sum p(x,y) ln(p(x,y) / (p(x) p(y))). Counts come from one aggregation per (feature, bin pair)."""
    keys = list(by)
    cols = [*features, target]
    rng = df.groupBy(*keys).agg(*[F.min(c).alias(f"_lo_{c}") for c in cols],
                                *[F.max(c).alias(f"_hi_{c}") for c in cols]) if keys else \
        df.agg(*[F.min(c).alias(f"_lo_{c}") for c in cols], *[F.max(c).alias(f"_hi_{c}") for c in cols])
    j = df.join(rng, keys, "left") if keys else df.crossJoin(F.broadcast(rng))

    def b(c):
        lo, hi = F.col(f"_lo_{c}"), F.col(f"_hi_{c}")
        raw = F.floor((F.col(c) - lo) / (hi - lo) * bins)
        return F.when(hi == lo, F.lit(0)).otherwise(F.least(raw, F.lit(bins - 1))).cast("int")
    binned = j.select(*keys, *[b(c).alias(c) for c in cols])
    stack = ", ".join(f"'{c}', `{c}`" for c in features)
    long = binned.select(*keys, F.col(target).alias("_by"),
                         F.expr(f"stack({len(features)}, {stack}) as (feature, _bx)"))
    long = long.filter(F.col("_bx").isNotNull() & F.col("_by").isNotNull())
    cxy = long.groupBy(*keys, "feature", "_bx", "_by").agg(F.count(F.lit(1)).alias("nxy"))
    wf = Window.partitionBy(*keys, "feature")
    t = cxy.select("*", F.sum("nxy").over(wf).alias("n"),
                   F.sum("nxy").over(Window.partitionBy(*keys, "feature", "_bx")).alias("nx"),
                   F.sum("nxy").over(Window.partitionBy(*keys, "feature", "_by")).alias("ny"))
    term = (F.col("nxy") / F.col("n")) * F.ln(F.col("nxy") * F.col("n") / (F.col("nx") * F.col("ny")))
    return t.groupBy(*keys, "feature").agg(F.sum(term).alias("score"))


def top_k_features(scores: DataFrame, k: int, by: Sequence[str] = ()) -> DataFrame:
    """the k best features (score desc, name asc for ties) per group."""
    w = Window.partitionBy(*by).orderBy(F.col("score").desc_nulls_last(), F.col("feature"))
    return scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
