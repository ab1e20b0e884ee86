"""Ensembles and prediction intervals over long predictions (keys, model, pred).

Row-level combinations are one ``groupBy(keys)`` over the model predictions of a row; model
selection (top-k by CV score) is a small per-group ranking joined back on (group, model).
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsengine.functions.core import ewm_frame_rows


def ensemble_mean(preds: DataFrame, keys: Sequence[str], pred: str = "pred", extra: Sequence[str] = ()) -> DataFrame:
    """Mean over all models of a row."""
    return preds.groupBy(*keys).agg(F.avg(pred).alias("ensemble_pred"), *[F.max(c).alias(c) for c in extra])


def voting(preds: DataFrame, scores: DataFrame, keys: Sequence[str], group: Sequence[str], top: int = 4,
           score: str = "cv_score", lower_is_better: bool = True, pred: str = "pred",
           extra: Sequence[str] = ()) -> DataFrame:
    """Equal-weight mean of the ``top`` models by CV score (per group)."""
    o = F.col(score).asc() if lower_is_better else F.col(score).desc()
    w = Window.partitionBy(*group).orderBy(o, F.col("model"))
    chosen = scores.filter(F.col(score).isNotNull()).withColumn("_rk", F.row_number().over(w)) \
        .filter(F.col("_rk") <= top).select(*group, "model")
    sel = preds.join(chosen, [*group, "model"], "left_semi")
    return sel.groupBy(*keys).agg(F.avg(pred).alias("voting_pred"), F.count(F.lit(1)).alias("n_models"),
                                  *[F.max(c).alias(c) for c in extra])


def interval_percentile(preds: DataFrame, keys: Sequence[str], level: float = 0.95, pred: str = "pred") -> DataFrame:
    """lower/upper = percentiles (1-level)/2 and 1-(1-level)/2 across models, std ddof 0."""
    a = (1.0 - level) / 2.0
    return preds.groupBy(*keys).agg(
        F.avg(pred).alias("mean_pred"), F.percentile(pred, a).alias("lower"),
        F.percentile(pred, 1.0 - a).alias("upper"), F.stddev_pop(pred).alias("std"))


def interval_multi(preds: DataFrame, keys: Sequence[str], levels: Sequence[float] = (0.68, 0.95, 0.99),
                   pred: str = "pred") -> DataFrame:
    """One row per (keys, level): lower, upper, width — one aggregation computes all
    percentiles, ``explode`` of a literal array makes the level rows."""
    qs = []
    for lv in levels:
        a = (1.0 - lv) / 2.0
        qs += [a, 1.0 - a]
    g = preds.groupBy(*keys).agg(F.percentile(pred, F.array(*[F.lit(q) for q in qs])).alias("_q"))
    lv = F.explode(F.array(*[F.struct(F.lit(float(lv)).alias("level"), F.lit(i).alias("i"))
                             for i, lv in enumerate(levels)])).alias("_l")
    e = g.select(*keys, "_q", lv)
    lo = F.element_at(F.col("_q"), (F.col("_l.i") * 2 + 1).cast("int"))
    hi = F.element_at(F.col("_q"), (F.col("_l.i") * 2 + 2).cast("int"))
    return e.select(*keys, F.col("_l.level").alias("level"), lo.alias("lower"), hi.alias("upper"),
                    (hi - lo).alias("width"))


def z_value(level: float) -> float:
    return NormalDist().inv_cdf(1.0 - (1.0 - level) / 2.0)


def interval_normal(preds: DataFrame, keys: Sequence[str], level: float = 0.95, pred: str = "pred") -> DataFrame:
    """Mean +- z std (ddof 0) across models; z from the normal quantile on the driver."""
    z = z_value(level)
    g = preds.groupBy(*keys).agg(F.avg(pred).alias("mean_pred"), F.stddev_pop(pred).alias("std"))
    return g.select(*keys, "mean_pred", "std", (F.col("mean_pred") - F.lit(z) * F.col("std")).alias("lower"),
                    (F.col("mean_pred") + F.lit(z) * F.col("std")).alias("upper"))


def dynamic_weights(update_mse: DataFrame, group: Sequence[str], window: int = 3, rate: float = 0.3,
                    order: str = "update", model: str = "model") -> DataFrame:
    """Per update u, target weights t_u = (1/(mse_u + 1e-8)) normalised over models, with mse
    averaged over the last ``window`` updates; w_u = (1 - r) w_{u-1} + r t_u from equal
    weights, from the second update on (one update alone changes nothing). The recursion is a fold over the (bounded) update history of each (group, model):
    w_u = (1-r)^(u-1) w_0 + sum_{j>1} r (1-r)^(u-j) t_j — expressed with a running list and
    ``aggregate`` (ordered by update)."""
    w = Window.partitionBy(*group, model).orderBy(order)
    m = update_mse.withColumn("_avg_mse", F.avg("mse").over(w.rowsBetween(-(window - 1), 0)))
    inv = F.lit(1.0) / (F.col("_avg_mse") + F.lit(1e-8))
    wg = Window.partitionBy(*group, order)
    m = m.withColumn("_t", inv / F.sum(inv).over(wg)).withColumn("_m", F.count(F.lit(1)).over(wg))
    # (1 - r)^K < 1e-17: older updates cannot change a double weight -> bounded history frame
    k = ewm_frame_rows(rate)
    m = m.withColumn("_u", F.row_number().over(w))
    m = m.withColumn("_h", F.collect_list(F.when(F.col("_u") > 1, F.col("_t"))).over(w.rowsBetween(-k, 0)))
    w0 = F.when(F.col("_u") <= k + 1, F.lit(1.0) / F.col("_m")).otherwise(F.lit(0.0))
    weight = F.aggregate("_h", w0, lambda acc, t: acc * F.lit(1.0 - rate) + F.lit(rate) * t)
    return m.select(*group, model, order, "mse", F.col("_avg_mse").alias("avg_mse"), weight.alias("weight"))
