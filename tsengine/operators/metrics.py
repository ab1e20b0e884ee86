"""Regression metrics and model comparison (A08–A18). All are ``groupBy`` aggregations over
a (keys, y, pred) table: map-side partials, one shuffle on the group key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsengine.functions.core import safe_div

# fixed values: model families of the reference's comparison report
FAMILIES = {
    "linear": ["lasso", "ridge", "elastic_net"],
    "tree": ["random_forest", "xgboost", "lightgbm", "gradient_boosting"],
}
#: Types of this library's other models; the report tells deep and ensemble models by their type.
TYPES = {
    "deep": ["lstm", "gru", "transformer"],
    "ensemble": ["voting", "stacking", "blending", "dynamic_ensemble"],
    "baseline": ["lag1", "sma5", "sma20"],
}


def metric_aggs(y: str = "y", pred: str = "pred") -> list[Column]:
    e = F.col(y) - F.col(pred)
    n = F.count(F.lit(1))
    sse = F.sum(e * e)
    sst = F.var_pop(y) * n
    return [n.alias("n"), (sse / n).alias("mse"), F.avg(F.abs(e)).alias("mae"),
            F.when(sst > 0, F.lit(1.0) - sse / sst).otherwise(F.lit(0.0)).alias("r2"),
            F.sqrt(sse / n).alias("rmse")]


def regression_metrics(df: DataFrame, keys: Sequence[str], y: str = "y", pred: str = "pred") -> DataFrame:
    """N, MSE, MAE, R^2 = 1 - SSE/SST (0 when SST = 0), RMSE per key."""
    return df.groupBy(*keys).agg(*metric_aggs(y, pred))


def fold_metrics(df: DataFrame, keys: Sequence[str], folds: DataFrame | None = None,
                 y: str = "y", pred: str = "pred") -> DataFrame:
    """A08 per (keys, fold), with the fold's train/test sizes when a fold table is given."""
    m = regression_metrics(df, [*keys, "fold"], y, pred)
    if folds is None:
        return m
    shared = [c for c in folds.columns if c in keys] + ["fold"]
    return m.join(folds.select(*shared, "train_size", "test_size"), shared, "left")


def fold_statistics(fm: DataFrame, keys: Sequence[str]) -> DataFrame:
    """A10: mean and std (ddof 1) of fold R^2 / RMSE / MAE, successful and total folds."""
    return fm.groupBy(*keys).agg(
        F.avg("r2").alias("r2_mean"), F.stddev_samp("r2").alias("r2_std"),
        F.avg("rmse").alias("rmse_mean"), F.stddev_samp("rmse").alias("rmse_std"),
        F.avg("mae").alias("mae_mean"), F.stddev_samp("mae").alias("mae_std"),
        F.count("r2").alias("successful_folds"), F.count(F.lit(1)).alias("total_folds"),
        (F.count("r2") / F.count(F.lit(1))).alias("success_rate"))


def cv_score(fm: DataFrame, keys: Sequence[str], score: str = "mse") -> DataFrame:
    """Mean and std (ddof 0) of the fold scores."""
    return fm.groupBy(*keys).agg(F.avg(score).alias("cv_score"), F.stddev_pop(score).alias("cv_std"))


def walk_forward_summary(scored: DataFrame, fm: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pooled metrics over all predicted test rows + fold statistics, one row per model. Rows of
    folds without a fit have no prediction: they count in ``total_folds`` alone."""
    pooled = regression_metrics(scored.where(F.col("pred").isNotNull()), keys)
    return pooled.join(fold_statistics(fm, keys), list(keys), "left")


def best_model(df: DataFrame, group: Sequence[str], metric: str = "r2", model: str = "model",
               maximize: bool = True) -> DataFrame:
    """Arg-best model per group ignoring NULL metrics; of equals the last by model name."""
    v = df.filter(F.col(metric).isNotNull())
    key = F.struct(F.col(metric) if maximize else -F.col(metric), F.col(model))
    pick = F.max_by(F.struct(F.col(model).alias("best_model"), F.col(metric).alias(f"best_{metric}")), key)
    g = v.groupBy(*group).agg(pick.alias("_b"))
    return g.select(*group, "_b.best_model", f"_b.best_{metric}")


def best_by_category(df: DataFrame, group: Sequence[str], category: str = "model_type",
                     metric: str = "r2", model: str = "model") -> DataFrame:
    """Best per category (row_number by metric desc), overall best = rank 1 of those."""
    w = Window.partitionBy(*group, category).orderBy(F.col(metric).desc(), F.col(model))
    best = df.filter(F.col(metric).isNotNull()).withColumn("_rn", F.row_number().over(w)).filter("_rn = 1")
    wo = Window.partitionBy(*group).orderBy(F.col(metric).desc(), F.col(model))
    return best.select(*group, category, model, metric,
                       (F.row_number().over(wo) == 1).alias("is_overall_best"))


def leaderboard(results: DataFrame, by: str) -> DataFrame:
    """Per method or model type: mean/std/max R^2, mean/std/min RMSE, mean MAE, count
    (rounded to 4 digits)."""
    return results.groupBy(by).agg(
        F.round(F.avg("r2"), 4).alias("r2_mean"), F.round(F.stddev_samp("r2"), 4).alias("r2_std"),
        F.round(F.max("r2"), 4).alias("r2_max"), F.round(F.avg("rmse"), 4).alias("rmse_mean"),
        F.round(F.stddev_samp("rmse"), 4).alias("rmse_std"), F.round(F.min("rmse"), 4).alias("rmse_min"),
        F.round(F.avg("mae"), 4).alias("mae_mean"), F.count(F.lit(1)).alias("count"))


def leaderboards_one_pass(results: DataFrame, dims: Sequence[str] = ("method", "model_type")) -> DataFrame:
    """A15 for several dimensions in ONE aggregation (grouping sets)."""
    sets = ", ".join(f"({d})" for d in dims)
    results.createOrReplaceTempView("_lb_results")
    return results.sparkSession.sql(
        f"""SELECT {', '.join(dims)}, grouping_id() AS gid,
        round(avg(r2), 4) AS r2_mean, round(stddev_samp(r2), 4) AS r2_std, round(max(r2), 4) AS r2_max,
        round(avg(rmse), 4) AS rmse_mean, round(stddev_samp(rmse), 4) AS rmse_std, round(min(rmse), 4) AS rmse_min,
        round(avg(mae), 4) AS mae_mean, count(*) AS count
        FROM _lb_results GROUP BY GROUPING SETS ({sets})""")


def top_n(df: DataFrame, metric: str, n: int = 5, largest: bool = True, tiebreak: Sequence[str] = ()) -> DataFrame:
    """Nlargest / nsmallest (TakeOrderedAndProject — a top-k per task, then merged)."""
    o = F.col(metric).desc() if largest else F.col(metric).asc()
    return df.filter(F.col(metric).isNotNull()).orderBy(o, *[F.col(c) for c in tiebreak]).limit(n)


def stability_score(results: DataFrame) -> DataFrame:
    """-cv_std / (|cv_score| + 1e-6) for rows with a cv score."""
    v = results.filter(F.col("cv_score").isNotNull() & F.col("cv_std").isNotNull())
    return v.withColumn("stability", -F.col("cv_std") / (F.abs(F.col("cv_score")) + F.lit(1e-6)))


def family_of(model: Column) -> Column:
    expr = None
    for fam, names in (FAMILIES | TYPES).items():
        cond = model.isin(*names)
        expr = F.when(cond, F.lit(fam)) if expr is None else expr.when(cond, F.lit(fam))
    return expr.otherwise(F.lit("other"))


def family_insight(results: DataFrame, model: str = "model") -> DataFrame:
    """Per family: best model (by R^2), best and average R^2, count."""
    r = results.withColumn("family", family_of(F.col(model)))
    return r.groupBy("family").agg(
        F.max_by(F.col(model), F.struct(F.col("r2"), F.col(model))).alias("best_model"),
        F.max("r2").alias("best_r2"), F.avg("r2").alias("avg_r2"), F.count(F.lit(1)).alias("models"))


def mean_importance(scores: DataFrame, feature: str = "feature", score: str = "score", n: int = 20,
                    rescale_by: str | None = None) -> DataFrame:
    """Per feature mean, std (ddof 0) and count of |score| over models, top n by mean. With
    ``rescale_by`` (the model column) each model's scores are first scaled to sum 1."""
    if rescale_by is not None:
        scores = scores.withColumn(score, safe_div(F.abs(score), F.sum(F.abs(score)).over(Window.partitionBy(rescale_by))))
    g = scores.groupBy(feature).agg(F.avg(F.abs(score)).alias("mean_importance"),
                                    F.stddev_pop(F.abs(score)).alias("std_importance"),
                                    F.count(F.lit(1)).alias("models"))
    return g.orderBy(F.col("mean_importance").desc(), F.col(feature)).limit(n)


def ratio(a: Column, b: Column) -> Column:
    return safe_div(a, b)
