"""Walk-forward evaluation of many models.

Linear family: fold-blocked Gram (one data pass) + one scoring pass, for every model and alpha at
once. Tree models: one Spark ML fit per fold on the cached feature table (the fold loop runs on
the driver; every fit is distributed).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsengine.frames import SeriesWindow
from tsengine.operators import fits
from tsengine.operators import linear as L
from tsengine.operators import metrics as M
from tsengine.session import cut_lineage


def with_walk_forward_blocks(df: DataFrame, sw: SeriesWindow, initial: int, step: int, horizon: int = 1) -> DataFrame:
    """Row position, block id (block 0 = first ``initial`` rows, then one block per step) and the
    test fold of the row (NULL outside any test window)."""
    idx, n = sw.row_idx(), sw.n_rows()
    t = df.select("*", idx.alias("row_idx"), n.alias("_n"))
    blk = F.when(F.col("row_idx") < initial, F.lit(0)).otherwise(
        F.floor((F.col("row_idx") - initial) / step) + 1).cast("int")
    fold = F.when((F.col("row_idx") >= initial) & (F.col("row_idx") < F.col("_n") - horizon), blk - 1)
    return t.withColumn("_blk", blk).withColumn("fold", fold.cast("long"))


def walk_forward_linear(df: DataFrame, sw: SeriesWindow, features: Sequence[str], target: str,
                        models: dict[str, tuple[str, dict]], initial: int = 252, step: int = 21,
                        horizon: int = 1, expanding: bool = True, window_blocks: int | None = None) -> DataFrame:
    """Predictions (keys, dt, row_idx, fold, model, y, pred, error, converged) of every linear model on
    every walk-forward test row. ``models``: name -> (solver, params) with solver in
    :data:`linear.SOLVERS`. Folds are fitted where their series' Grams are. The rows of a fold without a fit stay,
    with a null ``pred`` and the reason in ``error``; ``converged`` is false where an iteration reached its limit."""
    # the feature table is read by several jobs (means, Grams, scoring): cut its lineage once into
    # the shared checkpoint folder (reliable: survives executor loss; later plans stay small)
    b = cut_lineage(with_walk_forward_blocks(df, sw, initial, step, horizon))
    means = L.column_means(b, [*features, target])
    last = b.groupBy(*sw.series_cols).agg(F.max("fold").alias("_last"))
    grams = L.gram_table(b, features, target, [*sw.series_cols, "_blk"], means).join(last, list(sw.series_cols))
    coefs = L.fold_fits(grams, sw.series_cols, "_blk", "_last", models, features, target, means, None if expanding else window_blocks)
    test = b.filter(F.col("fold").isNotNull()).select(*sw.series_cols, sw.time_col, "row_idx", "fold",
                                                      F.col(target).alias("y"), *features)
    test = test.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models])))
    scored = L.score(test, cut_lineage(coefs), [*sw.series_cols, "fold", "model"], features, how="left")
    error = F.when(F.col("n").isNull(), F.lit("no training rows")).otherwise(F.col("error"))
    return scored.select(*sw.series_cols, sw.time_col, "row_idx", "fold", "model", "y", "pred", error.alias("error"), "converged")


def expanding_linear(df: DataFrame, sw: SeriesWindow, features: Sequence[str], target: str, models: dict[str, tuple[str, dict]], k: int = 5) -> DataFrame:
    """Out-of-fold predictions (keys, dt, row_idx, fold, model, y, pred) of the linear family on the k expanding folds
    of H03, pooled over series; rows before the first test block have none."""
    b = cut_lineage(with_expanding_blocks(df, sw, k))
    means = L.column_means(b, [*features, target])
    grams = L.gram_table(b.withColumns({"_all": F.lit(0), "_last": F.lit(k - 1).cast("long")}), features, target, ["_all", "_last", "_blk"], means)
    coefs = cut_lineage(L.fold_fits(grams, ["_all"], "_blk", "_last", models, features, target, means).drop("_all"))
    test = b.where(F.col("_blk") > 0).select(*sw.series_cols, sw.time_col, "row_idx", (F.col("_blk") - 1).cast("long").alias("fold"), F.col(target).alias("y"), *features)
    scored = L.score(test.withColumn("model", F.explode(F.array(*[F.lit(m) for m in models]))), coefs, ["fold", "model"], features, how="left")
    return scored.select(*sw.series_cols, sw.time_col, "row_idx", "fold", "model", "y", "pred")


def holdout_linear(df: DataFrame, sw: SeriesWindow, features: Sequence[str], target: str,
                   models: dict[str, tuple[str, dict]], test_frac: float = 0.2) -> tuple[DataFrame, dict]:
    """H01 + linear family: fit on the first 80 % of every series (pooled Gram over series),
    predict the rest. Returns (predictions, fits)."""
    idx, n = sw.row_idx(), sw.n_rows()
    t = df.select("*", idx.alias("row_idx"), n.alias("_n"))
    t = cut_lineage(t.withColumn("_blk", (F.col("row_idx") >= F.floor(F.col("_n") * (1 - test_frac))).cast("int")))
    means = L.column_means(t.filter("_blk = 0"), [*features, target])
    blocks = L.gram_blocks(t, features, target, ["_blk"], means)
    g = blocks[(0,)]
    shift = np.array([means[c] for c in features])
    fits = {(name,): L.SOLVERS[s](g, p).shifted(shift, means[target]) for name, (s, p) in models.items()}
    coefs = L.coefficient_table(df.sparkSession, fits, ["model"], features)
    test = t.filter("_blk = 1").select(*sw.series_cols, sw.time_col, "row_idx", F.col(target).alias("y"), *features)
    # one row a model: the coefficients are what is broadcast, never the test rows
    scored = L.score(test.withColumn("_one", F.lit(1)), F.broadcast(coefs.withColumn("_one", F.lit(1))), ["_one"], features)
    return scored.select(*sw.series_cols, sw.time_col, "row_idx", "model", "y", "pred"), fits


def walk_forward_ml(df: DataFrame, sw: SeriesWindow, features: Sequence[str], target: str, estimator_factory,
                    initial: int = 252, step: int = 21, horizon: int = 1, max_folds: int | None = None,
                    name: str = "model") -> DataFrame:
    """Tree / other Spark ML estimators: one fit per fold (pooled over series, expanding),
    predictions on that fold's test rows. The test rows of a fold whose fit fails stay, with a null
    prediction and the reason in ``error``: A10 counts that fold as unsuccessful."""
    from pyspark.ml.feature import VectorAssembler
    b = with_walk_forward_blocks(df, sw, initial, step, horizon)
    va = VectorAssembler(inputCols=list(features), outputCol="_features", handleInvalid="skip")
    data = va.transform(b.filter(F.col(target).isNotNull())).select(
        *sw.series_cols, sw.time_col, "row_idx", "_blk", "fold", F.col(target).alias("y"), "_features")
    data = cut_lineage(data)
    n_folds = data.agg(F.max("fold")).first()[0]
    n_folds = 0 if n_folds is None else int(n_folds) + 1
    if max_folds is not None:
        n_folds = min(n_folds, max_folds)
    outs = []
    for f in range(n_folds):
        train = data.filter(F.col("_blk") <= f)
        test = data.filter(F.col("fold") == f)
        try:
            model = estimator_factory().setFeaturesCol("_features").setLabelCol("y").setPredictionCol("pred").fit(train)
            scored, error = model.transform(test), None
        except Exception as e:  # noqa: BLE001 - the fold's rows carry the reason
            scored, error = test.withColumn("pred", F.lit(None).cast("double")), f"{type(e).__name__}: {e}"[:500]
        outs.append(scored.select(*sw.series_cols, sw.time_col, "row_idx", "fold", F.lit(name).alias("model"), "y", "pred",
                                  F.lit(error).cast("string").alias("error")))
    if not outs:
        return data.limit(0).select(*sw.series_cols, sw.time_col, "row_idx", "fold", F.lit(name).alias("model"),
                                    "y", F.lit(None).cast("double").alias("pred"), F.lit(None).cast("string").alias("error"))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o)
    return out


def walk_forward_trees(df: DataFrame, sw: SeriesWindow, features: Sequence[str], target: str, models: dict, path: str,
                       initial: int = 252, step: int = 21, horizon: int = 1, window_blocks: int | None = None,
                       parallel: int = fits.PARALLEL) -> DataFrame:
    """H10 for estimators that need a fit a fold: ``models`` maps names to estimator factories. All
    folds of all models are fitted side by side over one written table; a fold's training rows are the
    blocks before its own (the last ``window_blocks`` of them: rolling), pooled over series, its
    predictions are written to ``path`` when its fit has ended. The rows of a fold whose fit fails
    are there too, with a null ``pred`` and the reason in ``error``."""
    spark = df.sparkSession
    keys = [*sw.series_cols, sw.time_col, "row_idx"]
    data = fits.fit_table(with_walk_forward_blocks(df, sw, initial, step, horizon), features, target, [*keys, "_blk", "fold"])
    last = data.agg(F.max("fold")).first()[0]

    def run(name: str, fold: int) -> None:
        estimator = fits.ready(models[name]())
        before = (F.col("_blk") <= fold) & (F.lit(True) if window_blocks is None else F.col("_blk") > fold - window_blocks)
        test = data.where(F.col("fold") == fold)
        try:
            scored = estimator.fit(data.where(before)).transform(test).withColumn("error", F.lit(None).cast("string"))
        except fits.FIT_ERRORS as e:
            reason = str(getattr(e, "java_exception", e)).splitlines()[0]
            scored = test.withColumns({"pred": F.lit(None).cast("double"), "error": F.lit(reason)})
        scored.select(*keys, F.lit(name).alias("model"), F.lit(fold).cast("long").alias("fold"), "y", "pred", "error") \
            .write.mode("overwrite").parquet(f"{path}/{name}/{fold}")

    jobs = {(m, f): (lambda m=m, f=f: run(m, f)) for f in range(-1 if last is None else int(last), -1, -1) for m in models}
    fits.together(spark, jobs, parallel)
    return read_walk(spark, path, df, sw) if jobs else read_walk(spark, None, df, sw)


def read_walk(spark, path: str | None, df: DataFrame, sw: SeriesWindow) -> DataFrame:
    """What :func:`walk_forward_trees` wrote of ``df``; without a path, no rows."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields} | {"row_idx": "bigint"}
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*sw.series_cols, sw.time_col, "row_idx")), "model string, fold long, y double, pred double, error string"])
    if path is None:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)


def evaluation(preds: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Metrics of every fold and, with a null fold, over all predicted rows of ``keys`` and model; the
    latter with mean and deviation over folds, successful and total folds."""
    folds = M.regression_metrics(preds, [*keys, "model", "fold"])
    folds = folds.join(preds.groupBy(*keys, "model", "fold").agg(F.max("error").alias("error")), [*keys, "model", "fold"])
    pooled = M.walk_forward_summary(preds, folds, [*keys, "model"]).withColumn("fold", F.lit(None).cast("long"))
    return folds.unionByName(pooled, allowMissingColumns=True)


def with_expanding_blocks(df: DataFrame, sw: SeriesWindow, k: int) -> DataFrame:
    """H03 as blocks: ``_blk`` 0 before the first test rows of the series, i + 1 in those of fold i. Fold i
    trains on the blocks up to i. A series shorter than k + 1 rows has no test rows."""
    t = df.select("*", sw.row_idx().alias("row_idx"), sw.n_rows().alias("_n"))
    size = F.floor(F.col("_n") / (k + 1))
    start = F.col("_n") - k * size
    blk = F.when((size == 0) | (F.col("row_idx") < start), 0).otherwise(F.floor((F.col("row_idx") - start) / size) + 1)
    return t.withColumn("_blk", blk.cast("int")).drop("_n")


def cv_table(df: DataFrame, sw: SeriesWindow, features: Sequence[str], target: str, k: int) -> tuple[DataFrame, list[int], dict[int, int]]:
    """(rows in blocks, as :func:`fits.fit_table` writes them; folds with training and test rows; training rows of each fold)."""
    data = fits.fit_table(with_expanding_blocks(df, sw, k), features, target, [*sw.series_cols, "row_idx", "_blk"])
    sizes = {r["_blk"]: r["n"] for r in data.groupBy("_blk").agg(F.count(F.lit(1)).alias("n")).collect()}  # k + 1 rows
    before = {f: sum(n for b, n in sizes.items() if b <= f) for f in range(k)}
    return data, [f for f in range(k) if sizes.get(f + 1) and before[f]], before


def fold_score(data: DataFrame, estimator, fold: int) -> tuple:
    """n, mse, mae, r2, rmse of one fold: scaler and estimator fitted on the blocks up to the fold's, scored on the next."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler
    scaler = StandardScaler(inputCol="x", outputCol="scaled", withMean=True, withStd=True)
    estimator = estimator.setFeaturesCol("scaled").setLabelCol("y").setPredictionCol("pred")
    model = Pipeline(stages=[scaler, estimator]).fit(data.where(F.col("_blk") <= fold))
    scored = model.transform(data.where(F.col("_blk") == fold + 1))
    return tuple(M.regression_metrics(scored.withColumn("one", F.lit(1)), ["one"]).drop("one").first())


def temporal_cv(df: DataFrame, sw: SeriesWindow, features: Sequence[str], target: str, estimators: dict, k: int = 5,
                parallel: int = fits.PARALLEL) -> DataFrame:
    """Expanding-window cross-validation of any Spark ML estimators (name -> factory). For each fold a
    scaler (mean and deviation) is fitted on the training rows, pooled over series, and both sides go
    through it; all (fold, estimator) fits run side by side. model, fold, n_train, n, mse, mae, r2, rmse of every
    fold, and with a null fold the means over folds: the score of a search."""
    spark = df.sparkSession
    data, folds, sizes = cv_table(df, sw, features, target, k)
    jobs = {(m, f): (lambda m=m, f=f: fold_score(data, estimators[m](), f)) for f in reversed(folds) for m in estimators}
    rows = [(m, f, sizes[f], *v) for (m, f), v in fits.together(spark, jobs, parallel).items()]
    each = spark.createDataFrame(rows, "model string, fold long, n_train long, n long, mse double, mae double, r2 double, rmse double")
    means = each.groupBy("model").agg(F.lit(None).cast("long").alias("fold"), F.sum("n_train").alias("n_train"), F.sum("n").alias("n"),
                                      *[F.avg(c).alias(c) for c in ("mse", "mae", "r2", "rmse")])
    return each.unionByName(means)
