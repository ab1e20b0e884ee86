"""Result documents (S12–S14, S19, S20): tidy (run, model, metric) tables inside Spark; the
nested JSON shape only at the file edge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

METRICS = ["mse", "mae", "r2", "rmse", "cv_score"]

# fixed values: metric field names of the three result layouts
LAYOUTS = {
    "plain": {"r2": "r2", "rmse": "rmse", "mae": "mae"},
    "test_prefixed": {"r2": "test_r2", "rmse": "test_rmse", "mae": "test_mae"},
    "walk_forward": {"r2": "Overall_R2", "rmse": "Overall_RMSE", "mae": "Overall_MAE"},
}


def nan_to_null_all(df: DataFrame) -> DataFrame:
    """NaN -> NULL in every double column (JSON writes NaN as a string otherwise)."""
    return df.select(*[F.when(~F.isnan(F.col(f.name)), F.col(f.name)).alias(f.name)
                       if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields])


def to_report(tidy: DataFrame, run_col: str, model_col: str, metrics: Sequence[str], layout: str = "plain") -> DataFrame:
    """One document per run: {run, results: map model -> struct(metrics)} (field names of
    ``layout``)."""
    names = LAYOUTS[layout]
    st = F.struct(*[F.col(m).alias(names.get(m, m)) for m in metrics])
    t = nan_to_null_all(tidy)
    return t.groupBy(run_col).agg(F.map_from_entries(F.collect_list(F.struct(F.col(model_col), st))).alias("results")) \
        .withColumn("layout", F.lit(layout))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def explode_result_sets(reports: Sequence[DataFrame], run_col: str = "run") -> DataFrame:
    """Every layout's map(model -> metrics) back to (run, layout, model, r2, rmse, mae)."""
    outs = []
    for rep in reports:
        layout = rep.select("layout").first()["layout"] if "layout" in rep.columns else "plain"
        names = LAYOUTS[layout]
        e = rep.select(run_col, "layout", F.explode("results").alias("model", "m"))
        outs.append(e.select(run_col, "layout", "model",
                             *[F.col(f"m.{names[k]}").cast("double").alias(k) for k in ("r2", "rmse", "mae")]))
    out = outs[0]
    for o in outs[1:]:
        out = out.unionByName(o, allowMissingColumns=True)
    return out


def to_records(df: DataFrame, time_col: str = "dt") -> DataFrame:
    """Each row as a JSON record, ISO dates, NULL for NaN."""
    t = nan_to_null_all(df).withColumn(time_col, F.date_format(time_col, "yyyy-MM-dd"))
    return t.select(F.to_json(F.struct(*t.columns), {"ignoreNullFields": "false"}).alias("record"))


def save_model(model, path: str, feature_spec: Sequence[str] | None = None) -> None:
    """Spark ML pipeline model + the ordered feature list next to it."""
    model.write().overwrite().save(path)
    if feature_spec is not None:
        from pyspark.sql import SparkSession
        spark = SparkSession.getActiveSession()
        if spark is not None:
            spark.createDataFrame([(i, c) for i, c in enumerate(feature_spec)], "pos int, feature string") \
                .coalesce(1).write.mode("overwrite").json(path.rstrip("/") + "_features")


def load_model(path: str):
    from pyspark.ml import PipelineModel
    return PipelineModel.load(path)
