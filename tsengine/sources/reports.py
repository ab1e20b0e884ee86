"""Result reports of mixed layouts (S13, S14): a folder's newest report of each kind as VARIANT, and all
of them in one tidy table.

Nothing about a report's layout is known before it is read: documents are parsed to VARIANT, sections
and models are exploded in Spark, and each metric is taken from whichever of its names is there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: name prefixes of the report kinds and how they are stored
KINDS = {
    "optimized_training": ("optimized_training_results_", "json"),
    "deep_learning": ("deep_learning_results_", "json"),
    "walk_forward": ("walk_forward_results_", "json"),
    "walk_forward_summary": ("walk_forward_summary_", "csv"),
}
# fixed values: sections of a report that map models to metrics, and the type of their models
SECTIONS = {
    ("optimized_training", "model_results"): "Individual",
    ("optimized_training", "ensemble_results"): "Ensemble",
    ("deep_learning", "model_results"): "Deep Learning",
    ("deep_learning", "validation_results"): "Deep Learning",
    ("deep_learning", "test_results"): "Deep Learning",
}
TABLE_TYPE = "Traditional ML"
# fixed values: names of one metric in the layouts, in the order in which they are looked for
METRICS = {
    "r2": ("r2", "test_r2", "Overall_R2"),
    "rmse": ("rmse", "test_rmse", "Overall_RMSE"),
    "mae": ("mae", "test_mae", "Overall_MAE"),
    "cv_score": ("cv_score", "cv_mean", "Mean_Fold_R2"),
    "cv_std": ("cv_std", "Std_Fold_R2"),
}


def newest_files(spark: SparkSession, folder: str) -> DataFrame:
    """kind, name, paths of the newest report of each kind, by modification time and then by name. A report
    is a file, or a folder of part files as Spark writes them. Only file metadata is read."""
    f = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
         .select("path", F.col("modificationTime").alias("modified")))
    kind = name = F.lit(None).cast("string")
    for k, (prefix, kind_of_file) in KINDS.items():
        found = F.regexp_extract("path", rf"/({prefix}[^/]*\.{kind_of_file})(?:/[^/]*)?$", 1)
        kind, name = F.when(found != "", F.lit(k)).otherwise(kind), F.when(found != "", found).otherwise(name)
    reports = f.select(kind.alias("kind"), name.alias("name"), "path", "modified").where("kind IS NOT NULL")
    whole = reports.groupBy("kind", "name").agg(F.max("modified").alias("modified"), F.array_sort(F.collect_list("path")).alias("paths"))
    return whole.groupBy("kind").agg(F.max_by(F.struct("name", "paths"), F.struct("modified", "name")).alias("r")).select("kind", "r.name", "r.paths")


def read_result_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Kind, name, doc (VARIANT) of the newest report of each kind; of a CSV report, a row each. NaN and
    infinities, which are no JSON, are read as null; a document that is no JSON has a null doc."""
    names = newest_files(spark, folder).collect()  # a row a kind
    out = spark.createDataFrame([], "kind string, name string, text string")
    for kind, name, paths in names:
        if KINDS[kind][1] == "json":
            rows = spark.read.option("wholetext", "true").text(paths).select(F.regexp_replace("value", r"(?<=[:\[,])\s*(?:NaN|-?Infinity)(?=\s*[,\]}])", "null").alias("text"))
        else:
            rows = spark.read.option("header", "true").csv(paths)
            rows = rows.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in rows.columns])).alias("text"))
        out = out.unionByName(rows.select(F.lit(kind).alias("kind"), F.lit(name).alias("name"), "text"))
    return out.select("kind", "name", F.try_parse_json("text").alias("doc"))


def _number(doc: str, names: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_variant_get(F.col(doc), f"$.{n}", "double") for n in names])


def explode_result_sets(sets: DataFrame) -> DataFrame:
    """Kind, section, model_type, model and the metrics of every model of every layout; a metric that a
    report has not, or that is no finite number, is null."""
    spark = sets.sparkSession
    out = None
    for (kind, section), model_type in SECTIONS.items():
        part = sets.where(F.col("kind") == kind).select("kind", F.try_variant_get("doc", f"$.{section}", "variant").alias("models"))
        models = part.lateralJoin(spark.tvf.variant_explode(F.col("models").outer())).select(
            "kind", F.lit(section).alias("section"), F.lit(model_type).alias("model_type"), F.col("key").alias("model"), F.col("value").alias("m"))
        out = models if out is None else out.unionByName(models)
    tables = [k for k, (_, kind_of_file) in KINDS.items() if kind_of_file == "csv"]
    rows = sets.where(F.col("kind").isin(tables)).select(
        "kind", F.lit("rows").alias("section"), F.lit(TABLE_TYPE).alias("model_type"), F.try_variant_get("doc", "$.Model", "string").alias("model"), F.col("doc").alias("m"))
    values = {k: _number("m", names) for k, names in METRICS.items()}
    return out.unionByName(rows).select(
        "kind", "section", "model_type", "model", *[F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v).alias(k) for k, v in values.items()])
