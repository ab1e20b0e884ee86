"""Many Spark ML fits over one written table.

A tree fit is a long chain of small jobs (one a level), so on a small training set most of a fit is
scheduling; fits that do not depend on each other are therefore submitted together, each from a
thread of the driver, and Spark runs their jobs side by side. Rows stay on the executors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Hashable, Sequence
from concurrent.futures import ThreadPoolExecutor

from py4j.protocol import Py4JJavaError
from pyspark import inheritable_thread_target
from pyspark.errors import PySparkException
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.session import cut_lineage

CELLS = 10_000  # numbers of a partition at least: a small table is not fitted in many tiny tasks
PARALLEL = 8
#: What Spark raises when a fit fails on its data; errors of the calling code are not among them.
FIT_ERRORS = (Py4JJavaError, PySparkException)


def fit_table(df: DataFrame, features: Sequence[str], target: str, keep: Sequence[str]) -> DataFrame:
    """``keep``, y and the feature vector ``x``, written to the shared checkpoint folder and read by
    all fits; rows without a target or with a missing feature are left out."""
    inputs = {f"_f{i}": c for i, c in enumerate(features)}
    named = df.where(F.col(target).isNotNull()).select(*keep, F.col(target).cast("double").alias("y"), *[F.col(c).alias(k) for k, c in inputs.items()])
    rows = VectorAssembler(inputCols=list(inputs), outputCol="x", handleInvalid="skip").transform(named)
    data = cut_lineage(rows.select(*keep, "y", "x"))
    n = data.count()
    return data.coalesce(max(1, math.ceil(n * len(features) / CELLS)))


def together(spark: SparkSession, jobs: dict[Hashable, Callable[[], object]], parallel: int = PARALLEL) -> dict[Hashable, object]:
    """Results of ``jobs``, ``parallel`` at a time; the first error of one is raised when all have ended."""
    with ThreadPoolExecutor(max(1, parallel)) as pool:
        running = {k: pool.submit(inheritable_thread_target(spark)(job)) for k, job in jobs.items()}
    return {k: r.result() for k, r in running.items()}


def ready(estimator):
    """``estimator`` on the columns of :func:`fit_table`."""
    return estimator.setFeaturesCol("x").setLabelCol("y").setPredictionCol("pred")


def fit_all(data: DataFrame, estimators: dict[str, object], parallel: int = PARALLEL) -> dict[str, object]:
    """Models of several estimators on one table."""
    return together(data.sparkSession, {k: (lambda e=e: ready(e).fit(data)) for k, e in estimators.items()}, parallel)
