"""File sinks of streaming jobs and incremental runs over landed batches.

A job is run over what has arrived (``Trigger.AvailableNow``) and ended; the next run goes on from
its checkpoint. Files, checkpoints and results lie in the shared folder, so a lost executor or
driver costs the batch in flight only.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tsengine.session import ensure_checkpoint_dir

Sink = Callable[[DataFrame, str, str], None]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"


def append_files(df: DataFrame, path: str, checkpoint: str) -> None:
    """Append mode into Spark's file sink, whose log makes each batch's files visible exactly once."""
    q = (df.writeStream.outputMode("append").format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def batch_folders(mode: str = "update", body: Callable[[DataFrame, int], DataFrame] | None = None) -> Sink:
    """Each micro-batch (after ``body``) replaces the folder ``batch=<id>``: the id is what is
    committed, so a replayed batch writes nothing twice."""
    def sink(df: DataFrame, path: str, checkpoint: str) -> None:
        def write(batch: DataFrame, number: int) -> None:
            out = batch if body is None else body(batch, number)
            out.write.mode("overwrite").parquet(f"{path}/batch={number}")
        q = df.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
    return sink


def current(spark: SparkSession, path: str, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """What holds now: per key the row of the latest batch, by ``order`` within it."""
    rows = spark.read.parquet(path)
    cols = [c for c in rows.columns if c not in (*keys, "batch")]
    last = F.max_by(F.struct(*cols), F.struct(*order, "batch") if order else F.col("batch")).alias("_l")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"_l.{c}").alias(c) for c in cols])


def last_batch(spark: SparkSession, path: str) -> DataFrame:
    """The whole result as of the last batch, of a job in complete mode."""
    rows = spark.read.parquet(path)
    return rows.where(F.col("batch") == rows.agg(F.max("batch")).first()[0]).drop("batch")


def run_landed(spark: SparkSession, name: str, parts: Sequence[DataFrame], job: Callable[[DataFrame], DataFrame], sink: Sink) -> str:
    """Land one part after the other and run ``job`` over what is new each time, all runs on one
    checkpoint: state and watermark carry over. Returns the result's folder."""
    base = new_folder(spark, name)
    schema = parts[0].schema
    for k, part in enumerate(parts):
        part.write.parquet(f"{base}/landing/{k}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{base}/landing")
        sink(job(stream), f"{base}/result", f"{base}/checkpoint")
    return f"{base}/result"
