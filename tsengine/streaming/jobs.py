"""Streaming twins of the quote / bar operators.

State stays in Spark's built-in aggregation state store (``max_by``/``min_by`` are declarative
aggregates); no custom Python state. Checkpoints go under the session's shared
``spark.checkpoint.dir`` (set by the cluster; tests set their own when it is unset).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsengine.operators import summary as S
from tsengine.session import ensure_checkpoint_dir
from tsengine.sources import quotes as Q

RAW_QUOTE_SCHEMA = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
                                 T.StructField("vendor", T.StringType()), T.StructField("payload", T.StringType())])


def checkpoint_location(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/{name}-{uuid.uuid4().hex[:8]}"


def event_time(df: DataFrame, col: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP; the landed tables carry TIMESTAMP_NTZ (session tz UTC)."""
    return df.withColumn(col, F.col(col).cast("timestamp"))


def quote_stream(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType = RAW_QUOTE_SCHEMA,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Landed raw quotes (any of the four layouts) as a stream, normalised to one schema."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return Q.normalise_all(r.load(path))


def latest_per_source_stream(quotes: DataFrame) -> DataFrame:
    """Last quote per source, maintained in the aggregation state (update/complete mode)."""
    return S.latest_per_source(quotes, "source", "ts", ["price"])


def with_validity(latest: DataFrame, as_of, max_age_seconds: int = 60) -> DataFrame:
    """T02 validity: a source's quote is stale when older than ``max_age_seconds`` at ``as_of``
    (an age test in the micro-batch, no timers)."""
    age = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))
    return latest.withColumn("stale", age > max_age_seconds)


def windowed_summary_stream(quotes: DataFrame, window: str = "30 seconds", watermark: str = "1 minute") -> DataFrame:
    """T03 (windowed form): cross-source price summary per tumbling event-time window
    (unrounded; 2-digit rounding is left to the sink)."""
    q = event_time(quotes).withWatermark("ts", watermark)
    return q.filter(F.col("price") > 0).groupBy(F.window("ts", window).alias("w")).agg(
        F.avg("price").alias("average"), F.max("price").alias("highest"), F.min("price").alias("lowest"),
        (F.max("price") - F.min("price")).alias("spread"), F.count(F.lit(1)).alias("quotes"))


def bars_from_ticks_stream(ticks: DataFrame, interval: str = "1 hour", watermark: str = "10 minutes",
                           series: str = "series", price: str = "price", size: str = "size",
                           order: str = "seq") -> DataFrame:
    """OHLCV per (series, tumbling window); late rows beyond the watermark are dropped."""
    t = event_time(ticks).withWatermark("ts", watermark)
    return t.groupBy(F.col(series), F.window("ts", interval).alias("w")).agg(
        F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
        F.max_by(price, order).alias("close"), F.sum(size).cast("long").alias("volume")) \
        .select(series, F.col("w.start").alias("dt"), "open", "high", "low", "close", "volume")


def run_available_now(df: DataFrame, name: str, mode: str = "complete",
                      sink: Callable[[DataFrame, int], None] | None = None) -> str:
    """Run a streaming DataFrame over everything available now (``Trigger.AvailableNow``) into
    a memory table (or a ``foreachBatch`` sink); returns the memory table name."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex[:8]}"
    w = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint_location(spark, name))
    if sink is None:
        w = w.format("memory").queryName(table)
    else:
        w = w.foreachBatch(sink)
    q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    return table


def enrich_messages_batch(messages: DataFrame, latest_quotes: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """T04 micro-batch body: J04 against the current cross-source summary."""
    from tsengine.operators.joins import message_price_context
    summary = S.cross_source_summary(latest_quotes)
    return message_price_context(messages, summary, "message", keywords)


def tick_change(ticks: DataFrame, series: str = "series", ts: str = "ts", price: str = "price",
                order: str = "seq") -> DataFrame:
    """T06 (batch twin): change and % vs the previous tick of the series."""
    from pyspark.sql import Window
    w = Window.partitionBy(series).orderBy(ts, order)
    prev = F.lag(price, 1).over(w)
    return ticks.select(series, ts, order, price, (F.col(price) - prev).alias("change"),
                        F.when(prev > 0, (F.col(price) - prev) / prev * 100.0).alias("change_percent"))


def scheduled_refresh(spark: SparkSession, ledger: DataFrame, as_of, max_age_minutes: int,
                      job: Callable[[], None]) -> bool:
    """Run ``job`` (an AvailableNow stream or batch) only when the S16 gate says a refresh is
    due for any source; the scheduling itself is external (cron / orchestrator)."""
    from tsengine.sources.ledger import freshness_gate
    due = freshness_gate(ledger, as_of, max_age_minutes).filter("needs_refresh").limit(1).count() > 0
    if due:
        job()
    return due
