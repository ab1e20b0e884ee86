"""Streaming operators with keyed state of their own (T02 validity, T06) and summaries per trigger.

State is a few numbers a key. Event time goes through the state functions as microseconds, so the
session's time zone plays no part.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tsengine.streaming import sinks

SALTS = 16


def validity_stream(quotes: DataFrame, max_age_seconds: int = 60, delay: str = "0 seconds", salts: int = SALTS) -> DataFrame:
    """T02 with validity: rows (source, salt, micros, price, stale) whenever the last quote of a
    (source, salt) changes, and once more, stale, when event time has passed it by ``max_age_seconds``
    without a newer one: an event-time timer of the key, no quote needs to arrive. A source's quotes
    are dealt over ``salts`` keys, so a busy source is not one task's; see :func:`valid_now`."""
    age_ms = max_age_seconds * 1000

    def on_batch(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = tuple(state.get) if state.exists else None
        if state.hasTimedOut:
            state.update(last)  # kept without a timer: an older quote must not come back as the last
            yield pd.DataFrame({"source": [key[0]], "salt": [key[1]], "micros": [last[0]], "price": [last[1]], "stale": [True]})
            return
        for pdf in batches:
            top = pdf.sort_values(["micros", "price"]).iloc[-1]
            now = (int(top["micros"]), float(top["price"]))
            last = now if last is None or now > last else last
        state.update(last)
        expires = last[0] // 1000 + age_ms
        stale = expires <= state.getCurrentWatermarkMs()
        if not stale:
            state.setTimeoutTimestamp(expires)
        yield pd.DataFrame({"source": [key[0]], "salt": [key[1]], "micros": [last[0]], "price": [last[1]], "stale": [stale]})

    q = quotes.where("price IS NOT NULL AND ts IS NOT NULL").select("source", F.col("ts").cast("timestamp").alias("ts"), "price").withWatermark("ts", delay)
    q = q.withColumns({"micros": F.unix_micros("ts"), "salt": F.pmod(F.xxhash64("ts", "price"), F.lit(salts)).cast("int")})
    return q.groupBy("source", "salt").applyInPandasWithState(
        on_batch, "source string, salt int, micros long, price double, stale boolean", "micros long, price double", "update", GroupStateTimeout.EventTimeTimeout)


def valid_now(spark: SparkSession, path: str) -> DataFrame:
    """source, ts, price, stale of each source's last quote, from the batches of a validity stream."""
    keys = sinks.current(spark, path, ["source", "salt"])
    last = keys.groupBy("source").agg(F.max_by(F.struct("micros", "price", "stale"), F.struct("micros", "price")).alias("l"))
    return last.select("source", F.timestamp_micros("l.micros").cast("timestamp_ntz").alias("ts"), "l.price", "l.stale")


TICK = "series string, micros long, seq long, price double, prev_close double, change double, change_percent double"


def _changes(out: DataFrame) -> DataFrame:
    return out.select("series", F.timestamp_micros("micros").cast("timestamp_ntz").alias("ts"), "seq", "price", "prev_close", "change", "change_percent")


def tick_close_stream(ticks: DataFrame, interval_seconds: int = 3600) -> DataFrame:
    """T06 as a stream: every tick against the close of the last closed bar of its series. A series'
    state is its open bar (start, last tick, close) and the close before it. Ticks of one batch are taken in
    order of (ts, seq); one that falls into a bar closed by an earlier batch has no close to compare with
    (nulls). ``maxFilesPerTrigger`` or ``maxBytesPerTrigger`` bounds what a batch holds of a series."""
    span = interval_seconds * 1_000_000

    def on_batch(key: tuple, batches: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        bar, at, seq, close, before = tuple(state.get) if state.exists else (None,) * 5
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["micros", "seq"], kind="stable")
        start = pdf["micros"] // span * span
        prev = pd.Series(float("nan"), index=pdf.index, dtype="float64")
        for begin, rows in pdf.groupby(start, sort=True):
            begin = int(begin)
            if bar is not None and begin < bar:
                continue
            if bar is None or begin > bar:
                bar, before, at, seq = begin, close, None, None
            prev[rows.index] = float("nan") if before is None else before
            end = (int(rows["micros"].iloc[-1]), int(rows["seq"].iloc[-1]))
            if at is None or end >= (at, seq):
                (at, seq), close = end, float(rows["price"].iloc[-1])
        state.update((bar, at, seq, close, before))
        change = pdf["price"] - prev
        yield pd.DataFrame({"series": key[0], "micros": pdf["micros"], "seq": pdf["seq"], "price": pdf["price"], "prev_close": prev, "change": change,
                            "change_percent": (change / prev * 100.0).where(prev > 0)})

    t = ticks.where("price IS NOT NULL AND ts IS NOT NULL").select("series", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "seq", "price")
    out = t.groupBy("series").applyInPandasWithState(
        on_batch, TICK, "bar long, at long, seq long, close double, before double", "append", GroupStateTimeout.NoTimeout)
    nan = {c: F.when(~F.isnan(c), F.col(c)) for c in ("prev_close", "change", "change_percent")}
    return _changes(out.withColumns(nan))


def tick_close(ticks: DataFrame, interval_seconds: int = 3600) -> DataFrame:
    """T06, batch twin: bars are aggregated first (map-side), the close before is a lag over bars, and
    ticks meet their bar's by an equi join: no window over a series' ticks."""
    span = interval_seconds * 1_000_000
    t = ticks.where("price IS NOT NULL AND ts IS NOT NULL").select("series", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"), "seq", "price")
    t = t.withColumn("bar", F.expr(f"micros - pmod(micros, {span}L)"))
    bars = t.groupBy("series", "bar").agg(F.max_by("price", F.struct("micros", "seq")).alias("close"))
    before = bars.select("series", "bar", F.lag("close").over(Window.partitionBy("series").orderBy("bar")).alias("prev_close"))
    change = F.col("price") - F.col("prev_close")
    out = t.join(before, ["series", "bar"]).withColumns(
        {"change": change, "change_percent": F.when(F.col("prev_close") > 0, change / F.col("prev_close") * 100.0)})
    return _changes(out)


def window_summaries(latest: DataFrame, digits: int | None = 2) -> DataFrame:
    """A06 per window: average, highest, lowest, spread, sources and newest timestamp over the last
    quotes of the sources with a price above 0; average and spread to ``digits`` places (None: as they are)."""
    def shown(c):
        return c if digits is None else F.round(c, digits)
    return latest.where("price > 0").groupBy("window_start").agg(
        shown(F.avg("price")).alias("average"), F.max("price").alias("highest"), F.min("price").alias("lowest"),
        shown(F.max("price") - F.min("price")).alias("spread"), F.count(F.lit(1)).alias("sources_count"), F.max("ts").alias("ts"))


def windowed_latest(quotes: DataFrame, window: str = "30 minutes", watermark: str = "1 hour") -> DataFrame:
    """Last quote per (window, source), kept in the aggregation state; the watermark lets closed windows go."""
    q = quotes.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark)
    last = q.groupBy(F.window("ts", window).alias("w"), "source").agg(F.max_by(F.struct("ts", "price"), F.struct("ts", "price")).alias("l"))
    return last.select(F.col("w.start").alias("window_start"), "source", "l.ts", "l.price")


def summary_per_trigger(path: str, digits: int | None = 2):
    """What a trigger changed is written under its batch id, then each window it touched is summed up
    anew from the last quotes of all its sources, batches before included."""
    def body(batch: DataFrame, number: int) -> DataFrame:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/latest/batch={number}")
        # a replay may find later folders than its own: they do not count for it
        rows = spark.read.parquet(f"{path}/latest").where(F.col("batch") <= number)
        touched = rows.where(F.col("batch") == number).select("window_start").distinct()
        last = rows.join(touched, "window_start", "left_semi").groupBy("window_start", "source").agg(
            F.max_by(F.struct("ts", "price"), F.struct("ts", "price")).alias("l")).select("window_start", "source", "l.ts", "l.price")
        return window_summaries(last, digits)
    return body
