"""Streams over landed batches: watermark, timers, keyed state, replay."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tsengine.streaming import jobs as T
from tsengine.streaming import sinks, stateful

T0 = dt.datetime(2024, 1, 1, 12)


def at(seconds: float) -> dt.datetime:
    return T0 + dt.timedelta(seconds=seconds)


def ticks(spark, rows):
    return spark.createDataFrame([(s, at(t), p, 1, n) for n, (s, t, p) in enumerate(rows)], "series string, ts timestamp_ntz, price double, size long, seq long")


def test_append_drops_late_rows_and_emits_once(spark):
    parts = [ticks(spark, [("a", 10, 1.0), ("a", 70, 2.0)]), ticks(spark, [("a", 700, 3.0)]), ticks(spark, [("a", 20, 99.0), ("a", 1500, 4.0)])]
    path = sinks.run_landed(spark, "t", parts, lambda s: T.bars_from_ticks_stream(s, "1 minute", "1 minute"), sinks.append_files)
    got = spark.read.parquet(path).orderBy("dt").collect()
    # the bar of second 1500 is still open; the late 99.0 went into none
    assert [(r.open, r.close, r.volume) for r in got] == [(1.0, 1.0, 1), (2.0, 2.0, 1), (3.0, 3.0, 1)]


@pytest.mark.parametrize("salts", [1, 5])
def test_validity_timers(spark, salts):
    def quotes(rows):
        return ticks(spark, rows).select(F.col("series").alias("source"), "ts", "price")
    parts = [quotes([("a", 0, 1.0), ("b", 5, 2.0), ("c", 0, None)]), quotes([("a", 50, 3.0), ("a", 30, 8.0)]), quotes([("a", 100, 4.0), ("d", 41, 7.0), ("e", 39, 7.5)])]
    path = sinks.run_landed(spark, "t", parts, lambda s: stateful.validity_stream(s, 60, salts=salts), sinks.batch_folders("update"))
    got = {r.source: (r.ts, r.price, r.stale) for r in stateful.valid_now(spark, path).collect()}
    # event time is at second 100: b (5) is passed; d and e came before the watermark of the batch before (50) and count as late
    assert got == {"a": (at(100), 4.0, False), "b": (at(5), 2.0, True)}


def test_tick_close_equals_batch(spark):
    rows = [("a" if k % 3 else "b", k * 37 % 5000 if k % 11 else k * 17 % 5000, float(k % 7) - 1.0) for k in range(300)]
    rows.sort(key=lambda r: r[1])
    df = ticks(spark, rows + [("c", 7, None)])
    parts = [df.where((F.col("seq") >= a) & (F.col("seq") < a + 75)) for a in range(0, 301, 75)]
    path = sinks.run_landed(spark, "t", parts, lambda s: stateful.tick_close_stream(s, 600), sinks.append_files)
    want = sorted(map(tuple, stateful.tick_close(df, 600).collect()), key=str)
    assert sorted(map(tuple, spark.read.parquet(path).collect()), key=str) == want
    assert len(want) == 300 and any(r[4] is None for r in want) and any(r[6] is None and r[4] is not None for r in want)


def test_tick_of_a_closed_bar(spark):
    parts = [ticks(spark, [("a", 10, 1.0), ("a", 700, 2.0)]), ticks(spark, [("a", 20, 5.0), ("a", 1300, 3.0)])]
    path = sinks.run_landed(spark, "t", parts, lambda s: stateful.tick_close_stream(s, 600), sinks.append_files)
    got = {r.price: r.prev_close for r in spark.read.parquet(path).collect()}
    assert got == {1.0: None, 2.0: 1.0, 5.0: None, 3.0: 2.0}


def test_replayed_batch_writes_nothing_twice(spark):
    quotes = ticks(spark, [("a", 1, 1.0), ("b", 2, 3.0), ("a", 2000, 5.0)]).select(F.col("series").alias("source"), F.col("ts").cast("timestamp").alias("ts"), "price")
    base = sinks.new_folder(spark, "t")
    body = stateful.summary_per_trigger(f"{base}/state")
    last = stateful.windowed_latest(quotes)
    for number in (0, 1, 0):  # batch 0 is run again after batch 1
        body(last, number).write.mode("overwrite").parquet(f"{base}/out/batch={number}")
    got = sinks.current(spark, f"{base}/out", ["window_start"]).orderBy("window_start").collect()
    assert [(r.average, r.highest, r.lowest, r.spread, r.sources_count) for r in got] == [(2.0, 3.0, 1.0, 2.0, 2), (5.0, 5.0, 5.0, 0.0, 1)]
    assert spark.read.parquet(f"{base}/out").where("batch = 0").count() == 2
