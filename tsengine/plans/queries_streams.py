"""Registered streaming queries over landed batches of the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsengine.plans import fixtures
from tsengine.plans.queries_io import BAR_EXACT
from tsengine.plans.registry import register
from tsengine.streaming import jobs as T
from tsengine.streaming import sinks, stateful

#: Borders of the landed batches; the events span thirty days from 2024-01-01.
CUTS = ("2024-01-11", "2024-01-21")


def _parts(df):
    a, b = (F.lit(c).cast("timestamp_ntz") for c in CUTS)
    return [df.where(F.col("ts") < a), df.where((F.col("ts") >= a) & (F.col("ts") < b)), df.where(F.col("ts") >= b)]


@register("t02c_validity_stream",
          "SELECT event_type AS source, max(ts) AS ts, arg_max(value, ts) AS price, "
          "epoch_ms(max(ts)) + 60000 < (SELECT epoch_ms(max(ts)) FROM events) AS stale FROM events GROUP BY event_type",
          exact=["source", "ts", "stale"], ts=["ts"])
def q_validity(spark, d):
    """T02 with the 60 s validity: event-time timers mark sources stale that no new quote reaches."""
    quotes = fixtures.quotes(spark, d).select("source", "ts", "price")
    path = sinks.run_landed(spark, "t02c", _parts(quotes), stateful.validity_stream, sinks.batch_folders("update"))
    return stateful.valid_now(spark, path)


@register("t03b_summary_stream",
          "WITH l AS (SELECT make_timestamp((epoch_us(ts) // 1800000000) * 1800000000) AS window_start, event_type, max(ts) AS ts, arg_max(value, ts) AS price "
          "FROM events GROUP BY ALL) SELECT window_start, avg(price) AS average, max(price) AS highest, min(price) AS lowest, max(price) - min(price) AS spread, "
          "count(*)::BIGINT AS sources_count, max(ts) AS ts FROM l WHERE price > 0 GROUP BY window_start",
          exact=["window_start", "sources_count", "ts"], ts=["window_start", "ts"])
def q_summary_stream(spark, d):
    """The cross-source summary (A06) of each 30-minute window, emitted by every trigger that touches it."""
    quotes = fixtures.quotes(spark, d).select("source", "ts", "price")
    latest = f"{sinks.new_folder(spark, 't03b')}/state"
    path = sinks.run_landed(spark, "t03b", _parts(quotes), stateful.windowed_latest, sinks.batch_folders("update", stateful.summary_per_trigger(latest, None)))
    return sinks.current(spark, path, ["window_start"]).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "ts")})


LATE = "event_id % 97 = 0 AND ts < TIMESTAMP '2024-01-10 00:00:00'"


@register("t05c_bars_append_late",
          f"SELECT * FROM (SELECT event_type AS series, date_trunc('hour', ts) AS dt, arg_min(value, event_id) AS open, max(value) AS high, min(value) AS low, "
          f"arg_max(value, event_id) AS close, count(*)::BIGINT AS volume FROM events WHERE NOT ({LATE}) GROUP BY ALL) "
          "WHERE dt + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE", exact=BAR_EXACT, ts=["dt"])
def q_bars_append(spark, d):
    """T05 in append mode: a bar appears once, in the file sink, when the watermark (10 minutes) has passed its
    end; its state goes, and ticks that land after that are dropped. One event of 97 from before 10 January lands
    with the last batch, weeks late."""
    ticks = fixtures.ticks(spark, d).withColumn("late", F.expr(LATE.replace("event_id", "seq").replace("TIMESTAMP '", "TIMESTAMP_NTZ '")))
    a, b, c = _parts(ticks)
    parts = [a.where("NOT late"), b.where("NOT late"), c.unionByName(ticks.where("late"))]
    path = sinks.run_landed(spark, "t05c", [p.drop("late") for p in parts], lambda s: T.bars_from_ticks_stream(s, "1 hour", "10 minutes"), sinks.append_files)
    return spark.read.parquet(path).withColumn("dt", F.col("dt").cast("timestamp_ntz"))


TICK_CLOSE_SQL = ("WITH b AS (SELECT event_type AS series, date_trunc('hour', ts) AS bar, arg_max(value, ts) AS close FROM events GROUP BY ALL), "
                  "p AS (SELECT series, bar, lag(close) OVER (PARTITION BY series ORDER BY bar) AS prev_close FROM b) "
                  "SELECT series, ts, event_id AS seq, value AS price, prev_close, value - prev_close AS change, "
                  "CASE WHEN prev_close > 0 THEN (value - prev_close) / prev_close * 100.0 END AS change_percent "
                  "FROM events JOIN p ON p.series = event_type AND p.bar = date_trunc('hour', ts)")


@register("t06b_tick_close_stream", TICK_CLOSE_SQL, exact=["series", "ts", "seq"], ts=["ts"])
def q_tick_close_stream(spark, d):
    """T06 as a stream: each tick against the close of its series' last closed hour, over three batches."""
    path = sinks.run_landed(spark, "t06b", _parts(fixtures.ticks(spark, d)), stateful.tick_close_stream, sinks.append_files)
    return spark.read.parquet(path)


@register("t06c_tick_close", TICK_CLOSE_SQL, exact=["series", "ts", "seq"], ts=["ts"])
def q_tick_close(spark, d):
    return stateful.tick_close(fixtures.ticks(spark, d))
