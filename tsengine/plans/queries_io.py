"""Registered source / sink (S*) and streaming (T*) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsengine.operators.bars import ohlcv
from tsengine.plans import fixtures
from tsengine.plans.oracle import BARS
from tsengine.plans.registry import register
from tsengine.session import ensure_checkpoint_dir
from tsengine.sources import bars as SB
from tsengine.sources import ledger as LG
from tsengine.sources import quotes as Q
from tsengine.sources import results as RS
from tsengine.streaming import jobs as T
from tsengine.streaming import sinks

BAR_EXACT = ["series", "dt", "volume"]


@register("s03_standardise_vendor_columns",
          f"WITH {BARS}\nSELECT series, dt AS date, open, high, low, close, volume, price * 0.99 AS price FROM bars",
          exact=["series", "date", "volume"], ts=["date"])
def q_vendor(spark, d):
    b = fixtures.bars(spark, d)
    vendor = b.select("series", F.col("dt").alias("Date"), F.col("open").alias("Open"), F.col("high").alias("High"),
                      F.col("low").alias("Low"), F.col("close").alias("Close"),
                      (F.col("price") * 0.99).alias("Adj Close"), F.col("volume").alias("Volume"))
    return SB.standardise_vendor_columns(vendor)


@register("s04_to_naive_utc",
          "SELECT event_id, timezone('UTC', timezone('America/New_York', ts)) AS ts FROM events",
          exact=["event_id", "ts"], ts=["ts"], all_exact=True)
def q_utc(spark, d):
    e = fixtures.table(spark, d, "events").select("event_id", "ts")
    return SB.to_naive_utc(e, "ts", "America/New_York")


def _raw_sql() -> str:
    pc = "round(value - (user_id % 7) + 3.0, 2)"
    f2 = "printf('%.2f', {})".format
    j0 = ("'{\"close\": ' || " + f2("value") + " || ', \"previousClose\": ' || " + f2(pc) + " || ', \"high\": ' || "
          + f2("value + 1.0") + " || ', \"low\": ' || " + f2("value - 1.0") + " || ', \"open\": ' || " + f2(pc)
          + " || ', \"volume\": ' || user_id::VARCHAR || '}'")
    j1 = ("'{\"success\": ' || CASE WHEN user_id % 5 = 0 THEN 'false' ELSE 'true' END || ', \"rates\": {\"XAU\": ' || "
          "printf('%.6f', value / 31.1035 - 0.05) || '}}'")
    j2 = ("'{\"Global Quote\": {\"05. price\": \"' || " + f2("value") + " || '\", \"09. change\": \"' || " + f2(f"value - {pc}")
          + " || '\", \"10. change percent\": \"' || printf('%.4f', (value - " + pc + ") / " + pc + " * 100.0) || '%\"}}'")
    hlo = ("CASE WHEN user_id % 3 = 0 THEN '' ELSE ', \"h\": ' || " + f2("value + 2.0") + " || ', \"l\": ' || "
           + f2("value - 2.0") + " || ', \"o\": ' || " + f2(pc) + " END")
    j3 = "'{\"c\": ' || " + f2("value") + " || ', \"pc\": ' || " + f2(pc) + " || " + hlo + " || '}'"
    return (f"raw AS (SELECT event_id, ts, CASE event_id % 4 WHEN 0 THEN 'exchange' WHEN 1 THEN 'per_gram' "
            f"WHEN 2 THEN 'string_keyed' ELSE 'short_key' END AS vendor, CASE event_id % 4 WHEN 0 THEN {j0} "
            f"WHEN 1 THEN {j1} WHEN 2 THEN {j2} ELSE {j3} END AS payload FROM events)")


RAW = _raw_sql()


def _jn(path):
    return f"TRY_CAST(json_extract_string(payload, '{path}') AS DOUBLE)"


S06 = (f"SELECT event_id, ts, 'exchange' AS source, round({_jn('$.close')}, 2) AS price, "
       f"round({_jn('$.close')} - coalesce({_jn('$.previousClose')}, {_jn('$.close')}), 2) AS change, "
       f"round(CASE WHEN coalesce({_jn('$.previousClose')}, {_jn('$.close')}) > 0 THEN ({_jn('$.close')} - coalesce({_jn('$.previousClose')}, {_jn('$.close')})) "
       f"/ coalesce({_jn('$.previousClose')}, {_jn('$.close')}) * 100.0 ELSE 0.0 END, 2) AS change_percent, "
       f"round({_jn('$.high')}, 2) AS high, round({_jn('$.low')}, 2) AS low, round({_jn('$.open')}, 2) AS open, "
       f"{_jn('$.volume')}::BIGINT AS volume FROM raw WHERE vendor = 'exchange'")
_RATE = f"coalesce({_jn('$.rates.XAU')}, 0.0)"
S07 = (f"SELECT event_id, ts, 'per_gram' AS source, round(CASE WHEN {_RATE} > 0 THEN {_RATE} * 31.1035 ELSE 0.0 END, 2) AS price "
       "FROM raw WHERE vendor = 'per_gram' AND json_extract_string(payload, '$.success') = 'true'")
_G = '$."Global Quote"'
S08 = (f"SELECT event_id, ts, 'string_keyed' AS source, round(coalesce({_jn(_G + '.\"05. price\"')}, 0.0), 2) AS price, "
       f"round(coalesce({_jn(_G + '.\"09. change\"')}, 0.0), 2) AS change, "
       f"round(coalesce(TRY_CAST(replace(json_extract_string(payload, '{_G}.\"10. change percent\"'), '%', '') AS DOUBLE), 0.0), 2) AS change_percent "
       "FROM raw WHERE vendor = 'string_keyed'")
_C, _PC = _jn("$.c"), f"coalesce({_jn('$.pc')}, {_jn('$.c')})"
S09 = (f"SELECT event_id, ts, 'short_key' AS source, round({_C}, 2) AS price, round({_C} - {_PC}, 2) AS change, "
       f"round(CASE WHEN {_PC} > 0 THEN ({_C} - {_PC}) / {_PC} * 100.0 ELSE 0.0 END, 2) AS change_percent, "
       f"round(coalesce({_jn('$.h')}, {_C}), 2) AS high, round(coalesce({_jn('$.l')}, {_C}), 2) AS low, "
       f"round(coalesce({_jn('$.o')}, {_C}), 2) AS open FROM raw WHERE vendor = 'short_key' AND {_C} IS NOT NULL")


def _raw(spark, d):
    return fixtures.raw_quotes(spark, d)


register("s06_normalise_exchange", f"WITH {RAW}\n{S06}", exact=["event_id", "ts", "source", "volume"], ts=["ts"])(
    lambda spark, d: Q.normalise_exchange(_raw(spark, d).filter("vendor = 'exchange'")))
register("s07_normalise_per_gram", f"WITH {RAW}\n{S07}", exact=["event_id", "ts", "source"], ts=["ts"])(
    lambda spark, d: Q.normalise_per_gram(_raw(spark, d).filter("vendor = 'per_gram'")))
register("s08_normalise_string_keyed", f"WITH {RAW}\n{S08}", exact=["event_id", "ts", "source"], ts=["ts"])(
    lambda spark, d: Q.normalise_string_keyed(_raw(spark, d).filter("vendor = 'string_keyed'")))
register("s09_normalise_short_key", f"WITH {RAW}\n{S09}", exact=["event_id", "ts", "source"], ts=["ts"])(
    lambda spark, d: Q.normalise_short_key(_raw(spark, d).filter("vendor = 'short_key'")))

ALL_QUOTES_SQL = (f"WITH {RAW},\n a AS ({S06}),\n b AS ({S07}),\n c AS ({S08}),\n e AS ({S09})\n"
                  "SELECT event_id, ts, source, price, change, change_percent, high, low, open, volume FROM a UNION ALL "
                  "SELECT event_id, ts, source, price, NULL, NULL, NULL, NULL, NULL, NULL FROM b UNION ALL "
                  "SELECT event_id, ts, source, price, change, change_percent, NULL, NULL, NULL, NULL FROM c UNION ALL "
                  "SELECT event_id, ts, source, price, change, change_percent, high, low, open, NULL FROM e")


@register("s06_s09_normalise_all", ALL_QUOTES_SQL, exact=["event_id", "ts", "source", "volume"], ts=["ts"])
def q_norm_all(spark, d):
    return Q.normalise_all(_raw(spark, d))


@register("s10_history_window",
          f"WITH {BARS}\nSELECT * FROM bars WHERE dt >= TIMESTAMP '2001-01-01' - INTERVAL 90 DAY AND dt <= TIMESTAMP '2001-01-01'",
          exact=BAR_EXACT, ts=["dt"])
def q_hist(spark, d):
    return SB.history_window(fixtures.bars(spark, d), "2001-01-01 00:00:00", 90)


@register("s15_tail_n",
          f"WITH {BARS}\nSELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY series ORDER BY dt DESC) AS rn FROM bars) WHERE rn <= 5",
          exact=BAR_EXACT, ts=["dt"])
def q_tail(spark, d):
    return SB.tail_n(fixtures.bars(spark, d), ["series"], "dt", 5)


AS_OF = "2024-01-30 23:30:00"


@register("s16_freshness_gate",
          f"SELECT event_type AS source, max(ts) AS last_refresh, (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts))) / 60e6 AS age_minutes, "
          f"max(ts) IS NULL OR (epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(max(ts))) / 60e6 >= 60 AS needs_refresh FROM events GROUP BY event_type",
          exact=["source", "last_refresh", "needs_refresh"], ts=["last_refresh"])
def q_fresh(spark, d):
    ledger = fixtures.table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("refreshed_at"))
    return LG.freshness_gate(ledger, AS_OF, 60)


@register("s17_next_refresh_minutes",
          f"SELECT event_type AS source, greatest(0, floor((floor(epoch(max(ts))) + 900 - epoch(TIMESTAMP '{AS_OF}')) / 60))::BIGINT AS next_refresh_minutes "
          "FROM events GROUP BY event_type", exact=["source", "next_refresh_minutes"], all_exact=True)
def q_next_refresh(spark, d):
    ledger = fixtures.table(spark, d, "events").select(F.col("event_type").alias("source"), F.col("ts").alias("refreshed_at"))
    return LG.next_refresh_minutes(ledger, AS_OF, 15)


@register("s18_file_inventory")
def q_inventory(spark, d):
    return LG.file_inventory(spark, d, "*.parquet")


@register("s20_to_records",
          f"WITH {BARS}\nSELECT to_json(struct_pack(series := series, dt := strftime(dt, '%Y-%m-%d'), price := price, volume := volume)) AS record FROM bars",
          exact=["record"], all_exact=True)
def q_records(spark, d):
    return RS.to_records(fixtures.bars(spark, d).select("series", "dt", "price", "volume"))


@register("s01_s11_csv_roundtrip", f"WITH {BARS}\nSELECT series, dt, open, high, low, close, volume, price FROM bars",
          exact=BAR_EXACT, ts=["dt"])
def q_csv(spark, d):
    """S11 writes the bars as CSV (partitioned by series) into the shared checkpoint folder,
    S01 reads them back with an explicit schema."""
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/bars_csv_{uuid.uuid4().hex[:8]}"
    b = fixtures.bars(spark, d).select("series", F.date_format("dt", "yyyy-MM-dd").alias("date"), "open", "high",
                                       "low", "close", "volume", "price")
    SB.write_table(b, path, partition_by=("series",), fmt="csv", sort_cols=("date",))
    back = spark.read.schema("date string, open double, high double, low double, close double, volume long, price double") \
        .option("header", True).csv(path)
    # the partition folder carries the series key (series=...)
    ser = F.regexp_extract(F.input_file_name(), r"series=([^/]+)/", 1)
    # partition values are URL-escaped in folder names
    return back.select(F.url_decode(ser).alias("series"),
                       F.to_timestamp("date").cast("timestamp_ntz").alias("dt"), "open", "high", "low", "close", "volume", "price")


# ---- streaming ---------------------------------------------------------------------------------------
TICK_BARS_SQL = ("SELECT event_type AS series, date_trunc('hour', ts) AS dt, arg_min(value, event_id) AS open, max(value) AS high, "
                 "min(value) AS low, arg_max(value, event_id) AS close, count(*)::BIGINT AS volume FROM events GROUP BY ALL")


@register("t05_bars_from_ticks", TICK_BARS_SQL, exact=BAR_EXACT, ts=["dt"])
def q_tick_bars(spark, d):
    return ohlcv(fixtures.ticks(spark, d), ["series"], "ts", "price", "seq", "size", interval="1 hour").drop("price")


@register("t05b_bars_from_ticks_stream", TICK_BARS_SQL, exact=BAR_EXACT, ts=["dt"])
def q_tick_bars_stream(spark, d):
    """T05 as a Structured Streaming job over the events table (AvailableNow, complete mode)."""
    src = fixtures.stream(spark, d, "events")
    ticks = src.select(F.col("event_type").alias("series"), "ts", F.col("value").alias("price"),
                       F.lit(1).cast("long").alias("size"), F.col("event_id").alias("seq"))
    bars = T.bars_from_ticks_stream(ticks, "1 hour", "10 minutes")
    base = sinks.new_folder(spark, "t05")
    sinks.batch_folders("complete")(bars, f"{base}/result", f"{base}/checkpoint")
    return sinks.last_batch(spark, f"{base}/result").withColumn("dt", F.col("dt").cast("timestamp_ntz"))


@register("t02b_latest_per_source_stream",
          "SELECT event_type AS source, max(ts) AS ts, arg_max(value, ts) AS price FROM events GROUP BY event_type",
          exact=["source", "ts"], ts=["ts"])
def q_latest_stream(spark, d):
    src = fixtures.stream(spark, d, "events")
    q = src.select(F.col("event_type").alias("source"), "ts", F.col("value").alias("price"))
    base = sinks.new_folder(spark, "t02")
    sinks.batch_folders("complete")(T.latest_per_source_stream(q), f"{base}/result", f"{base}/checkpoint")
    return sinks.last_batch(spark, f"{base}/result")


@register("t03_windowed_summary",
          "SELECT make_timestamp((epoch_us(ts) // 30000000) * 30000000) AS window_start, avg(value) AS average, max(value) AS highest, "
          "min(value) AS lowest, max(value) - min(value) AS spread, count(*)::BIGINT AS quotes FROM events WHERE value > 0 GROUP BY 1",
          exact=["window_start", "quotes"], ts=["window_start"])
def q_window_summary(spark, d):
    q = fixtures.quotes(spark, d)
    s = T.windowed_summary_stream(q, "30 seconds", "1 minute")  # a streaming plan also runs as batch
    return s.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "average", "highest", "lowest",
                    "spread", "quotes")


@register("t06_tick_change",
          "SELECT event_type AS series, ts, event_id AS seq, value AS price, value - lag(value) OVER w AS change, "
          "CASE WHEN lag(value) OVER w > 0 THEN (value - lag(value) OVER w) / lag(value) OVER w * 100.0 END AS change_percent "
          "FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)", exact=["series", "ts", "seq"], ts=["ts"])
def q_tick_change(spark, d):
    return T.tick_change(fixtures.ticks(spark, d))


@register("t01_quote_stream", ALL_QUOTES_SQL, exact=["event_id", "ts", "source", "volume"], ts=["ts"])
def q_quote_stream(spark, d):
    """Raw quotes landed as parquet files in the shared folder, read as a stream and
    normalised (AvailableNow)."""
    raw = fixtures.raw_quotes(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    path = sinks.run_landed(spark, "t01", [raw.repartition(4)], Q.normalise_all, sinks.append_files)
    return spark.read.parquet(path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@register("t04_enrich_messages_stream")
def q_enrich_stream(spark, d):
    """The message table read as a stream (AvailableNow); every micro-batch is joined in
    ``foreachBatch`` with the current cross-source summary of the quotes (J04) and appended to a
    table in the shared folder."""
    import uuid

    from tsengine.operators import summary as S
    from tsengine.plans.queries_tables import KEYWORDS
    out = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/t04_{uuid.uuid4().hex[:8]}"
    latest = S.latest_per_source(fixtures.quotes(spark, d), "source", "ts", ["price"])
    src = fixtures.stream(spark, d, "conversations")
    msgs = src.select(F.col("role").alias("user"), F.col("conv_id").alias("room"), "turn", F.col("text").alias("message"))

    def sink(batch, epoch):
        e = T.enrich_messages_batch(batch, latest, KEYWORDS)
        e.select("user", "room", "turn", "message", F.col("price_context.current_avg").alias("ctx_avg"),
                 F.col("price_context.timestamp").alias("ctx_ts")).write.mode("append").parquet(out)

    T.run_available_now(msgs, "t04", "append", sink=sink)
    return spark.read.parquet(out)
