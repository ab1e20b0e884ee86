"""Registered cleaning (P*), join (J*) and summary (A01–A07, A21–A22) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tsengine.frames import SeriesWindow
from tsengine.functions.rules import default_missing_features
from tsengine.operators import clean as P
from tsengine.operators import joins as J
from tsengine.operators import summary as S
from tsengine.plans import fixtures
from tsengine.plans.oracle import BARS, BARS_DIRTY, INDICATORS, PREDS, PW
from tsengine.plans.registry import register

SW = SeriesWindow("series", "dt")
DIRTY_EXACT = ["series", "dt", "volume", "seq"]
DIRTY_COLS = "series, dt, open, high, low, close, volume, price, seq"
NUM = ["open", "high", "low", "close", "volume", "price"]
IND_NAMES = ["disc", "qty", "ret"]
# fixed values: message keywords (the reference's three plus two frequent words of the table)
KEYWORDS = ["gold", "price", "prediction", "und", "que"]


def _dedup(spark, d):
    return P.dedupe_first(fixtures.bars_dirty(spark, d), SW, ["seq"])


DEDUP_SQL = (f"WITH {BARS_DIRTY},\n dd AS (SELECT {DIRTY_COLS} FROM (SELECT *, row_number() OVER "
             f"(PARTITION BY series, dt ORDER BY seq) AS rn FROM bars_dirty) WHERE rn = 1)")


@register("p02_dedupe_first", DEDUP_SQL + "\nSELECT * FROM dd", exact=DIRTY_EXACT, ts=["dt"])
def q_dedupe(spark, d):
    return _dedup(spark, d)


def _ff(c):
    return f"last_value({c} IGNORE NULLS) OVER ({PW} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"


def _bf(c):
    return f"first_value({c} IGNORE NULLS) OVER ({PW} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"


@register("p04_ffill", DEDUP_SQL + f"\nSELECT series, dt, open, high, low, close, volume, {_ff('price')} AS price, seq FROM dd",
          exact=DIRTY_EXACT, ts=["dt"])
def q_ffill(spark, d):
    return P.ffill(_dedup(spark, d), SW, ["price"])


@register("p05_bfill", DEDUP_SQL + f"\nSELECT series, dt, open, high, low, close, volume, {_bf('price')} AS price, seq FROM dd",
          exact=DIRTY_EXACT, ts=["dt"])
def q_bfill(spark, d):
    return P.bfill(_dedup(spark, d), SW, ["price"])


@register("p06_fill_median",
          DEDUP_SQL + ",\n med AS (SELECT series, median(price) AS m FROM dd GROUP BY series)\n"
          "SELECT dd.series, dt, open, high, low, close, volume, coalesce(price, m) AS price, seq "
          "FROM dd LEFT JOIN med ON dd.series = med.series", exact=DIRTY_EXACT, ts=["dt"])
def q_median(spark, d):
    return P.fill_median(_dedup(spark, d), SW, ["price"])


@register("p07_fill_zero", DEDUP_SQL + "\nSELECT series, dt, open, high, low, close, volume, "
          "coalesce(price, 0.0) AS price, seq FROM dd", exact=DIRTY_EXACT, ts=["dt"])
def q_zero(spark, d):
    return P.fill_zero(_dedup(spark, d), ["price"])


OUTLIER_SQL = """,
 st AS (SELECT series, count(*) AS n, avg(price) AS m, stddev_samp(price) AS s FROM {src} GROUP BY series)
SELECT {cols} FROM {src} JOIN st USING (series)
WHERE NOT coalesce(n > 10 AND s > 0 AND (price < m - 3.0 * s OR price > m + 3.0 * s), false)"""


@register("p08_drop_outliers_3sigma",
          DEDUP_SQL + OUTLIER_SQL.format(src="dd", cols=DIRTY_COLS), exact=DIRTY_EXACT, ts=["dt"])
def q_outliers(spark, d):
    return P.drop_outliers_3sigma(_dedup(spark, d), SW, "price")


def _clean_chain_sql():
    fb = ", ".join(f"coalesce({_ff(c)}, {_bf(c)}) AS {c}" for c in NUM)
    return (DEDUP_SQL + f",\n fb AS (SELECT series, dt, {fb}, seq FROM dd)"
            + OUTLIER_SQL.format(src="fb", cols=DIRTY_COLS))


@register("p02_p08_clean_data", _clean_chain_sql(), exact=DIRTY_EXACT, ts=["dt"])
def q_clean(spark, d):
    """The reference's cleaning chain: dedupe -> ffill -> bfill -> median -> 3-sigma."""
    df = P.ffill_bfill(_dedup(spark, d), SW, NUM)
    df = P.fill_median(df, SW, NUM)
    return P.drop_outliers_3sigma(df, SW, "price")


@register("p09_drop_any_null", f"WITH {BARS_DIRTY}\nSELECT {DIRTY_COLS} FROM bars_dirty WHERE price IS NOT NULL",
          exact=DIRTY_EXACT, ts=["dt"])
def q_dropna(spark, d):
    return P.drop_any_null(fixtures.bars_dirty(spark, d))


@register("p12_p13_default_ohlc_envelope",
          f"WITH {BARS}\nSELECT series, dt, price, price AS open, greatest(price, price * 1.01, price * 0.99) AS high, "
          "least(price, price * 1.01, price * 0.99) AS low, price AS close, 1000::BIGINT AS volume FROM bars",
          exact=["series", "dt", "volume"], ts=["dt"])
def q_ohlc(spark, d):
    df = fixtures.bars(spark, d).select("series", "dt", "price")
    return P.fix_ohlc_envelope(P.default_ohlc(df))


@register("p15_trim_history",
          f"WITH {BARS}\nSELECT series, dt, open, high, low, close, volume, price FROM (SELECT *, "
          f"row_number() OVER ({PW}) - 1 AS i, count(*) OVER (PARTITION BY series) AS n FROM bars) WHERE i >= 60 AND i < n - 1",
          exact=["series", "dt", "volume"], ts=["dt"])
def q_trim(spark, d):
    return P.trim_history(fixtures.bars(spark, d), SW, 60, 1)


_WANTED = ["price", "ma_5", "volatility", "rsi", "bb_position", "volume_sma_20", "close_ema_12",
           "returns", "price_change", "macro_gdp"]


@register("p16_default_missing_features",
          f"WITH {BARS}\nSELECT series, dt, price, 2000.0 AS ma_5, 0.02 AS volatility, 50.0 AS rsi, 0.5 AS bb_position, "
          "1000000.0 AS volume_sma_20, 2000.0 AS close_ema_12, 0.01 AS returns, 2000.0 AS price_change, 2000.0 AS macro_gdp FROM bars",
          exact=["series", "dt"], ts=["dt"])
def q_defaults(spark, d):
    df = fixtures.bars(spark, d).select("series", "dt", "price")
    return default_missing_features(df, _WANTED, keep=["series", "dt"])


@register("p17_to_numeric",
          "SELECT event_id, TRY_CAST(json_extract_string(payload, '$.\"Global Quote\".\"05. price\"') AS DOUBLE) AS price "
          "FROM (" + "SELECT event_id, '{\"Global Quote\": {\"05. price\": \"' || printf('%.2f', value) || '\"}}' AS payload "
          "FROM events WHERE event_id % 4 = 2) WHERE price IS NOT NULL", exact=["event_id"])
def q_numeric(spark, d):
    raw = fixtures.raw_quotes(spark, d).filter(F.col("vendor") == "string_keyed")
    df = raw.select("event_id", F.get_json_object("payload", "$['Global Quote']['05. price']").alias("price"))
    return P.to_numeric(df, "price")


@register("p18_keyword_filter",
          "SELECT role AS \"user\", conv_id AS room, turn, text AS message FROM conversations WHERE "
          + " OR ".join(f"contains(lower(text), '{k}')" for k in KEYWORDS), exact=["user", "room", "turn", "message"],
          all_exact=True)
def q_keywords(spark, d):
    return P.keyword_filter(fixtures.messages(spark, d), "message", KEYWORDS)


@register("p20_null_profile",
          f"WITH {BARS_DIRTY}\nSELECT c AS \"column\", nulls::BIGINT AS nulls, rows::BIGINT AS rows, complete_rows::BIGINT AS complete_rows, "
          "(nulls = rows) AS all_null FROM (SELECT count(*) AS rows, count(*) FILTER (WHERE price IS NOT NULL) AS complete_rows, "
          "count(*) - count(price) AS p_n, count(*) - count(open) AS o_n FROM bars_dirty) t, "
          "LATERAL (VALUES ('open', o_n), ('price', p_n)) v(c, nulls)",
          exact=["column", "nulls", "rows", "complete_rows", "all_null"], all_exact=True)
def q_profile(spark, d):
    return P.null_profile(fixtures.bars_dirty(spark, d), ["open", "price"])


@register("p22_min_rows_guard",
          f"WITH {BARS},\n b AS (SELECT *, year(dt) AS yr FROM bars),\n ok AS (SELECT series, yr FROM b GROUP BY series, yr HAVING count(*) >= 200)\n"
          "SELECT b.series, dt, open, high, low, close, volume, price, b.yr FROM b SEMI JOIN ok ON b.series = ok.series AND b.yr = ok.yr",
          exact=["series", "dt", "volume", "yr"], ts=["dt"])
def q_guard(spark, d):
    df = fixtures.bars(spark, d).withColumn("yr", F.year("dt"))
    return P.min_rows_guard(df, SeriesWindow(["series", "yr"], "dt"), 200)


# ---- joins ---------------------------------------------------------------------------------------
WIDE_SQL = INDICATORS + ",\n wide AS (SELECT dt, " + ", ".join(
    f"max(CASE WHEN indicator = '{n}' THEN value END) AS {n}" for n in IND_NAMES) + " FROM indicators GROUP BY dt)"


@register("j01_merge_indicators",
          f"WITH {WIDE_SQL}\nSELECT dt, " + ", ".join(
              f"last_value({n} IGNORE NULLS) OVER (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {n}"
              for n in IND_NAMES) + " FROM wide", exact=["dt"], ts=["dt"])
def q_merge(spark, d):
    return J.merge_indicators(fixtures.indicators(spark, d), IND_NAMES)


@register("j01b_merge_indicators_outer",
          f"WITH {INDICATORS}\nSELECT coalesce(a.dt, b.dt) AS dt, a.value AS disc, b.value AS qty FROM "
          "(SELECT dt, value FROM indicators WHERE indicator = 'disc') a FULL OUTER JOIN "
          "(SELECT dt, value FROM indicators WHERE indicator = 'qty') b ON a.dt = b.dt", exact=["dt"], ts=["dt"])
def q_merge_outer(spark, d):
    ind = fixtures.indicators(spark, d)
    frames = [ind.filter(F.col("indicator") == n).select("dt", F.col("value").alias(n)) for n in ("disc", "qty")]
    return J.merge_indicators_outer(frames)


@register("j02_attach_indicators",
          f"WITH {BARS}, {WIDE_SQL},\n j AS (SELECT bars.*, wide.disc, wide.qty, wide.ret FROM bars LEFT JOIN wide ON bars.dt = wide.dt)\n"
          "SELECT series, dt, open, high, low, close, volume, price, " + ", ".join(f"{_ff(n)} AS {n}" for n in IND_NAMES)
          + " FROM j", exact=["series", "dt", "volume"], ts=["dt"])
def q_attach(spark, d):
    wide = J.pivot_indicators(fixtures.indicators(spark, d), IND_NAMES)
    return J.attach_indicators(fixtures.bars(spark, d), wide, SW, IND_NAMES)


def _asof_sql():
    parts = [f"WITH {BARS}, {INDICATORS}"]
    sel = ["b.series", "b.dt", "b.open", "b.high", "b.low", "b.close", "b.volume", "b.price"]
    joins = []
    for n in IND_NAMES:
        joins.append(f"ASOF LEFT JOIN (SELECT dt, value FROM indicators WHERE indicator = '{n}') i_{n} ON b.dt >= i_{n}.dt")
        sel.append(f"i_{n}.value AS {n}")
    return parts[0] + f"\nSELECT {', '.join(sel)} FROM bars b " + " ".join(joins)


@register("j03_attach_indicators_asof", _asof_sql(), exact=["series", "dt", "volume"], ts=["dt"])
def q_asof(spark, d):
    ind = fixtures.indicators(spark, d)
    wide = J.pivot_indicators(ind, IND_NAMES)
    return J.attach_indicators_asof(fixtures.bars(spark, d), wide, SW, IND_NAMES)


LATEST_SQL = """latest AS (SELECT source, arg_max(price, ts) AS price, max(ts) AS ts FROM
  (SELECT event_type AS source, value AS price, ts FROM events) GROUP BY source),
summary AS (SELECT round(avg(price), 2) AS average, max(price) AS highest, min(price) AS lowest,
  round(max(price) - min(price), 2) AS spread, count(*)::BIGINT AS sources_count, max(ts) AS ts FROM latest WHERE price > 0)"""


def _summary_row(spark, d):
    latest = S.latest_per_source(fixtures.quotes(spark, d), "source", "ts", ["price"])
    return S.cross_source_summary(latest)


@register("j04_message_price_context",
          f"WITH {LATEST_SQL}\nSELECT role AS \"user\", conv_id AS room, turn, text AS message, "
          "CASE WHEN " + " OR ".join(f"contains(lower(text), '{k}')" for k in KEYWORDS)
          + " THEN average END AS ctx_avg, CASE WHEN " + " OR ".join(f"contains(lower(text), '{k}')" for k in KEYWORDS)
          + " THEN ts END AS ctx_ts FROM conversations, summary",
          exact=["user", "room", "turn", "message", "ctx_ts"], ts=["ctx_ts"])
def q_context(spark, d):
    out = J.message_price_context(fixtures.messages(spark, d), _summary_row(spark, d), "message", KEYWORDS)
    return out.select("user", "room", "turn", "message", F.col("price_context.current_avg").alias("ctx_avg"),
                      F.col("price_context.timestamp").alias("ctx_ts"))


@register("j05_align_actuals",
          f"WITH {PREDS}\nSELECT p.series, p.dt, p.row_idx, p.y, p.model, p.pred, a.y AS actual FROM preds p "
          "JOIN (SELECT series, row_idx, y FROM pb) a ON a.series = p.series AND a.row_idx = p.row_idx + 2",
          exact=["series", "dt", "row_idx", "model"], ts=["dt"])
def q_align(spark, d):
    p = fixtures.preds(spark, d)
    actuals = p.select("series", "row_idx", "y").distinct()
    return J.align_actuals(p, actuals, SW, horizon=3)


@register("j06_collect_model_predictions",
          f"WITH {PREDS}\nSELECT series, dt, " + ", ".join(
              f"max(CASE WHEN model = '{m}' THEN pred END) AS {m}" for m in ("lag1", "sma5", "sma20"))
          + " FROM preds GROUP BY series, dt", exact=["series", "dt"], ts=["dt"])
def q_collect(spark, d):
    return J.collect_model_predictions(fixtures.preds(spark, d), ["series", "dt"], ["lag1", "sma5", "sma20"])


# ---- summaries -----------------------------------------------------------------------------------
@register("a01_price_summary",
          f"WITH {BARS_DIRTY}\nSELECT series, count(*) AS total_records, count(price) AS valid_price_records, "
          "min(dt) AS start_dt, max(dt) AS end_dt, arg_max(price, dt) FILTER (WHERE price IS NOT NULL) AS current, "
          "avg(price) AS mean, median(price) AS median, stddev_samp(price) AS std, min(price) AS min, max(price) AS max, "
          "100.0 * stddev_samp(price) / NULLIF(avg(price), 0) AS volatility_percent FROM "
          "(SELECT * FROM bars_dirty WHERE seq = 0) GROUP BY series",
          exact=["series", "total_records", "valid_price_records", "start_dt", "end_dt"], ts=["start_dt", "end_dt"])
def q_summary(spark, d):
    return S.price_summary(fixtures.bars_dirty(spark, d).filter("seq = 0"), SW)


def _valid_sql(extra):
    return (f"WITH {BARS_DIRTY},\n v AS (SELECT series, dt, price, {extra} FROM bars_dirty "
            "WHERE seq = 0 AND price IS NOT NULL)")


@register("a02_recent_change",
          _valid_sql(f"lag(price, 7) OVER ({PW}) AS b7, lag(price, 30) OVER ({PW}) AS b30")
          + "\nSELECT series, " + ", ".join(
              f"arg_max(price, dt) - arg_max(b{k}, dt) AS last_{k}_days_change, "
              f"(arg_max(price, dt) - arg_max(b{k}, dt)) / NULLIF(arg_max(b{k}, dt), 0) * 100.0 AS last_{k}_days_change_percent"
              for k in (7, 30)) + " FROM v GROUP BY series", exact=["series"])
def q_recent(spark, d):
    return S.recent_change(fixtures.bars_dirty(spark, d).filter("seq = 0"), SW)


@register("a03_tail_averages",
          _valid_sql(", ".join(f"avg(price) OVER ({PW} ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW) AS m{k}"
                               for k in (5, 10, 20)))
          + "\nSELECT series, " + ", ".join(f"CASE WHEN count(*) >= {k} THEN arg_max(m{k}, dt) END AS sma_{k}"
                                            for k in (5, 10, 20)) + " FROM v GROUP BY series", exact=["series"])
def q_tail(spark, d):
    return S.tail_averages(fixtures.bars_dirty(spark, d).filter("seq = 0"), SW)


@register("a04_latest_with_change",
          f"WITH {BARS},\n v AS (SELECT *, lag(price, 1) OVER ({PW}) AS prev FROM bars)\n"
          "SELECT series, arg_max(dt, dt) AS dt, arg_max(open, dt) AS open, arg_max(high, dt) AS high, arg_max(low, dt) AS low, "
          "arg_max(close, dt) AS close, arg_max(volume, dt) AS volume, arg_max(price, dt) AS price, "
          "coalesce(arg_max(price, dt) - arg_max(prev, dt), 0.0) AS change, "
          "CASE WHEN arg_max(prev, dt) IS NULL OR arg_max(prev, dt) = 0 THEN 0.0 ELSE (arg_max(price, dt) - arg_max(prev, dt)) "
          "/ arg_max(prev, dt) * 100.0 END AS change_percent FROM v GROUP BY series",
          exact=["series", "dt", "volume"], ts=["dt"])
def q_latest(spark, d):
    return S.latest_with_change(fixtures.bars(spark, d), SW)


@register("a05_weekly_change_trend",
          f"WITH {BARS},\n v AS (SELECT series, dt, price, lag(price, 6) OVER ({PW}) AS b FROM bars),\n"
          " l AS (SELECT series, arg_max(price, dt) AS p, coalesce(arg_max(b, dt), arg_max(price, dt)) AS b FROM v GROUP BY series)\n"
          "SELECT series, round(p, 2) AS current_price, round((p - b) / NULLIF(b, 0) * 100.0, 2) AS weekly_change, "
          "CASE WHEN p > b THEN 'up' ELSE 'down' END AS trend FROM l", exact=["series", "trend"])
def q_weekly(spark, d):
    return S.weekly_change_trend(fixtures.bars(spark, d), SW)


@register("a06_cross_source_summary", f"WITH {LATEST_SQL}\nSELECT * FROM summary", exact=["sources_count", "ts"], ts=["ts"])
def q_cross(spark, d):
    return _summary_row(spark, d)


@register("t02_latest_per_source", f"WITH {LATEST_SQL}\nSELECT source, ts, price FROM latest", exact=["source", "ts"], ts=["ts"])
def q_latest_src(spark, d):
    return S.latest_per_source(fixtures.quotes(spark, d), "source", "ts", ["price"])


PRIO_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in fixtures.SOURCE_PRIORITY.items()) + " ELSE 99 END"


@register("a07_pick_source",
          f"""WITH q AS (SELECT date_trunc('hour', ts) AS bucket, event_type AS source, value AS price, ts, {PRIO_SQL} AS priority FROM events),
 pick AS (SELECT bucket, source, price FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY priority, ts DESC) AS rn FROM q) WHERE rn = 1),
 buckets AS (SELECT unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket FROM q),
 j AS (SELECT b.bucket, p.source, p.price FROM buckets b LEFT JOIN pick p ON b.bucket = p.bucket)
SELECT bucket, source IS NOT NULL AS fresh,
  coalesce(last_value(source IGNORE NULLS) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'default') AS source,
  last_value(price IGNORE NULLS) OVER (ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS price FROM j""",
          exact=["bucket", "fresh", "source"], ts=["bucket"])
def q_pick(spark, d):
    q = fixtures.quotes(spark, d).withColumn("bucket", F.date_trunc("hour", "ts"))
    rng = q.agg(F.min("bucket").alias("lo"), F.max("bucket").alias("hi"))
    buckets = rng.select(F.explode(F.sequence("lo", "hi", F.expr("INTERVAL 1 HOUR"))).alias("bucket"))
    return S.pick_source(q, "bucket", buckets=buckets, default={"source": "default"})


@register("a21_a22_prediction_range",
          f"""WITH {PREDS},
 fc AS (SELECT series, dt, avg(pred) AS pred, stddev_pop(pred) AS pred_std, max(y) AS price FROM preds GROUP BY series, dt)
SELECT series, min(pred) AS min_prediction, max(pred) AS max_prediction, avg(pred) AS mean_prediction,
  avg(pred_std) AS avg_uncertainty, avg(pred_std) / NULLIF(arg_max(price, dt), 0) AS uncertainty_score,
  min(pred) * 0.95 AS band_lower, max(pred) * 1.05 AS band_upper FROM fc GROUP BY series""", exact=["series"])
def q_range(spark, d):
    p = fixtures.preds(spark, d)
    fc = p.groupBy("series", "dt").agg(F.avg("pred").alias("pred"), F.stddev_pop("pred").alias("pred_std"),
                                       F.max("y").alias("price"))
    return S.prediction_range(fc, ["series"])
