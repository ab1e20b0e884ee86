"""Registered queries of small operators: P01, P03 / O01, P14, P19, P21, C05, S02, T07."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tsengine.frames import SeriesWindow
from tsengine.functions.calendar import default_calendar
from tsengine.operators import clean as P
from tsengine.operators import summary as S
from tsengine.plans import bundles, fixtures
from tsengine.plans.oracle import BARS
from tsengine.plans.queries_io import ALL_QUOTES_SQL, BAR_EXACT
from tsengine.plans.registry import register
from tsengine.plans.sql_features import quick_features_sql
from tsengine.session import cut_lineage, ensure_checkpoint_dir
from tsengine.sources import bars as SB
from tsengine.sources import quotes as Q
from tsengine.streaming import jobs as T

SW = SeriesWindow("series", "dt")
LATER = "2024-02-15 00:00:00"  # after all events


@register("p01_ensure_price", f"WITH {BARS}\nSELECT series, dt, open, high, low, close, volume, close AS price FROM bars", exact=BAR_EXACT, ts=["dt"])
def q_price(spark, d):
    return P.ensure_price(fixtures.bars(spark, d).drop("price"))


@register("p03_o01_sort_by_time", f"WITH {BARS}\nSELECT series, dt, price, (row_number() OVER (ORDER BY series, dt) - 1)::BIGINT AS place FROM bars",
          exact=["series", "dt", "place"], ts=["dt"])
def q_sorted(spark, d):
    """The place of each row in the sorted output, from its place in its partition and the rows of the
    partitions before (one row a partition)."""
    out = P.sort_by_time(fixtures.bars(spark, d), SW).select("series", "dt", "price", F.monotonically_increasing_id().alias("at"))
    rows = cut_lineage(out).withColumn("part", F.shiftright("at", 33))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)
    base = sizes.select("part", (F.col("first") + F.col("n") - F.sum("n").over(upto)).alias("base"))
    return rows.join(base, "part").select("series", "dt", "price", (F.col("at") - F.col("base")).alias("place"))


@register("p14_select_features", f"SELECT * EXCLUDE (open, high, low, close, volume, price, target) FROM ({quick_features_sql()})", exact=["series", "dt"], ts=["dt"])
def q_select(spark, d):
    """The feature columns, found by type and name, of the W52 table."""
    q = bundles.quick_features(fixtures.bars(spark, d), SW)
    return q.select("series", "dt", *P.select_features(q))


@register("p19_project_quote_defaults",
          f"SELECT event_id, ts, source, price, coalesce(change, 0.0) AS change, coalesce(change_percent, 0.0) AS change_percent, coalesce(high, price) AS high, "
          f"coalesce(low, price) AS low, coalesce(open, price) AS open, coalesce(volume, 0)::BIGINT AS volume FROM ({ALL_QUOTES_SQL})",
          exact=["event_id", "ts", "source", "volume"], ts=["ts"])
def q_defaults(spark, d):
    return P.project_quote_defaults(Q.normalise_all(fixtures.raw_quotes(spark, d)))


@register("p21_drop_all_null_columns", f"WITH {BARS}\nSELECT * FROM bars", exact=BAR_EXACT, ts=["dt"])
def q_drop_null_columns(spark, d):
    """P21 on bars with two more columns that hold no value."""
    b = fixtures.bars(spark, d).withColumns({"spread": F.lit(None).cast("double"), "note": F.when(F.col("price") < 0, "x")})
    return P.drop_all_null_columns(b, P.null_profile(b))


@register("c05_default_calendar",
          f"WITH {BARS}\nSELECT series, price, 6::BIGINT AS month, 180::BIGINT AS day_of_year, 26::BIGINT AS week_of_year, 2::BIGINT AS quarter, "
          f"{math.cos(2 * math.pi * 6 / 12)!r}::DOUBLE AS month_cos, {math.cos(2 * math.pi * 180 / 365)!r}::DOUBLE AS day_of_year_cos FROM bars",
          exact=["series", "month", "day_of_year", "week_of_year", "quarter"])
def q_default_calendar(spark, d):
    return fixtures.bars(spark, d).select("series", "price", *[c.alias(n) for n, c in default_calendar().items()])


@register("s02_latest_file", f"WITH {BARS}\nSELECT series, dt, close AS price FROM bars WHERE dt >= TIMESTAMP '2000-01-01'", exact=["series", "dt"], ts=["dt"])
def q_latest_file(spark, d):
    """Of two files of bars, the one written last."""
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/files/{uuid.uuid4().hex}"
    b = fixtures.bars(spark, d).select("series", F.date_format("dt", "yyyy-MM-dd HH:mm:ss").alias("dt"), "price", (F.col("dt") < F.lit("2000-01-01").cast("timestamp_ntz")).alias("old"))
    for old in (True, False):
        b.where(F.col("old") == old).drop("old").coalesce(1).write.mode("append").option("header", True).csv(folder)
    path = SB.latest_file(spark, folder, "part-").first()["path"]
    rows = spark.read.schema("series string, dt string, price double").option("header", True).csv(path)
    return rows.withColumn("dt", F.to_timestamp("dt").cast("timestamp_ntz"))


@register("t07_scheduled_refresh", "SELECT event_type AS source, max(ts) AS ts, arg_max(value, ts) AS price FROM events GROUP BY event_type", exact=["source", "ts"], ts=["ts"])
def q_refresh(spark, d):
    """The refresh runs as its sources are older than 15 minutes at that time, and not again when the
    ledger tells of the refresh."""
    quotes = fixtures.quotes(spark, d)
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/refresh/{uuid.uuid4().hex}"
    ledger = quotes.select("source", F.col("ts").alias("refreshed_at"))
    fresh = quotes.select("source", F.lit(LATER).cast("timestamp_ntz").alias("refreshed_at"))

    def job(name):
        return lambda: S.latest_per_source(quotes, "source", "ts", ["price"]).write.parquet(f"{base}/{name}")
    ran = [T.scheduled_refresh(spark, ledger, LATER, 15, job("due")), T.scheduled_refresh(spark, fresh, LATER, 15, job("fresh"))]
    return spark.read.parquet(f"{base}/due").where(F.lit(ran == [True, False]))
