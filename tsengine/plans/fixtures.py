"""Views derived from the driver tables (see FIXTURES.md §B).

``orders`` become daily bars per priority (the series key), ``lineitem`` by ship date the
external indicator table, ``events`` the tick / quote stream, ``conversations`` the message
table. Every view is a lazy DataFrame over the whole table, so its work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tsengine.operators.bars import ohlcv


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """``table`` as a stream, be it one file or a folder of files. A streaming source wants a folder or a
    pattern: the pattern here matches the table's own path only."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """series, dt, open, high, low, close, volume, price — one row per (priority, order date)."""
    o = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("series"), "o_orderdate", "o_orderkey", "o_totalprice")
    return ohlcv(o, ["series"], "o_orderdate", "o_totalprice", "o_orderkey").select(
        "series", "dt", "open", "high", "low", "close", "volume", "price")


def bars_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long series (all priorities together): the reference's own single-series case."""
    o = table(spark, sf_dir, "orders").select(
        F.lit("all").alias("series"), "o_orderdate", "o_orderkey", "o_totalprice")
    return ohlcv(o, ["series"], "o_orderdate", "o_totalprice", "o_orderkey").select(
        "series", "dt", "open", "high", "low", "close", "volume", "price")


def bars_dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``bars`` with holes and faults for the cleaning operators: price NULL on days divisible
    by 7, every 11th bar of a series duplicated (``seq`` = 1, price + 1) and price x50 on day of
    year 200. ``seq`` is the input order used by first-row dedupe."""
    b = bars(spark, sf_dir)
    rn = F.row_number().over(Window.partitionBy("series").orderBy("dt"))
    b = b.withColumn("_rn", rn)
    dup = b.filter(F.col("_rn") % 11 == 0).withColumn("seq", F.lit(1).cast("long")).withColumn(
        "price", F.col("price") + 1.0)
    out = b.withColumn("seq", F.lit(0).cast("long")).unionByName(dup).drop("_rn")
    price = (F.when(F.dayofmonth("dt") % 7 == 0, F.lit(None).cast("double"))
              .when(F.dayofyear("dt") == 200, F.col("price") * 50.0)
              .otherwise(F.col("price")))
    return out.withColumn("price", price)


def indicators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long indicator table (indicator, dt, value): mean discount, quantity (missing on days
    divisible by 5) and share of returned lines, per ship date."""
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("dt"), "l_discount", "l_quantity", "l_returnflag")
    daily = li.groupBy("dt").agg(
        F.avg("l_discount").alias("disc"),
        F.sum("l_quantity").alias("qty"),
        F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0)).alias("ret"))
    long = daily.select("dt", F.expr("stack(3, 'disc', disc, 'qty', qty, 'ret', ret) as (indicator, value)"))
    return long.filter(~((F.col("indicator") == "qty") & (F.dayofmonth("dt") % 5 == 0))).select(
        "indicator", "dt", "value")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("series"), "ts", F.col("value").alias("price"),
                    F.lit(1).cast("long").alias("size"), F.col("event_id").alias("seq"))


# fixed values: source preference order of the quote picker (A07), 1 = preferred
SOURCE_PRIORITY = {"purchase": 1, "click": 2, "view": 3, "signup": 4, "error": 5}


def quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pr = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in SOURCE_PRIORITY.items()],
                    F.lit(99))
    return e.select("event_id", F.col("event_type").alias("source"), F.col("value").alias("price"),
                    "ts", pr.alias("priority"), "user_id")


def _ratio_text(a: Column, b: Column, scale: float) -> Column:
    """scale * a / b as text with 4 digits; over zero inf, -inf or nan, as IEEE division gives them."""
    over_zero = F.when(a > 0, "inf").when(a < 0, "-inf").otherwise("nan")
    return F.when(b == 0, over_zero).otherwise(F.format_string("%.4f", F.try_divide(a, b) * scale))


def raw_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes landed as JSON text in four vendor layouts (layout = event_id mod 4):
    0 exchange feed (close, previousClose, high, low, open, volume), 1 per-gram feed
    (success, rates.XAU), 2 string-keyed feed ("Global Quote" with "05. price", "09. change",
    "10. change percent" as text with %), 3 short-key feed (c, pc, optional h/l/o)."""
    e = table(spark, sf_dir, "events")
    v = F.col("value")
    pc = F.round(v - (F.col("user_id") % 7) + 3.0, 2)
    s = lambda c: F.format_string("%.2f", c)
    layout = F.pmod(F.col("event_id"), F.lit(4))
    j0 = F.concat(F.lit('{"close": '), s(v), F.lit(', "previousClose": '), s(pc),
                  F.lit(', "high": '), s(v + 1.0), F.lit(', "low": '), s(v - 1.0),
                  F.lit(', "open": '), s(pc), F.lit(', "volume": '), F.col("user_id").cast("string"),
                  F.lit("}"))
    j1 = F.concat(F.lit('{"success": '), F.when(F.col("user_id") % 5 == 0, "false").otherwise("true"),
                  F.lit(', "rates": {"XAU": '), F.format_string("%.6f", v / 31.1035 - 0.05),
                  F.lit("}}"))
    j2 = F.concat(F.lit('{"Global Quote": {"05. price": "'), s(v), F.lit('", "09. change": "'),
                  s(v - pc), F.lit('", "10. change percent": "'), _ratio_text(v - pc, pc, 100.0),
                  F.lit('%"}}'))
    hlo = F.when(F.col("user_id") % 3 == 0, F.lit("")).otherwise(
        F.concat(F.lit(', "h": '), s(v + 2.0), F.lit(', "l": '), s(v - 2.0), F.lit(', "o": '), s(pc)))
    j3 = F.concat(F.lit('{"c": '), s(v), F.lit(', "pc": '), s(pc), hlo, F.lit("}"))
    vendor = (F.when(layout == 0, "exchange").when(layout == 1, "per_gram")
              .when(layout == 2, "string_keyed").otherwise("short_key"))
    body = F.when(layout == 0, j0).when(layout == 1, j1).when(layout == 2, j2).otherwise(j3)
    return e.select("event_id", "ts", vendor.alias("vendor"), body.alias("payload"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("role").alias("user"), F.col("conv_id").alias("room"), "turn",
                    F.col("text").alias("message"))


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic pseudo-model predictions (lag1 / SMA5 / SMA20) next to the actual price,
    long form (series, dt, row_idx, model, pred, y). Rows where a model has no value yet are
    dropped per model."""
    b = bars(spark, sf_dir)
    w = Window.partitionBy("series").orderBy("dt")
    b = b.select("series", "dt", F.col("price").alias("y"),
                 (F.row_number().over(w) - 1).cast("long").alias("row_idx"),
                 F.lag("price", 1).over(w).alias("lag1"),
                 F.avg("price").over(w.rowsBetween(-5, -1)).alias("sma5"),
                 F.avg("price").over(w.rowsBetween(-20, -1)).alias("sma20"))
    long = b.select("series", "dt", "row_idx", "y",
                    F.expr("stack(3, 'lag1', lag1, 'sma5', sma5, 'sma20', sma20) as (model, pred)"))
    return long.filter(F.col("pred").isNotNull())
