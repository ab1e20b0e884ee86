"""Landed vendor quotes (S06–S09, C07, P19): four JSON layouts -> one quote schema.

Every layout is parsed with ``get_json_object`` / ``from_json`` on the executors; the union is
``unionByName(allowMissingColumns=True)``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: troy ounce in grams (per-gram feed conversion)
GRAMS_PER_OUNCE = 31.1035

QUOTE_COLS = ["event_id", "ts", "source", "price", "change", "change_percent", "high", "low", "open", "volume"]


def _num(path: str, col: str = "payload") -> Column:
    return F.get_json_object(F.col(col), path).try_cast("double")


def _round2(c: Column) -> Column:
    """Two digits as SQL's round on doubles: hundredths to the nearest whole, ties away from zero. Spark's
    round takes the shortest decimal text for the value and moves 9.245 (9.24499...) up."""
    return F.round(c * 100.0, 0) / 100.0


def _pct(price: Column, prev: Column) -> Column:
    change = price - prev
    return F.when(prev > 0, change / prev * 100.0).otherwise(F.lit(0.0))


def normalise_exchange(raw: DataFrame) -> DataFrame:
    """price = last close; change = price - previous close; % = 100 change / prev (0 when
    prev <= 0); all rounded to 2 digits."""
    p, prev = _num("$.close"), F.coalesce(_num("$.previousClose"), _num("$.close"))
    return raw.select("event_id", "ts", F.lit("exchange").alias("source"), _round2(p).alias("price"),
                      _round2(p - prev).alias("change"), _round2(_pct(p, prev)).alias("change_percent"),
                      _round2(_num("$.high")).alias("high"), _round2(_num("$.low")).alias("low"),
                      _round2(_num("$.open")).alias("open"), _num("$.volume").cast("long").alias("volume"))


def normalise_per_gram(raw: DataFrame) -> DataFrame:
    """Only ``success``; price = rate x 31.1035 (0 when rate <= 0), 2 digits."""
    ok = F.get_json_object(F.col("payload"), "$.success") == "true"
    rate = F.coalesce(_num("$.rates.XAU"), F.lit(0.0))
    price = F.when(rate > 0, rate * GRAMS_PER_OUNCE).otherwise(F.lit(0.0))
    return raw.filter(ok).select("event_id", "ts", F.lit("per_gram").alias("source"), _round2(price).alias("price"))


def strip_percent(c: Column) -> Column:
    """C07: '1.23%' -> 1.23."""
    return F.regexp_replace(c, "%", "").try_cast("double")


def normalise_string_keyed(raw: DataFrame) -> DataFrame:
    """Keys with spaces and dots ("05. price") — bracket JSON paths; percent text parsed."""
    g = "$['Global Quote']"
    price = F.coalesce(_num(f"{g}['05. price']"), F.lit(0.0))
    change = F.coalesce(_num(f"{g}['09. change']"), F.lit(0.0))
    pct = F.coalesce(strip_percent(F.get_json_object(F.col("payload"), f"{g}['10. change percent']")), F.lit(0.0))
    return raw.select("event_id", "ts", F.lit("string_keyed").alias("source"), _round2(price).alias("price"),
                      _round2(change).alias("change"), _round2(pct).alias("change_percent"))


def normalise_short_key(raw: DataFrame) -> DataFrame:
    """C / pc / h / l / o; missing h/l/o default to c, missing pc to c."""
    c = _num("$.c")
    pc = F.coalesce(_num("$.pc"), c)
    return raw.filter(c.isNotNull()).select(
        "event_id", "ts", F.lit("short_key").alias("source"), _round2(c).alias("price"),
        _round2(c - pc).alias("change"), _round2(_pct(c, pc)).alias("change_percent"),
        _round2(F.coalesce(_num("$.h"), c)).alias("high"), _round2(F.coalesce(_num("$.l"), c)).alias("low"),
        _round2(F.coalesce(_num("$.o"), c)).alias("open"))


def normalise_all(raw: DataFrame, vendor_col: str = "vendor") -> DataFrame:
    """T01 batch twin: every layout normalised and unioned by name."""
    parts = [normalise_exchange(raw.filter(F.col(vendor_col) == "exchange")),
             normalise_per_gram(raw.filter(F.col(vendor_col) == "per_gram")),
             normalise_string_keyed(raw.filter(F.col(vendor_col) == "string_keyed")),
             normalise_short_key(raw.filter(F.col(vendor_col) == "short_key"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out.select(*QUOTE_COLS)
