"""DuckDB oracle SQL for the registered queries (tables are the driver's parquet views).

Written from the operator semantics (pandas rolling rules), not generated from the Spark plans:
``count(x) >= k`` guards stand for ``min_periods``, ``NULLIF`` for ``try_divide``.
"""

from __future__ import annotations

import math

from tsengine.functions.core import ewm_frame_rows, span_alpha

PW = "PARTITION BY series ORDER BY dt"

BARS = """bars AS (
  SELECT o_orderpriority AS series, o_orderdate AS dt,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
         count(*)::BIGINT AS volume, arg_max(o_totalprice, o_orderkey) AS price
  FROM orders GROUP BY o_orderpriority, o_orderdate)"""

BARS_ONE = """bars AS (
  SELECT 'all' AS series, o_orderdate AS dt,
         arg_min(o_totalprice, o_orderkey) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, o_orderkey) AS close,
         count(*)::BIGINT AS volume, arg_max(o_totalprice, o_orderkey) AS price
  FROM orders GROUP BY o_orderdate)"""

BARS_DIRTY = BARS + """,
bars_n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY dt) AS rn FROM bars),
bars_u AS (
  SELECT series, dt, open, high, low, close, volume, price, 0::BIGINT AS seq FROM bars_n
  UNION ALL
  SELECT series, dt, open, high, low, close, volume, price + 1.0, 1::BIGINT AS seq FROM bars_n WHERE rn % 11 = 0),
bars_dirty AS (
  SELECT series, dt, open, high, low, close, volume,
         CASE WHEN day(dt) % 7 = 0 THEN NULL WHEN dayofyear(dt) = 200 THEN price * 50.0 ELSE price END AS price,
         seq
  FROM bars_u)"""

INDICATORS = """ind_daily AS (
  SELECT l_shipdate AS dt, avg(l_discount) AS disc, sum(l_quantity) AS qty,
         avg(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END) AS ret
  FROM lineitem GROUP BY l_shipdate),
indicators AS (
  SELECT 'disc' AS indicator, dt, disc AS value FROM ind_daily
  UNION ALL SELECT 'qty', dt, qty FROM ind_daily WHERE day(dt) % 5 <> 0
  UNION ALL SELECT 'ret', dt, ret FROM ind_daily)"""

PREDS = BARS + f""",
pb AS (
  SELECT series, dt, price AS y, (row_number() OVER ({PW}) - 1)::BIGINT AS row_idx,
         lag(price, 1) OVER ({PW}) AS lag1,
         avg(price) OVER ({PW} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS sma5,
         avg(price) OVER ({PW} ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS sma20
  FROM bars),
preds AS (
  SELECT series, dt, row_idx, y, 'lag1' AS model, lag1 AS pred FROM pb WHERE lag1 IS NOT NULL
  UNION ALL SELECT series, dt, row_idx, y, 'sma5', sma5 FROM pb WHERE sma5 IS NOT NULL
  UNION ALL SELECT series, dt, row_idx, y, 'sma20', sma20 FROM pb WHERE sma20 IS NOT NULL)"""


def _b(x) -> str:
    if x is None:
        return "UNBOUNDED"
    return x


def rows(a: int | None, b: int | None, pw: str = PW) -> str:
    def bound(v, lo):
        if v is None:
            return "UNBOUNDED PRECEDING" if lo else "UNBOUNDED FOLLOWING"
        if v == 0:
            return "CURRENT ROW"
        return f"{-v} PRECEDING" if v < 0 else f"{v} FOLLOWING"
    return f"({pw} ROWS BETWEEN {bound(a, True)} AND {bound(b, False)})"


def incl(k: int) -> str:
    return rows(-(k - 1), 0)


def past(k: int) -> str:
    return rows(-k, -1)


def lag(x: str, k: int, pw: str = PW) -> str:
    return f"lag({x}, {k}) OVER ({pw})"


def lead(x: str, k: int, pw: str = PW) -> str:
    return f"lead({x}, {k}) OVER ({pw})"


def mp(agg: str, x: str, frame: str, k: int) -> str:
    if k <= 0:
        return f"{agg}({x}) OVER {frame}"
    return f"(CASE WHEN count({x}) OVER {frame} >= {k} THEN {agg}({x}) OVER {frame} END)"


def div(a: str, b: str) -> str:
    return f"(({a}) / NULLIF(({b}), 0))"


def ln(x: str) -> str:
    return f"ln(CASE WHEN ({x}) > 0 THEN ({x}) END)"


MEDIAN = "median"


def ewm(x: str, span: float, pw: str = PW) -> str:
    """pandas adjust=True EWM over the bounded exact frame; weights by position from the end."""
    a = span_alpha(span)
    w = 1.0 - a
    k = ewm_frame_rows(a)
    fr = rows(-k, 0, pw)
    lst = f"list({x}) OVER {fr}"
    # Horner order (oldest first): acc * w + v, the same operation sequence as the Spark fold
    num = f"list_reduce(list_transform({lst}, lambda v: coalesce(v, 0.0::DOUBLE)), lambda acc, v: acc * {w!r}::DOUBLE + v)"
    den = (f"list_reduce(list_transform({lst}, lambda v: CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END), "
           f"lambda acc, v: acc * {w!r}::DOUBLE + v)")
    return (f"(CASE WHEN count({x}) OVER ({pw} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) >= 1 "
            f"THEN {num} / NULLIF({den}, 0) END)")


SQRT252 = repr(math.sqrt(252.0))
TWO_PI = repr(2.0 * math.pi)
