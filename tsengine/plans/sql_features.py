"""Oracle SQL for the feature bundles (W48–W52) and single window operators."""

from __future__ import annotations

from tsengine.plans.oracle import (BARS, MEDIAN, PW, SQRT252, TWO_PI, div, ewm, incl, lag, lead, ln,
                                   mp, past, rows)

EPS = "1e-8"


def not_null(cols) -> str:
    return " AND ".join(f'"{c}" IS NOT NULL' for c in cols)


def quick_features_sql(bars_cte: str = BARS) -> str:
    cols = {
        "ma_5": mp("avg", "price", incl(5), 5),
        "ma_10": mp("avg", "price", incl(10), 10),
        "ma_20": mp("avg", "price", incl(20), 20),
        "price_change": f"{div('price', lag('price', 1))} - 1.0",
        "price_change_5": f"{div('price', lag('price', 5))} - 1.0",
        "volatility": mp("stddev_samp", "price", incl(10), 10),
        "price_lag_1": lag("price", 1), "price_lag_2": lag("price", 2), "price_lag_3": lag("price", 3),
        "target": lead("price", 1),
    }
    sel = ",\n  ".join(f"{v} AS {k}" for k, v in cols.items())
    return (f"WITH {bars_cte},\nf AS (SELECT series, dt, open, high, low, close, volume, price,\n  {sel}\n"
            f"FROM bars)\nSELECT * FROM f WHERE {not_null(cols)}")


PAST_LAGS = (1, 2, 3, 5, 7, 10, 14, 21, 30)
PAST_WINDOWS = (3, 5, 7, 10, 14, 21, 30, 60)


def engineer_past_sql(bars_cte: str = BARS, horizon: int = 1, min_history: int = 60) -> tuple[str, list[str]]:
    p = "price"
    l1 = lag(p, 1)
    s1 = {
        "day_of_week": "(isodow(dt) - 1)", "month": "month(dt)", "quarter": "quarter(dt)",
        "year": "year(dt)", "day_of_year": "dayofyear(dt)",
    }
    s1["day_of_week_sin"] = f"sin({TWO_PI} * (isodow(dt) - 1) / 7)"
    s1["day_of_week_cos"] = f"cos({TWO_PI} * (isodow(dt) - 1) / 7)"
    s1["month_sin"] = f"sin({TWO_PI} * month(dt) / 12)"
    s1["month_cos"] = f"cos({TWO_PI} * month(dt) / 12)"
    s1["day_of_year_sin"] = f"sin({TWO_PI} * dayofyear(dt) / 365)"
    s1["day_of_year_cos"] = f"cos({TWO_PI} * dayofyear(dt) / 365)"
    for k in PAST_LAGS:
        s1[f"price_lag_{k}"] = lag(p, k)
    for k in PAST_WINDOWS:
        f, m = past(k), max(1, k // 2)
        mn, mx = mp("min", p, f, m), mp("max", p, f, m)
        s1[f"price_sma_{k}"] = mp("avg", p, f, m)
        s1[f"price_std_{k}"] = mp("stddev_samp", p, f, m)
        s1[f"price_min_{k}"] = mn
        s1[f"price_max_{k}"] = mx
        s1[f"price_median_{k}"] = mp(MEDIAN, p, f, m)
        s1[f"price_position_{k}"] = f"({l1} - {mn}) / ({mx} - {mn} + {EPS})"
    # helper columns (dropped later)
    d = f"({l1} - {lag(p, 2)})"
    h = {"_g": f"CASE WHEN {d} > 0 THEN {d} ELSE 0.0 END",
         "_l": f"CASE WHEN {d} < 0 THEN -{d} ELSE 0.0 END",
         "_p1": l1,
         "_tr": (f"CASE WHEN {lag('high', 1)} IS NULL OR {lag('low', 1)} IS NULL OR {lag(p, 2)} IS NULL "
                 f"THEN NULL ELSE greatest({lag('high', 1)} - {lag('low', 1)}, abs({lag('high', 1)} - {lag(p, 2)}), "
                 f"abs({lag('low', 1)} - {lag(p, 2)})) END"),
         "_r": f"{div(l1, lag(p, 2))} - 1.0"}
    for w in (20, 50):
        f = past(w)
        mid, sd = mp("avg", p, f, 1), mp("stddev_samp", p, f, 1)
        up, lo = f"({mid} + 2.0 * {sd})", f"({mid} - 2.0 * {sd})"
        s1[f"bb_upper_{w}"] = up
        s1[f"bb_lower_{w}"] = lo
        s1[f"bb_width_{w}"] = f"({up} - {lo})"
        s1[f"bb_position_{w}"] = f"({l1} - {lo}) / (({up} - {lo}) + {EPS})"
    ll, hh = mp("min", "low", past(14), 1), mp("max", "high", past(14), 1)
    s1["stoch_k"] = f"100.0 * ({l1} - {ll}) / ({hh} - {ll} + {EPS})"
    s1["williams_r"] = f"-100.0 * ({hh} - {l1}) / ({hh} - {ll} + {EPS})"
    for k in PAST_LAGS:
        r = div(l1, lag(p, k + 1))
        s1[f"return_{k}d"] = f"{r} - 1.0"
        s1[f"log_return_{k}d"] = ln(r)
    for k in (5, 10, 20, 50):
        s1[f"momentum_{k}"] = f"{div(l1, lag(p, k + 1))} - 1.0"
    for k in (5, 10, 20):
        s1[f"roc_{k}"] = f"{div(f'{l1} - {lag(p, k + 1)}', lag(p, k + 1))} * 100.0"

    s2 = {}
    for k in (14, 30):
        rs = f"({mp('avg', '_g', incl(k), 1)} / ({mp('avg', '_l', incl(k), 1)} + {EPS}))"
        s2[f"rsi_{k}"] = f"100.0 - 100.0 / (1.0 + {rs})"
    s2["_e12"] = ewm("_p1", 12)
    s2["_e26"] = ewm("_p1", 26)
    s2["stoch_d"] = mp("avg", "stoch_k", incl(3), 1)
    s2["atr"] = mp("avg", "_tr", incl(14), 1)
    for k in (5, 10, 20, 30, 60):
        m = max(1, k // 2)
        s2[f"volatility_{k}"] = f"{mp('stddev_samp', '_r', incl(k), m)} * {SQRT252}"
        s2[f"realized_vol_{k}"] = mp("sum", "_r * _r", incl(k), m)
    s2["vol_clustering"] = mp("avg", "abs(_r)", incl(10), 1)
    s3 = {"macd": "_e12 - _e26"}
    s4 = {"macd_signal": ewm("macd", 9)}
    s5 = {"macd_histogram": "macd - macd_signal"}
    inter_in = [f"price_sma_{k}" for k in PAST_WINDOWS] + ["rsi_14", "rsi_30"]
    inter = {}
    for i, a in enumerate(inter_in):
        for b in inter_in[i + 1:]:
            if len(inter) < 15:
                inter[f"{a}_x_{b}"] = f"{a} * {b}"
    s5.update(inter)
    s5["target"] = lead(p, horizon)
    s5["_idx"] = f"row_number() OVER ({PW}) - 1"
    s5["_n"] = "count(*) OVER (PARTITION BY series)"

    order = (list(s1)[:11] + [f"price_lag_{k}" for k in PAST_LAGS]
             + [c for c in s1 if c.startswith("price_") and not c.startswith("price_lag_")]
             + ["rsi_14", "rsi_30", "macd", "macd_signal", "macd_histogram"]
             + [f"bb_{x}_{w}" for w in (20, 50) for x in ("upper", "lower", "width", "position")]
             + ["stoch_k", "stoch_d", "williams_r", "atr"]
             + [c for c in s1 if c.startswith(("return_", "log_return_", "momentum_", "roc_"))]
             + [c for c in s2 if c.startswith(("volatility_", "realized_vol_"))] + ["vol_clustering"]
             + list(inter))

    def sel(d):
        return ",\n  ".join(f"{v} AS {k}" for k, v in d.items())

    sql = (f"WITH {bars_cte},\n"
           f"s1 AS (SELECT *, {sel(h)},\n  {sel(s1)} FROM bars),\n"
           f"s2 AS (SELECT *, {sel(s2)} FROM s1),\n"
           f"s3 AS (SELECT *, {sel(s3)} FROM s2),\n"
           f"s4 AS (SELECT *, {sel(s4)} FROM s3),\n"
           f"s5 AS (SELECT *, {sel(s5)} FROM s4)\n"
           f"SELECT series, dt, {', '.join(order)}, target FROM s5\n"
           f"WHERE _idx >= {min_history} AND _idx < _n - {horizon} AND {not_null(order + ['target'])}")
    return sql, order


BAR_COLS = ["series", "dt", "open", "high", "low", "close", "volume", "price"]


def staged_sql(stages: list[dict[str, str]], cte: str = BARS, src: str = "bars",
               keep: list[str] | None = None, where: str | None = None) -> str:
    """Nested selects, one per stage (a later stage may read earlier columns); the final
    projection keeps ``keep`` + every stage column not starting with '_'."""
    parts, prev = [], src
    for i, st in enumerate(stages):
        sel = ",\n  ".join(f"{v} AS {k}" for k, v in st.items())
        parts.append(f"st{i} AS (SELECT *, {sel} FROM {prev})")
        prev = f"st{i}"
    out_cols = list(keep if keep is not None else BAR_COLS)
    out_cols += [k for st in stages for k in st if not k.startswith("_") and k not in out_cols]
    sql = f"WITH {cte},\n" + ",\n".join(parts) + f"\nSELECT {', '.join(out_cols)} FROM {prev}"
    if where:
        sql += f"\nWHERE {where}"
    return sql
