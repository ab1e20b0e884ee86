"""Recursive forecasts of a model ensemble (E12), as one fold over the steps of a series.

What a step needs of the past is a bounded tail of prices. The tail, the models of the series and the
forecasts made so far are the state of ``aggregate`` over the steps, so the recursion runs inside
Spark's expressions, in parallel over series, one row each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Features = dict[str, Callable[[Column], Column]]


def _last(p: Column, k: int) -> Column:
    return F.element_at(p, -k)


def _mean(p: Column, k: int) -> Column:
    return F.aggregate(F.slice(p, -k, k), F.lit(0.0), lambda a, x: a + x) / k


def _std(p: Column, k: int) -> Column:
    mean = _mean(p, k)
    return F.sqrt(F.aggregate(F.slice(p, -k, k), F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / (k - 1))


def _change(p: Column, k: int) -> Column:
    return F.try_divide(_last(p, 1), _last(p, k + 1)) - 1.0


#: W52 features of the last price of a tail (oldest first), and the prices they need.
QUICK: Features = {
    "ma_5": lambda p: _mean(p, 5), "ma_10": lambda p: _mean(p, 10), "ma_20": lambda p: _mean(p, 20),
    "price_change": lambda p: _change(p, 1), "price_change_5": lambda p: _change(p, 5), "volatility": lambda p: _std(p, 10),
    "price_lag_1": lambda p: _last(p, 2), "price_lag_2": lambda p: _last(p, 3), "price_lag_3": lambda p: _last(p, 4),
}
QUICK_TAIL = 20


def tails(bars: DataFrame, keys: Sequence[str], rows: int, time_col: str = "dt", price: str = "price") -> DataFrame:
    """keys, last time and the last ``rows`` prices of each series (oldest first); a series with fewer has
    no row. The rank limit prunes rows before they are shuffled, so a long series costs ``rows`` a task."""
    newest = Window.partitionBy(*keys).orderBy(F.col(time_col).desc())
    last = (bars.where(F.col(price).isNotNull()).select(*keys, time_col, price).withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= rows))
    got = last.groupBy(*keys).agg(F.max(time_col).alias("last"), F.sort_array(F.collect_list(F.struct(time_col, F.col(price).cast("double").alias("p")))).alias("t"))
    return got.where(F.size("t") == rows).select(*keys, "last", F.col("t.p").alias("tail"))


def top_models(table: DataFrame, keys: Sequence[str], features: Sequence[str], target: str, n: int = 5) -> DataFrame:
    """Per series, the ``n`` best single-feature least-squares models by R² on ``table``, of equals the first
    by name: an array of (r2, name, intercept, coef by feature). One aggregation, no model leaves Spark."""
    fits = table.groupBy(*keys).agg(*[f(F.col(target), F.col(c)).alias(f"{f.__name__}_{c}") for c in features for f in (F.regr_r2, F.regr_slope, F.regr_intercept)])
    each = [F.struct((-F.col(f"regr_r2_{c}")).alias("neg"), F.lit(c).alias("name"), F.col(f"regr_intercept_{c}").alias("intercept"),
                     F.array(*[F.col(f"regr_slope_{c}") if d == c else F.lit(0.0) for d in features]).alias("coef")) for c in features]
    whole = F.filter(F.array(*each), lambda m: m["neg"].isNotNull() & m["intercept"].isNotNull())
    return fits.select(*keys, F.slice(F.array_sort(whole), 1, n).alias("models"))


def ensemble_forecast(state: DataFrame, keys: Sequence[str], features: Features, steps: int, level: float = 0.95) -> DataFrame:
    """keys, step, dt, forecast, std, lower, upper: each step's forecast is the mean of the models' values
    at the features of the tail, the band is mean -+ z times their (population) deviation, and the
    mean is the tail's next price. ``state``: keys, last, tail, models. No models: no forecasts."""
    z = NormalDist().inv_cdf(0.5 + level / 2.0)
    out = "array<struct<forecast:double,std:double>>"
    start = F.struct(F.col("tail").alias("tail"), F.array().cast(out).alias("out"))

    def step(s: Column, _: Column) -> Column:
        x = F.array(*[f(s["tail"]) for f in features.values()])
        values = F.transform(F.col("models"), lambda m: m["intercept"] + F.aggregate(
            F.zip_with(m["coef"], x, lambda b, v: F.when(b == 0, F.lit(0.0)).otherwise(b * v)), F.lit(0.0), lambda a, v: a + v))
        return F.transform(F.array(values), lambda v: _advance(s, v))[0]

    def _advance(s: Column, v: Column) -> Column:
        n = F.size(v)
        mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n
        return F.transform(F.array(mean), lambda m: F.struct(
            F.concat(F.slice(s["tail"], 2, F.size(s["tail"]) - 1), F.array(m)).alias("tail"),
            F.concat(s["out"], F.array(F.struct(m.alias("forecast"), F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / n).alias("std")))).alias("out")))[0]

    done = state.where(F.size("models") > 0).select(*keys, "last", F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)["out"].alias("out"))
    rows = done.select(*keys, "last", F.posexplode("out").alias("at", "o"))
    return rows.select(*keys, (F.col("at") + 1).alias("step"), (F.col("last") + F.make_interval(days=F.col("at") + 1)).alias("dt"),
                       F.col("o.forecast").alias("forecast"), F.col("o.std").alias("std"),
                       (F.col("o.forecast") - z * F.col("o.std")).alias("lower"), (F.col("o.forecast") + z * F.col("o.std")).alias("upper"))
