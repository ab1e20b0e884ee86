"""Calendar parts and cyclical encodings."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsengine.functions.core import col

TWO_PI = 2.0 * math.pi


def calendar_parts(dt: Column | str) -> dict[str, Column]:
    """Monday = 0 (``weekday``, not ``dayofweek``); ISO week."""
    d = col(dt)
    return {
        "year": F.year(d),
        "month": F.month(d),
        "day": F.dayofmonth(d),
        "day_of_week": F.weekday(d),
        "day_of_year": F.dayofyear(d),
        "week_of_year": F.weekofyear(d),
        "quarter": F.quarter(d),
    }


def cyclical(dt: Column | str, doy_period: float = 365.25) -> dict[str, Column]:
    """C02 (doy/365.25) and C03 (doy/365): sin/cos of month, weekday, day of year."""
    d = col(dt)
    m, dow, doy = F.month(d), F.weekday(d), F.dayofyear(d)
    return {
        "month_sin": F.sin(F.lit(TWO_PI) * m / 12.0),
        "month_cos": F.cos(F.lit(TWO_PI) * m / 12.0),
        "day_of_week_sin": F.sin(F.lit(TWO_PI) * dow / 7.0),
        "day_of_week_cos": F.cos(F.lit(TWO_PI) * dow / 7.0),
        "day_of_year_sin": F.sin(F.lit(TWO_PI) * doy / doy_period),
        "day_of_year_cos": F.cos(F.lit(TWO_PI) * doy / doy_period),
    }


def period_end_flags(dt: Column | str) -> dict[str, Column]:
    """Deliberately crude flags (day >= 28, quarter months, December)."""
    d = col(dt)
    return {
        "is_month_end": (F.dayofmonth(d) >= 28).cast("int"),
        "is_quarter_end": F.month(d).isin(3, 6, 9, 12).cast("int"),
        "is_year_end": (F.month(d) == 12).cast("int"),
    }


# fixed values: calendar defaults used when a frame has no date column
DEFAULT_MONTH = 6
DEFAULT_DAY_OF_YEAR = 180
DEFAULT_WEEK_OF_YEAR = 26
DEFAULT_QUARTER = 2


def default_calendar() -> dict[str, Column]:
    return {
        "month": F.lit(DEFAULT_MONTH),
        "day_of_year": F.lit(DEFAULT_DAY_OF_YEAR),
        "week_of_year": F.lit(DEFAULT_WEEK_OF_YEAR),
        "quarter": F.lit(DEFAULT_QUARTER),
        "month_cos": F.lit(math.cos(TWO_PI * DEFAULT_MONTH / 12)),
        "day_of_year_cos": F.lit(math.cos(TWO_PI * DEFAULT_DAY_OF_YEAR / 365)),
    }
