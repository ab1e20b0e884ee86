"""Null-exact arithmetic helpers.

Spark 4 runs ANSI mode, where ``x / 0.0`` raises. pandas returns inf/NaN instead; the library
maps every undefined value to NULL (never NaN) so sinks and comparisons see one missing marker.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8  # fixed value: the reference adds 1e-8 to divisors of "soft" ratios


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def safe_div(a: Column | str, b: Column | str) -> Column:
    """a / b, NULL when b is 0 or NULL (``try_divide``)."""
    return F.try_divide(col(a), col(b))


def ratio_minus_one(a: Column | str, b: Column | str) -> Column:
    return safe_div(a, b) - F.lit(1.0)


def safe_ln(x: Column | str) -> Column:
    c = col(x)
    return F.when(c > 0, F.ln(c))


def nan_to_null(x: Column | str) -> Column:
    c = col(x)
    return F.when(~F.isnan(c), c)


def strict_greatest(*cols: Column) -> Column:
    """``np.maximum`` semantics: NULL if any input is NULL (Spark ``greatest`` skips NULLs)."""
    any_null = None
    for c in cols:
        any_null = c.isNull() if any_null is None else (any_null | c.isNull())
    return F.when(~any_null, F.greatest(*cols))


def sign(x: Column | str) -> Column:
    return F.signum(col(x))


def ewm_frame_rows(alpha: float, tol: float = 1e-17) -> int:
    """Rows after which an exponential weight (1-alpha)^i drops below ``tol`` relative to 1:
    beyond this the older terms cannot change a double result."""
    return int(math.ceil(math.log(tol) / math.log(1.0 - alpha)))


def span_alpha(span: float) -> float:
    return 2.0 / (span + 1.0)
