"""Default values for features a model expects but a frame lacks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: ordered name rules (first substring match wins) -> default constant
DEFAULT_RULES: list[tuple[tuple[str, ...], float]] = [
    (("price", "close"), 2000.0),
    (("open", "high", "low"), 2000.0),
    (("volume",), 1000000.0),
    (("sma", "ema", "ma"), 2000.0),
    (("bb",), 0.5),
    (("rsi",), 50.0),
    (("volatility", "std"), 0.02),
    (("return", "change"), 0.01),
]
FALLBACK = 0.0


def default_for(name: str) -> float:
    low = name.lower()
    for keys, value in DEFAULT_RULES:
        if any(k in low for k in keys):
            return value
    return FALLBACK


def default_missing_features(df: DataFrame, wanted: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Select ``keep`` + ``wanted`` in order; a wanted column the frame lacks becomes the
    constant of the first matching rule (a literal — no data pass)."""
    have = set(df.columns)
    cols = [F.col(c) for c in keep]
    cols += [F.col(c) if c in have else F.lit(default_for(c)).alias(c) for c in wanted]
    return df.select(*cols)
