"""Output normalisation for cross-engine comparison (Spark result vs DuckDB oracle).

Both sides round every DOUBLE to 32 significant bits with the same exact IEEE steps, print
timestamps as text and widen integers to BIGINT, so an order-insensitive hash of the two results
agrees when the values agree to ~1e-8 relative.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SIG_BITS = 32    # significant bits kept (~9.6 decimal digits)
TINY = 1e-10     # magnitudes below this print as 0 (trig of exact multiples of pi etc.)
TS_FMT_SPARK = "yyyy-MM-dd HH:mm:ss"
TS_FMT_SQL = "%Y-%m-%d %H:%M:%S"


def sig_round(c):
    """Round to SIG_BITS significant *binary* digits: scaling by a power of two, floor(z + 0.5)
    and the inverse scaling are exact in IEEE arithmetic, so equal inputs give equal outputs in
    both engines, and decimal inputs never sit on a binary half-way point (no tie flips). Infinities
    become NaN, as the same steps make of them in SQL."""
    a = F.abs(c)
    p = F.pow(F.lit(2.0), F.lit(SIG_BITS) - F.floor(F.log2(a)))
    r = F.floor(a * p + F.lit(0.5)).cast("double") / p
    return F.when(a < F.lit(TINY), F.lit(0.0)).when(a == F.lit(float("inf")), F.lit(float("nan"))).otherwise(F.signum(c) * r)


def finish(df: DataFrame) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        t = f.dataType
        if isinstance(t, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = sig_round(c.cast("double"))
        elif isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, TS_FMT_SPARK)
        elif isinstance(t, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        out.append(c.alias(f.name))
    return df.select(*out)


SIG_SQL = (f"CASE WHEN abs(x) < {TINY!r} THEN 0.0 ELSE sign(x) * floor(abs(x) * pow(2, {SIG_BITS} - floor(log2(abs(x)))) + 0.5)"
           f" / pow(2, {SIG_BITS} - floor(log2(abs(x)))) END")


def wrap_sql(sql: str, exact: Sequence[str] = (), ts: Sequence[str] = (), all_exact: bool = False) -> str:
    """Outer select applying the same normalisation in DuckDB. ``exact``: non-DOUBLE columns
    (kept); ``ts``: timestamp columns (printed)."""
    keep = [f'strftime("{c}", \'{TS_FMT_SQL}\') AS "{c}"' if c in ts else f'"{c}"' for c in exact]
    if all_exact:
        return f"SELECT {', '.join(keep)} FROM ({sql}) AS q"
    ex = ", ".join(f"'{c}'" for c in exact) or "''"
    dbl = f"list_transform([COLUMNS(lambda c: c NOT IN ({ex}))], lambda x: {SIG_SQL})[1]"
    return f"SELECT {', '.join([*keep, dbl])} FROM ({sql}) AS q"
