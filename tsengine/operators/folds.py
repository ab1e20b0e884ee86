"""Temporal splits as fold tables.

A fold table has one row per (series, fold): ``train_from, train_to, test_from, test_to``
(half-open row-position ranges). It is generated from the per-series row count with
``sequence``/``explode`` (rows = series x folds, never data rows), then joined to the data on
the series key with a range condition on the row position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsengine.frames import SeriesWindow

FOLD_COLS = ["fold", "train_from", "train_to", "test_from", "test_to"]


def series_counts(df: DataFrame, sw: SeriesWindow) -> DataFrame:
    return df.groupBy(*sw.series_cols).agg(F.count(F.lit(1)).alias("n"))


def _finish(t: DataFrame, keys: Sequence[str]) -> DataFrame:
    return t.select(*keys, F.col("fold").cast("long").alias("fold"),
                    *[F.col(c).cast("long").alias(c) for c in FOLD_COLS[1:]],
                    (F.col("train_to") - F.col("train_from")).cast("long").alias("train_size"),
                    (F.col("test_to") - F.col("test_from")).cast("long").alias("test_size"))


def _fold_rows(counts: DataFrame, keys, n_folds: Column) -> DataFrame:
    return counts.select(*keys, "n", F.explode(F.sequence(F.lit(0), n_folds - 1)).alias("fold"))


def holdout(counts: DataFrame, keys: Sequence[str], test_frac: float = 0.2) -> DataFrame:
    """First floor(n (1 - test)) rows train, the rest test."""
    cut = F.floor(F.col("n") * (1.0 - test_frac))
    t = counts.select(*keys, F.lit(0).alias("fold"), F.lit(0).alias("train_from"), cut.alias("train_to"),
                      cut.alias("test_from"), F.col("n").alias("test_to"))
    return _finish(t, keys)


def train_val_test(counts: DataFrame, keys: Sequence[str], test_frac: float = 0.2, val_frac: float = 0.2) -> DataFrame:
    """Nested temporal split (64/16/20): fold 0 = train->val, fold 1 = train+val->test."""
    split = F.floor(F.col("n") * (1.0 - test_frac))
    vsplit = F.floor(split * (1.0 - val_frac))
    a = counts.select(*keys, F.lit(0).alias("fold"), F.lit(0).alias("train_from"), vsplit.alias("train_to"),
                      vsplit.alias("test_from"), split.alias("test_to"))
    b = counts.select(*keys, F.lit(1).alias("fold"), F.lit(0).alias("train_from"), split.alias("train_to"),
                      split.alias("test_from"), F.col("n").alias("test_to"))
    return _finish(a.unionByName(b), keys)


def expanding_splits(counts: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """H03 (TimeSeriesSplit): test size n // (k+1); test i starts at n - k ts + i ts; train
    is everything before."""
    ts = F.floor(F.col("n") / (k + 1))
    r = _fold_rows(counts, keys, F.lit(k))
    start = F.col("n") - F.lit(k) * ts + F.col("fold") * ts
    t = r.select(*keys, "fold", F.lit(0).alias("train_from"), start.alias("train_to"),
                 start.alias("test_from"), (start + ts).alias("test_to"))
    return _finish(t.filter(F.col("test_to") > F.col("test_from")), keys)


def walk_forward_splits(counts: DataFrame, keys: Sequence[str], initial: int = 252, step: int = 21,
                        horizon: int = 1, expanding: bool = True) -> DataFrame:
    """Cut points i = initial, initial+step, ... < n - horizon; train [0 | i-initial, i),
    test [i, min(i+step, n-horizon))."""
    last = F.col("n") - F.lit(horizon)
    nf = F.when(last > initial, F.floor((last - F.lit(initial) - 1) / step) + 1).otherwise(0)
    r = _fold_rows(counts, keys, nf)
    i = F.lit(initial) + F.col("fold") * F.lit(step)
    t = r.select(*keys, "fold", (F.lit(0) if expanding else F.greatest(F.lit(0), i - initial)).alias("train_from"),
                 i.alias("train_to"), i.alias("test_from"), F.least(i + step, last).alias("test_to"))
    return _finish(t.filter((F.col("test_to") > F.col("test_from")) & (F.col("train_to") > F.col("train_from"))), keys)


def walk_forward_equal(counts: DataFrame, keys: Sequence[str], k: int = 5) -> DataFrame:
    """step = n // (k+1); train [0, step (i+2)), validation the next step rows (cut at n);
    stops at the first empty validation block."""
    step = F.floor(F.col("n") / (k + 1))
    r = _fold_rows(counts, keys, F.lit(k))
    te = step * (F.col("fold") + 2)
    t = r.select(*keys, "fold", F.lit(0).alias("train_from"), te.alias("train_to"), te.alias("test_from"),
                 F.least(te + step, F.col("n")).alias("test_to"))
    return _finish(t.filter(F.col("test_to") > F.col("test_from")), keys)


def walk_forward_sliding(counts: DataFrame, keys: Sequence[str], k: int = 5, test_frac: float = 0.2) -> DataFrame:
    """Non-overlapping train blocks of (n - int(0.2 n)) // k rows (remainder to the last),
    each followed by (int(0.2 n)) // k test rows."""
    test_n = F.floor(F.col("n") * test_frac)
    train_n = F.col("n") - test_n
    split = F.floor(train_n / k)
    r = _fold_rows(counts, keys, F.lit(k))
    start = F.col("fold") * split
    end = start + split + F.when(F.col("fold") == k - 1, F.pmod(train_n, F.lit(k))).otherwise(0)
    t = r.select(*keys, "fold", start.alias("train_from"), end.alias("train_to"), end.alias("test_from"),
                 F.least(end + F.floor(test_n / k), F.col("n")).alias("test_to"))
    return _finish(t.filter((F.col("test_from") < F.col("n")) & (F.col("test_to") > F.col("test_from"))), keys)


def reverse_holdout(counts: DataFrame, keys: Sequence[str], test_frac: float = 0.2) -> DataFrame:
    """H08 (kept for parity only): test = first int(n test) rows, train = the rest. Not a
    forward split: the fold table marks it with train_from > test_from."""
    cut = F.floor(F.col("n") * test_frac)
    t = counts.select(*keys, F.lit(0).alias("fold"), cut.alias("train_from"), F.col("n").alias("train_to"),
                      F.lit(0).alias("test_from"), cut.alias("test_to"))
    return _finish(t, keys)


def random_split(df: DataFrame, key_cols: Sequence[str], test_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Repeatable split by a hash of the row key (shuffled, leaky; a baseline only). The hash, the first 32 bits
    of an MD5 over seed and key, is one that any engine has."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols])
    h = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % 10000
    return df.withColumn("is_test", h < int(test_frac * 10000))


BUCKET = 64  # positions of a bucket, in which rows and folds meet


def assign(df: DataFrame, folds: DataFrame, sw: SeriesWindow, role: str = "test", idx: str = "row_idx") -> DataFrame:
    """Rows of ``df`` (with a row position ``idx``) joined to the folds whose ``role`` range
    holds them. A fold is listed in the buckets of positions that its range meets, and rows join on (series,
    bucket): a row sees the one or two folds near it, not all of its series, and a long series is
    dealt over as many keys as it has buckets."""
    lo, hi = f"{role}_from", f"{role}_to"
    f = folds.where(F.col(hi) > F.col(lo)).select(
        *[F.col(c).alias(f"_f_{c}") for c in sw.series_cols], "fold", F.col(lo).alias("_f_lo"), F.col(hi).alias("_f_hi"),
        F.explode(F.sequence(F.floor(F.col(lo) / BUCKET), F.floor((F.col(hi) - 1) / BUCKET))).alias("_f_bucket"))
    cond = [F.col(c) == F.col(f"_f_{c}") for c in sw.series_cols]
    cond += [F.floor(F.col(idx) / BUCKET) == F.col("_f_bucket"), F.col(idx) >= F.col("_f_lo"), F.col(idx) < F.col("_f_hi")]
    return df.join(f, cond, "inner").drop(*[f"_f_{c}" for c in sw.series_cols], "_f_lo", "_f_hi", "_f_bucket")
