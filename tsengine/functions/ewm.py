"""Exponentially weighted mean (pandas ``ewm(span, adjust=True, ignore_na=False).mean()``).

ewm_t = sum_{j<=t, x_j not null} w^(t-j) x_j / sum_{j<=t, x_j not null} w^(t-j),  w = 1 - alpha.

Two exact formulations are offered:

* ``ewm_mean`` — bounded row frame of K rows (weights below 1e-17 are dropped, so the double
  result equals the infinite sum) folded with ``aggregate``; one window stage, no extra sort.
* ``ewm_stages`` — O(n) form for very long series: the series is cut into blocks of B
  rows, block-local sums are running sums with block-relative exponents (no overflow), and the
  carry from older blocks is a short, fixed set of ``lag``s over the per-row block totals.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tsengine.frames import SeriesWindow
from tsengine.functions.core import col, ewm_frame_rows, span_alpha


def ewm_mean(x: Column | str, sw: SeriesWindow, span: float | None = None,
             alpha: float | None = None, min_periods: int = 1) -> Column:
    a = alpha if alpha is not None else span_alpha(span)
    w = 1.0 - a
    k = ewm_frame_rows(a)
    c = col(x)
    frame = sw.rows(-k, 0)
    items = F.collect_list(F.struct(c.alias("v"))).over(frame)
    zero = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("d"))
    acc = F.aggregate(
        items, zero,
        lambda s, e: F.struct(
            (s["n"] * F.lit(w) + F.coalesce(e["v"], F.lit(0.0))).alias("n"),
            (s["d"] * F.lit(w) + F.when(e["v"].isNull(), 0.0).otherwise(1.0)).alias("d")),
        lambda s: F.try_divide(s["n"], s["d"]))
    seen = F.count(c).over(sw.upto())
    return F.when(seen >= max(1, min_periods), acc)


def ewm_stages(sw: SeriesWindow, x: str, out: str, span: float | None = None, alpha: float | None = None,
               min_periods: int = 1, block: int = 256):
    """O(n) exact EWM as window stages (no arrays): the series is cut into blocks of ``block``
    rows; inside a block the weighted sums are running sums with block-relative exponents
    (bounded, no overflow); the carry from earlier blocks is the value at the previous block
    end, built from ``lag(local, i * block)`` for the few blocks whose weight is still above
    1e-17 (exact in double precision, like the bounded frame).

    Returns :class:`Stages` with 6 levels; ``x`` must exist before level 0."""
    import math

    from pyspark.sql import Window

    from tsengine.operators.stages import Stages

    a = alpha if alpha is not None else span_alpha(span)
    w = 1.0 - a
    p = f"_{out}"
    if w <= 0.0:
        return Stages([{out: F.col(x)}])
    B = int(max(1, min(block, math.floor(600.0 / -math.log(w)))))
    Wb = w ** B
    k_blocks = 1 if Wb <= 0 else max(1, int(math.ceil(math.log(1e-17) / math.log(Wb))) if Wb < 1 else 1)
    c = F.col(x)
    idx = F.col(f"{p}_i")
    off = F.pmod(idx, F.lit(B))
    blk = F.floor(idx / B)
    wblk = Window.partitionBy(*sw.series_cols, blk).orderBy(*sw.order_cols).rowsBetween(Window.unboundedPreceding, 0) \
        if sw.series_cols else Window.partitionBy(blk).orderBy(*sw.order_cols).rowsBetween(Window.unboundedPreceding, 0)
    inv = F.pow(F.lit(1.0 / w), off.cast("double"))
    s0 = {f"{p}_i": sw.row_idx(), f"{p}_seen": F.count(c).over(sw.upto())}
    s1 = {f"{p}_sn": F.sum(F.coalesce(c, F.lit(0.0)) * inv).over(wblk),
          f"{p}_sd": F.sum(F.when(c.isNull(), 0.0).otherwise(1.0) * inv).over(wblk)}
    fw = F.pow(F.lit(w), off.cast("double"))
    s2 = {f"{p}_ln": F.col(f"{p}_sn") * fw, f"{p}_ld": F.col(f"{p}_sd") * fw}

    def block_end(col):
        tot = F.col(col)
        for i in range(1, k_blocks + 1):
            tot = tot + F.lit(Wb ** i) * F.coalesce(sw.lag(col, i * B), F.lit(0.0))
        return F.when(off == B - 1, tot)
    s3 = {f"{p}_en": block_end(f"{p}_ln"), f"{p}_ed": block_end(f"{p}_ld")}
    prev = sw.rows(Window.unboundedPreceding, -1)
    s4 = {f"{p}_cn": F.coalesce(F.last(f"{p}_en", ignorenulls=True).over(prev), F.lit(0.0)),
          f"{p}_cd": F.coalesce(F.last(f"{p}_ed", ignorenulls=True).over(prev), F.lit(0.0))}
    gap = F.pow(F.lit(w), (off + 1).cast("double"))
    num = F.col(f"{p}_ln") + gap * F.col(f"{p}_cn")
    den = F.col(f"{p}_ld") + gap * F.col(f"{p}_cd")
    s5 = {out: F.when(F.col(f"{p}_seen") >= max(1, min_periods), F.try_divide(num, den))}
    return Stages([s0, s1, s2, s3, s4, s5])
