"""Series without a partition key (one long series, a global indicator table).

A window without ``partitionBy`` runs in ONE task (``SinglePartition`` exchange). The helpers
here keep the work distributed:

* carry-style operators (forward fill): rows are dealt by ranges of time and written; pass 1 is an aggregate
  by range (its last non-null value), pass 2 a window by range; the carry between ranges comes from
  the table of ranges (one row per partition). Ranges follow the rows, not the calendar.
* bounded-frame operators on one long series: *halo blocks* — every block also receives the
  last ``halo`` rows of the previous block, the window runs per (series, block), halo rows are
  dropped. Exact for frames reaching at most ``halo`` rows back.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsengine.frames import SeriesWindow
from tsengine.operators.rank import positions
from tsengine.session import cut_lineage


def ffill_global(df: DataFrame, time_col: str, cols: Sequence[str], order_extra: Sequence[str] = ()) -> DataFrame:
    """Forward fill ``cols`` along the global order of ``time_col`` (then ``order_extra``), in parallel over
    ranges of that order."""
    order = [time_col, *order_extra]
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    rows = cut_lineage(ranged).withColumn("_part", F.shiftright("_at", 33))
    last = rows.groupBy("_part").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("_at"))).alias(f"_last_{c}") for c in cols])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    carry = last.select("_part", *[F.last(f"_last_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in cols])
    w = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(carry, "_part", "left").select(
        *[F.coalesce(F.last(c, ignorenulls=True).over(w), F.col(f"_carry_{c}")).alias(c) if c in cols
          else F.col(c) for c in df.columns])


def add_blocks(df: DataFrame, sw: SeriesWindow, block_rows: int, halo: int) -> tuple[DataFrame, SeriesWindow]:
    """Split each series into blocks of ``block_rows`` consecutive rows (position from a
    distributed row index) and copy the last ``halo`` rows of every block into the next one
    (``_halo`` = true). Returns the blocked frame and the window over (series, block)."""
    if halo > block_rows:
        raise ValueError("halo must not exceed the block length")
    idx = global_row_index(df, sw)
    own = idx.withColumn("_blk", F.floor(F.col("_pos") / block_rows)).withColumn("_halo", F.lit(False))
    nxt = (own.filter(F.col("_pos") % block_rows >= block_rows - halo)
              .withColumn("_blk", F.col("_blk") + 1).withColumn("_halo", F.lit(True)))
    blocked = own.unionByName(nxt)
    bsw = SeriesWindow([*sw.series_cols, "_blk"], sw.time_col, sw.order_cols[1:], pos_col="_pos")
    return blocked, bsw


def drop_halo(df: DataFrame, keep_pos: bool = False) -> DataFrame:
    out = df.filter(~F.col("_halo")).drop("_halo", "_blk")
    return out if keep_pos else out.drop("_pos")


def global_row_index(df: DataFrame, sw: SeriesWindow) -> DataFrame:
    """0-based position inside each series without a single-task window (see :func:`rank.positions`)."""
    return positions(df, sw.series_cols, sw.order_cols).drop("_total").withColumn("_pos", F.col("_pos").cast("long"))


def blocked_features(df: DataFrame, sw: SeriesWindow, stages_fn, halo: int,
                     block_rows: int = 4096) -> DataFrame:
    """Run bounded-frame feature stages on long series through halo blocks. ``stages_fn`` maps
    a SeriesWindow to :class:`~tsengine.operators.stages.Stages`; every frame in it must reach
    at most ``halo`` rows back (lags included)."""
    blocked, bsw = add_blocks(df, sw, block_rows, halo)
    return drop_halo(stages_fn(bsw).apply(blocked))
