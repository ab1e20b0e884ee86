"""Window specifications shared by every series operator.

All features of one bundle are built on ONE partitioning/ordering so Catalyst plans a single
exchange + sort and evaluates the nested window stages on top of it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


class SeriesWindow:
    """Row-frame windows over ``partitionBy(series_cols).orderBy(time_col, *tiebreak)``.

    ``incl(k)``: the k rows ending at the current row (pandas ``rolling(k)``).
    ``past(k)``: the k rows before the current row (pandas ``shift(1).rolling(k)``).
    """

    def __init__(self, series_cols: Sequence[str] | str = ("series",), time_col: str = "dt",
                 tiebreak: Sequence[str] = (), pos_col: str | None = None):
        if isinstance(series_cols, str):
            series_cols = [series_cols]
        self.series_cols = list(series_cols)
        self.time_col = time_col
        self.order_cols = [time_col, *tiebreak]
        self._cache: dict = {}  # window specs are immutable: build each once (fewer JVM calls)
        self.pos_col = pos_col  # a precomputed global row position (halo blocks), if any

    @property
    def w(self) -> WindowSpec:
        if "w" not in self._cache:
            self._cache["w"] = (Window.partitionBy(*self.series_cols).orderBy(*self.order_cols)
                                if self.series_cols else Window.orderBy(*self.order_cols))
        return self._cache["w"]

    @property
    def part(self) -> WindowSpec:
        """Whole-series frame (for counts / positions)."""
        if "part" not in self._cache:
            self._cache["part"] = (Window.partitionBy(*self.series_cols) if self.series_cols
                                   else Window.partitionBy())
        return self._cache["part"]

    def rows(self, start: int, end: int) -> WindowSpec:
        key = ("rows", start, end)
        if key not in self._cache:
            self._cache[key] = self.w.rowsBetween(start, end)
        return self._cache[key]

    def incl(self, k: int) -> WindowSpec:
        return self.rows(-(k - 1), 0)

    def past(self, k: int) -> WindowSpec:
        return self.rows(-k, -1)

    def upto(self) -> WindowSpec:
        return self.rows(Window.unboundedPreceding, 0)

    def after(self) -> WindowSpec:
        """Frame from the current row to the end of the series, expressed as a RUNNING frame over
        the reversed order: Spark re-aggregates an ``unboundedFollowing`` frame for every row
        (quadratic); the reversed running frame is linear and costs one local sort."""
        desc = [F.col(c).desc() for c in self.order_cols]
        if self.series_cols:
            w = Window.partitionBy(*self.series_cols).orderBy(*desc)
        else:
            w = Window.orderBy(*desc)
        return w.rowsBetween(Window.unboundedPreceding, 0)

    def keyed(self, *extra: str) -> list[str]:
        return [*self.series_cols, *extra]

    # -- pandas rolling semantics ---------------------------------------------------------
    @staticmethod
    def mp(col: Column | str, frame: WindowSpec, min_periods: int, agg) -> Column:
        """pandas ``min_periods``: the aggregate only when the frame holds at least
        ``min_periods`` non-null values, else NULL."""
        c = F.col(col) if isinstance(col, str) else col
        if min_periods <= 0:
            return agg(c).over(frame)
        return F.when(SeriesWindow._count(col, c, frame) >= min_periods, agg(c).over(frame))

    _counts: dict = {}

    @staticmethod
    def _count(name, c: Column, frame: WindowSpec) -> Column:
        """count(c) over a frame, shared by every aggregate guarded on the same column / frame."""
        if not isinstance(name, str):
            return F.count(c).over(frame)
        key = (name, id(frame))
        hit = SeriesWindow._counts.get(key)
        if hit is None or hit[0] is not frame:
            hit = (frame, F.count(c).over(frame))
            SeriesWindow._counts[key] = hit
        return hit[1]

    def lag(self, col: Column | str, k: int = 1) -> Column:
        if isinstance(col, str):  # Columns are immutable: reuse the same lag expression
            key = ("lag", col, k)
            if key not in self._cache:
                self._cache[key] = F.lag(col, k).over(self.w)
            return self._cache[key]
        return F.lag(col, k).over(self.w)

    def lead(self, col: Column | str, k: int = 1) -> Column:
        return F.lead(col, k).over(self.w)

    def row_idx(self) -> Column:
        """0-based position inside the series (pandas ``iloc`` index); the global position
        column when the frame is a halo block of a longer series."""
        if self.pos_col:
            return F.col(self.pos_col).cast("long")
        return (F.row_number().over(self.w) - 1).cast("long")

    def n_rows(self) -> Column:
        return F.count(F.lit(1)).over(self.part)
