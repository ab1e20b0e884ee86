"""tsengine — time-series feature, validation and forecasting operators on Spark DataFrames.

Unit of parallelism is ``(series, time)``: every operator takes the series key columns and the
time column, so one window exchange per bundle serves thousands of series at once.
"""

from tsengine.frames import SeriesWindow

__all__ = ["SeriesWindow"]
