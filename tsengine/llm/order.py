"""Positions of rows in large groups, without a group in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsengine.llm.common import materialize


def place(rows: DataFrame, group: list[str], order: list[str], what: str) -> DataFrame:
    """``rows`` with ``pos`` (from 0, by ``order`` within ``group``) and ``total`` (rows of the group).

    ``rows`` is a written table (its scan numbers rows alike each time), group columns hold no null,
    names starting with ``_`` are taken. Rows are dealt by ranges of (group, order, row), so that a
    hot group, even of equal rows, lies in many partitions; then every (group, partition) run needs
    its length alone. Equal rows get places in the order of the scan; nulls come first."""
    keys = [*group, *order, "_row"]
    sorted_rows = (rows.withColumn("_row", F.monotonically_increasing_id())
                   .repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_row")
                   .withColumn("_at", F.monotonically_increasing_id()))
    written = materialize(sorted_rows, what).withColumn("_part", F.shiftright("_at", 33))
    runs = written.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    every = Window.partitionBy(*group)
    upto = every.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.select(*group, "_part", (F.col("_first") + F.col("_n") - F.sum("_n").over(upto)).alias("_base"),
                       F.sum("_n").over(every).alias("total"))
    return written.join(runs, [*group, "_part"]).withColumn("pos", F.col("_at") - F.col("_base")).drop("_part", "_at", "_base")
