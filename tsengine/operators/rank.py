"""Positions and exact quantiles of large groups, without a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsengine.session import cut_lineage


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` with ``_pos`` (from 0, by ``order`` within ``keys``) and ``_total`` (rows of the keys). Rows are dealt by
    ranges of (keys, order, row number), so a hot group, even of equal values, lies in many partitions; each
    (keys, partition) run then needs the rows before it alone. Null keys are a group."""
    rows = cut_lineage(df)  # read twice (ranges, rows): the same rows under the same numbers
    by = [*keys, *order, "_row"]
    ranged = (rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by)
              .drop("_row").withColumn("_at", F.monotonically_increasing_id()))
    ranged = cut_lineage(ranged).withColumn("_part", F.shiftright("_at", 33))
    runs = ranged.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    runs = runs.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_part").alias("_p"),
                       (F.col("_first") + F.col("_n") - F.sum("_n").over(upto)).alias("_base"), F.sum("_n").over(group).alias("_total"))
    met = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)] + [F.col("_part") == F.col("_p")]
    return ranged.join(runs, met).select(*df.columns, (F.col("_at") - F.col("_base")).alias("_pos"), "_total")


def exact_quantiles(df: DataFrame, keys: Sequence[str], cols: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """keys and, per column, the array of its exact quantiles ``qs`` (linear interpolation between the two
    neighbouring values, nulls left out; null where a group has no value). The rows at the wanted places
    are picked from the numbered values of all columns; no group's values are gathered."""
    keys = list(keys)
    values = F.explode(F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(cols)])).alias("e")
    long = df.select(*keys, values).select(*keys, F.col("e.c").alias("_c"), F.col("e.v").alias("_v")).where("_v IS NOT NULL")
    placed = positions(long, [*keys, "_c"], ["_v"])
    at = [(F.col("_total") - 1) * F.lit(float(q)) for q in qs]
    wanted = None
    for a in at:
        here = (F.col("_pos") == F.floor(a)) | (F.col("_pos") == F.ceil(a))
        wanted = here if wanted is None else wanted | here
    picked = placed.where(wanted)
    aggs = []
    for i, _ in enumerate(cols):
        mine = F.col("_c") == i
        parts = []
        for a in at:
            lo = F.max(F.when(mine & (F.col("_pos") == F.floor(a)), F.col("_v")))
            hi = F.max(F.when(mine & (F.col("_pos") == F.ceil(a)), F.col("_v")))
            share = F.max(F.when(mine, a - F.floor(a)))
            parts.append(F.when(share == 0, lo).otherwise(lo + (hi - lo) * share))
        aggs.append(F.array(*parts).alias(f"_q_{cols[i]}"))
    if not keys:
        return picked.agg(*aggs)
    found = picked.groupBy(*keys).agg(*aggs)
    everyone = df.select(*keys).distinct().select(*[F.col(k).alias(f"_g{i}") for i, k in enumerate(keys)])
    met = [F.col(k).eqNullSafe(F.col(f"_g{i}")) for i, k in enumerate(keys)]
    none = F.array(*[F.lit(None).cast("double") for _ in qs])
    return everyone.join(found, met, "left").select(*[F.col(f"_g{i}").alias(k) for i, k in enumerate(keys)],
                                                    *[F.coalesce(f"_q_{c}", none).alias(f"_q_{c}") for c in cols])
