"""Refresh ledger and file inventory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def freshness_gate(ledger: DataFrame, as_of, max_age_minutes: int, key: str = "source",
                   ts: str = "refreshed_at") -> DataFrame:
    """Per key, refresh needed when the last refresh is missing or older than the limit."""
    a = F.lit(as_of).cast("timestamp_ntz")
    last = ledger.groupBy(key).agg(F.max(ts).alias("last_refresh"))
    age = (F.unix_micros(a.cast("timestamp")) - F.unix_micros(F.col("last_refresh").cast("timestamp"))) / 60e6
    return last.select(key, "last_refresh", age.alias("age_minutes"),
                       (F.col("last_refresh").isNull() | (age >= max_age_minutes)).alias("needs_refresh"))


def next_refresh_minutes(ledger: DataFrame, as_of, every_minutes: int, key: str = "source",
                         ts: str = "refreshed_at") -> DataFrame:
    """Whole minutes until the next scheduled refresh, floored at 0."""
    a = F.unix_timestamp(F.lit(as_of).cast("timestamp_ntz").cast("timestamp"))
    last = ledger.groupBy(key).agg(F.max(ts).alias("last_refresh"))
    due = F.unix_timestamp(F.col("last_refresh").cast("timestamp")) + F.lit(every_minutes * 60)
    return last.select(key, F.greatest(F.lit(0), F.floor((due - a) / 60)).cast("long").alias("next_refresh_minutes"))


def file_inventory(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """Name, size MB (2 dp), modified time and per-folder totals. Only file metadata is
    selected, so the binary content is never read."""
    f = (spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True)
         .load(folder).select("path", "length", "modificationTime"))
    f = f.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"),
                 F.regexp_extract("path", r"^(.*)/[^/]+$", 1).alias("folder"),
                 F.round(F.col("length") / (1024 * 1024), 2).alias("size_mb"),
                 F.col("modificationTime").alias("modified"), "length")
    tot = f.groupBy("folder").agg(F.count(F.lit(1)).alias("files"),
                                  F.round(F.sum("length") / (1024 * 1024), 2).alias("folder_size_mb"))
    return f.join(tot, "folder").drop("length")
