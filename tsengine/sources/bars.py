"""Bar and indicator sources (S01–S05, S10, S15) and table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BARS_CSV_SCHEMA = T.StructType([
    T.StructField("date", T.StringType()), T.StructField("open", T.DoubleType()),
    T.StructField("high", T.DoubleType()), T.StructField("low", T.DoubleType()),
    T.StructField("close", T.DoubleType()), T.StructField("volume", T.LongType()),
    T.StructField("price", T.DoubleType())])


def read_bars_csv(spark: SparkSession, path: str, series: str | None = None,
                  schema: T.StructType = BARS_CSV_SCHEMA) -> DataFrame:
    """CSV with a header and an explicit schema (no inference pass), ``date`` parsed to
    a timestamp; the series key from the argument or the file name."""
    df = spark.read.schema(schema).option("header", True).csv(path)
    s = F.lit(series) if series else F.regexp_extract(F.input_file_name(), r"([^/]+)\.csv$", 1)
    return df.select(s.alias("series"), F.to_timestamp("date").alias("dt"),
                     *[c for c in df.columns if c != "date"])


def latest_file(spark: SparkSession, folder: str, prefix: str, fmt: str = "csv") -> DataFrame:
    """The newest file whose name starts with ``prefix`` (by modification time, via the
    file-source ``_metadata`` column; only the winning file is then read)."""
    listing = (spark.read.format("binaryFile").option("pathGlobFilter", f"{prefix}*.{fmt}")
               .load(folder).select("path", "modificationTime"))
    return listing.orderBy(F.col("modificationTime").desc(), F.col("path").desc()).limit(1)


# fixed values: vendor column names (Title Case) -> canonical lower_snake names
VENDOR_COLUMNS = ["Date", "Open", "High", "Low", "Close", "Adj Close", "Volume"]
REQUIRED = ["date", "open", "high", "low", "close", "volume", "price"]


def normalise_column_name(name: str) -> str:
    """Lower case, spaces to underscores."""
    return name.lower().replace(" ", "_")


def standardise_vendor_columns(df: DataFrame) -> DataFrame:
    """Rename to lower_snake; price := adj_close if present, else close; keep the
    required columns that exist (in canonical order)."""
    out = df.withColumnsRenamed({c: normalise_column_name(c) for c in df.columns})
    if "price" not in out.columns:
        src = "adj_close" if "adj_close" in out.columns else ("close" if "close" in out.columns else None)
        if src:
            out = out.withColumn("price", F.col(src))
    keep = [c for c in REQUIRED if c in out.columns]
    extra = [c for c in out.columns if c in ("series",)]
    return out.select(*extra, *keep)


def to_naive_utc(df: DataFrame, col: str, tz: str) -> DataFrame:
    """A local wall-clock time in ``tz`` -> naive UTC (TIMESTAMP_NTZ)."""
    return df.withColumn(col, F.to_utc_timestamp(F.col(col).cast("timestamp"), tz).cast("timestamp_ntz"))


def read_indicators_wide(long_df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Landed long (indicator, dt, value) -> wide, fixed lower-case column list."""
    return long_df.groupBy("dt").pivot("indicator", list(names)).agg(F.max("value"))


def history_window(df: DataFrame, as_of, days: int, time_col: str = "dt") -> DataFrame:
    """Rows with time in [as_of - days, as_of] (a plain range predicate: pushed to the
    parquet scan / partition pruning)."""
    a = F.lit(as_of).cast("timestamp_ntz")
    return df.filter((F.col(time_col) >= a - F.make_interval(days=F.lit(days))) & (F.col(time_col) <= a))


def tail_n(df: DataFrame, keys: Sequence[str], time_col: str = "dt", n: int = 5) -> DataFrame:
    """Last n rows per series (row_number over time desc <= n: Spark plans a
    WindowGroupLimit that keeps only n rows per key before the final window)."""
    w = Window.partitionBy(*keys).orderBy(F.col(time_col).desc())
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ("series",), fmt: str = "parquet",
                sort_cols: Sequence[str] = ("dt",), mode: str = "overwrite") -> None:
    """Partitioned write, rows sorted within files by time so re-reads skip a sort."""
    w = df.repartition(*[F.col(c) for c in partition_by]) if partition_by else df
    w = w.sortWithinPartitions(*partition_by, *sort_cols)
    writer = w.write.mode(mode).format(fmt)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", True)
    writer.save(path)
