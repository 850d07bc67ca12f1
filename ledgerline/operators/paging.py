"""Pages by rank: a table kept in ranges of its order, with a
directory of how many rows stand before each range.

``write_ordered`` deals the rows into ranges by one sampled range partitioning
(no sort) and counts them once; the directory is a small table beside them. A
page then reads only the ranges that hold it and sorts no others.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RANGE_ROWS = 100_000


def write_ordered(df: DataFrame, path: str, order_cols: list[Column | str], range_rows: int = RANGE_ROWS) -> str:
    """Write the rows in ranges of about ``range_rows`` under ``path/rows`` and
    the directory under ``path/directory``; returns ``path``. A seeded random
    column behind the order columns lets equal rows fill several ranges."""
    spark = df.sparkSession
    df.limit(0).write.mode("error").parquet(f"{path}/empty")  # the columns, also of a table without rows
    ranges = max(1, math.ceil(df.count() / range_rows))
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    placed = df.withColumn("_tie", F.rand(17)).repartitionByRange(ranges, *cols, "_tie").withColumn("_range", F.spark_partition_id())
    placed.write.mode("error").partitionBy("_range").parquet(f"{path}/rows")
    stored = spark.read.schema("_range int").parquet(f"{path}/rows")
    counts = stored.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    counts.select("_range", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")).write.mode("error").parquet(f"{path}/directory")
    return path


def ranges_of(spark: SparkSession, path: str, low: int, high: int) -> list[tuple[int, int]]:
    """(range, rows before it) of the ranges that hold ranks low .. high - 1."""
    found = spark.read.parquet(f"{path}/directory").where((F.col("before") < high) & (F.col("before") + F.col("n") > low))
    return sorted((r["_range"], r["before"]) for r in found.collect())


def read_page(spark: SparkSession, path: str, order_cols: list[Column | str], page_no: int, page_size: int) -> DataFrame:
    """H6: rows of page ``page_no`` (0-based) of a table written by
    ``write_ordered`` in the same order, which must be total but for equal rows."""
    low = page_no * page_size
    ranges = ranges_of(spark, path, low, low + page_size)
    empty = spark.read.parquet(f"{path}/empty")
    if not ranges:
        return empty
    rows = spark.read.parquet(*[f"{path}/rows/_range={r}" for r, _ in ranges])
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols]
    return rows.orderBy(*cols, "_tie").offset(low - ranges[0][1]).limit(page_size).select(*[f"`{n}`" for n in empty.columns])
