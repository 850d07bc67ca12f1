"""Distributed global row numbering.

``row_number()`` over an un-partitioned window pulls every row into one task.
Instead: range-partition on the order columns, sort inside each partition,
tag each row with (partition id, position), cut the lineage with a reliable
checkpoint so the tags are stable, then add per-partition offsets from a
table with one row per partition (its size is bounded by the partition count,
so broadcasting it is safe).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.session import ensure_checkpoint_dir

# monotonically_increasing_id keeps the record number in the low 33 bits
_ROW_BITS = 33


def with_row_number(df: DataFrame, order_cols: list[Column | str], name: str = "rn") -> DataFrame:
    """Add ``name`` = 1-based position of each row in the total order given by
    ``order_cols`` (rows that tie on all order columns must be identical).

    A seeded random tie-break column is added after the order columns:
    identical rows may take any order among themselves, and without it a
    value repeated in a third of all rows would be one range, i.e. one
    task. The column is materialised once (sampling, shuffle and sort see
    the same values) and is deterministic per input partition on retry."""
    cols = [F.col(c) if isinstance(c, str) else c for c in order_cols] + [F.col("_tb")]
    ordered = df.withColumn("_tb", F.rand(17)).repartitionByRange(*cols).sortWithinPartitions(*cols)
    return number_as_sorted(ordered, name).drop("_tb")


def number_as_sorted(df: DataFrame, name: str = "rn") -> DataFrame:
    """Add ``name`` = 1-based position of each row of a sorted DataFrame as it
    comes out, partition by partition; nothing is shuffled or sorted again."""
    ensure_checkpoint_dir(df.sparkSession)
    tagged = (
        df.withColumn("_pid", F.spark_partition_id())
        .withColumn("_mid", F.monotonically_increasing_id())
        .checkpoint(eager=True)
    )
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), _ROW_BITS)
    return (
        tagged.join(F.broadcast(offsets), "_pid")
        .withColumn(name, (F.col("_off") + local + 1).cast("bigint"))
        .drop("_pid", "_mid", "_off")
    )
