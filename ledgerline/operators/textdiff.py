"""Line-level text difference between two versions of documents.

Re-aim of a unified diff: for each document, the lines that occur more often
in one version than in the other, with the surplus count. Both versions' lines
are counted with opposite signs in one aggregation per (document, line), which
combines a line repeated many times before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.text import split_lines


def line_diff(before: DataFrame, after: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, side, n): ``side`` is ``input`` when the line is more
    frequent before, ``output`` when more frequent after; ``n`` the surplus."""
    def lines(df: DataFrame, sign: int) -> DataFrame:
        return df.select(key, F.explode(split_lines(F.col(text))).alias("line"), F.lit(sign).cast("bigint").alias("_sign"))
    surplus = lines(before, 1).unionAll(lines(after, -1)).groupBy(key, "line").agg(F.sum("_sign").alias("_n"))
    return surplus.where(F.col("_n") != 0).select(
        key, "line", F.when(F.col("_n") > 0, F.lit("input")).otherwise(F.lit("output")).alias("side"),
        F.abs("_n").alias("n"))
