"""Key-set operations and semi/anti joins.

Set operators compare rows null-safely already; the joins are plain
``left_semi`` / ``left_anti``. The right side is reduced to distinct keys
first: copies of a hot key are combined map-side, and the aggregation's hash
partitioning on the key is reused by the join (no extra exchange).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _null_safe_on(left: DataFrame, right: DataFrame, keys: list[str]):
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def anti_join(df: DataFrame, other: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """E5: rows of ``df`` whose key is absent from ``other``."""
    o = other.select(*keys).distinct()
    if null_safe:
        return df.join(o, _null_safe_on(df, o, keys), "left_anti")
    return df.join(o, keys, "left_anti")


def semi_join(df: DataFrame, other: DataFrame, keys: list[str], null_safe: bool = False) -> DataFrame:
    """Rows of ``df`` whose key is present in ``other``."""
    o = other.select(*keys).distinct()
    if null_safe:
        return df.join(o, _null_safe_on(df, o, keys), "left_semi")
    return df.join(o, keys, "left_semi")


def key_union(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of either side."""
    return a.select(*keys).union(b.select(*keys)).distinct()


def key_intersection(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys present on both sides."""
    return a.select(*keys).intersect(b.select(*keys))


def key_difference(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of ``a`` absent from ``b``."""
    return a.select(*keys).subtract(b.select(*keys))


def in_ids(df: DataFrame, ids: DataFrame, key: str, id_col: str | None = None) -> DataFrame:
    """Rows whose key is in an id frame (semi join; Spark broadcasts the
    id side at run time only when AQE measures it small)."""
    id_col = id_col or key
    return df.join(ids.select(F.col(id_col).alias("_id")).distinct(), F.col(key) == F.col("_id"), "left_semi")
