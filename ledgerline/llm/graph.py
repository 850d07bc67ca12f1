"""Connected components of an edge table by alternating large-star and
small-star rounds: joins and aggregations only, lineage cut by checkpoint()."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def _starred(pairs: DataFrame) -> DataFrame:
    """(u, v, m): the smallest of u and its v beside each pair. The minimum is
    combined before the shuffle; a hub's pairs are split by the skew join."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("u2"), F.least("u", "m").alias("m"))
    return pairs.join(least, F.col("u") == F.col("u2")).select("u", "v", "m")


def _state(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v): (u, root) for every u that isn't the smallest of its
    component, root being the smallest. Self-loops and repeats do no harm."""
    ensure_checkpoint_dir(edges.sparkSession)
    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct().checkpoint()
    state = _state(edges)
    while state[0]:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _starred(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        s = _starred(large)  # v < u: the smaller neighbours
        small = s.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(s.select("u", F.col("m").alias("v")))
        edges = small.where("u <> v").distinct().checkpoint()
        new = _state(edges)
        if new == state:
            break
        state = new
    return edges.select("u", F.col("v").alias("root"))
