"""Only what changed between two snapshots: a digest tree.

A snapshot is stored in leaves (``rows/_leaf=<n>``) by the last bits of the key's hash, so that a
leaf has about ``LEAF_ROWS`` rows. For every leaf there are the number of its
rows and two sums of hashes of (key, value), which don't depend on the order of
rows, and for every ``STEP`` bits less the sums of the nodes below. Two
snapshots are compared from the root down: only below nodes that differ are
digests read on, and only leaves that differ are read at all. Snapshots of
different sizes are compared down to the smaller depth, of which a deeper
snapshot's leaves are a refinement.

The key is a primary key of both snapshots. Rows with equal sums but other
content would need two equal pairs of 64-bit sums.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators.reconcile import snapshot_comparison
from ledgerline.sinks.buckets import hash_of, last_bits

LEAF_ROWS = 1_000_000
#: Bits between two levels: a node has up to 2 ** STEP nodes below it.
STEP = 4
MOST_BITS = 20
#: Nodes that a filter on a level's file lists.
LISTED = 1000


def leaf_bits(rows: int, leaf_rows: int = LEAF_ROWS) -> int:
    """Depth of the leaves of a snapshot of that many rows."""
    return min(MOST_BITS, math.ceil(math.log2(max(1, rows / leaf_rows)) / STEP) * STEP)


def _sums(*cells: Column) -> list[Column]:
    return [F.sum(F.xxhash64(F.lit(seed), *cells).cast("decimal(20,0)")).cast("decimal(38,0)").alias(f"digest{seed}") for seed in (1, 2)]


def write_snapshot(rows: DataFrame, path: str, key: str = "SupplierSKU", value: str = "FreeStock",
                   leaf_rows: int = LEAF_ROWS) -> str:
    """Write a snapshot in leaves under ``path/rows`` and its digest tree under
    ``path/digests``, a folder for each depth; returns ``path``."""
    rows.limit(0).write.mode("error").parquet(f"{path}/empty")  # the columns, also of a snapshot without rows
    rows = rows.persist()
    try:
        bits = leaf_bits(rows.count(), leaf_rows)
        placed = rows.withColumn("_leaf", last_bits(hash_of(key), bits))
        placed.repartition("_leaf").write.mode("error").partitionBy("_leaf").parquet(f"{path}/rows")
        spark = rows.sparkSession
        level = placed.groupBy(F.col("_leaf").alias("node")).agg(F.count("*").alias("n"), *_sums(F.col(key).cast("string"), F.col(value)))
        for depth in range(bits, -1, -STEP):
            if depth < bits:
                level = spark.read.parquet(f"{path}/digests/depth={depth + STEP}").groupBy(last_bits(F.col("node"), depth).alias("node")).agg(
                    F.sum("n").alias("n"), *[F.sum(c).cast("decimal(38,0)").alias(c) for c in ("digest1", "digest2")])
            # nodes that stand below one node stay in one part of the file, so a filter on them reads little
            parent = last_bits(F.col("node"), max(0, depth - STEP)).alias("parent")
            level.select(parent, "node", "n", "digest1", "digest2").repartitionByRange("parent", "node").sortWithinPartitions(
                "parent", "node").write.mode("error").parquet(f"{path}/digests/depth={depth}")
    finally:
        rows.unpersist()
    return path


def _list(spark: SparkSession, path: str, prefix: str) -> list[int]:
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
    return sorted(int(n[len(prefix):]) for n in names if n.startswith(prefix))


def changed_nodes(spark: SparkSession, latest: str, previous: str) -> tuple[int, list[int]]:
    """(depth, nodes) below which the snapshots differ, at the smaller depth of
    their leaves. The driver holds the differing nodes of a level."""
    shared = set(_list(spark, f"{latest}/digests", "depth=")) & set(_list(spark, f"{previous}/digests", "depth="))
    nodes: list[int] | None = None
    for depth in sorted(shared):
        sides = []
        for path in (latest, previous):
            level = spark.read.parquet(f"{path}/digests/depth={depth}")
            # a longer list than the filter takes: the level is read as it is, and the join decides
            sides.append(level if nodes is None or len(nodes) > LISTED else level.where(F.col("parent").isin(nodes)))
        new, old = sides
        if nodes is not None and len(nodes) > LISTED:
            new = new.join(spark.createDataFrame([(n,) for n in nodes], "parent bigint"), "parent", "left_semi")
        differ = new.join(old, (new.node == old.node) & (new.n == old.n) & (new.digest1 == old.digest1) & (new.digest2 == old.digest2), "left_anti")
        # nodes that only the previous snapshot has hold no row of the latest one
        nodes = sorted(r["node"] for r in differ.select("node").collect())
        if not nodes:
            return depth, []
    return max(shared), nodes or []


def read_nodes(spark: SparkSession, path: str, depth: int, nodes: list[int]) -> DataFrame | None:
    """Rows of the leaves below these nodes; None if there is no such leaf."""
    wanted = set(nodes)
    leaves = [x for x in _list(spark, f"{path}/rows", "_leaf=") if x & ((1 << depth) - 1) in wanted]
    schema = spark.read.parquet(f"{path}/empty").schema
    return spark.read.schema(schema).parquet(*[f"{path}/rows/_leaf={x}" for x in leaves]) if leaves else None


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    empty = spark.read.parquet(f"{path}/empty")
    return spark.read.schema(empty.schema).parquet(f"{path}/rows") if _list(spark, f"{path}/rows", "_leaf=") else empty


def changed_since(spark: SparkSession, latest: str, previous: str, key: str = "SupplierSKU",
                  value: str = "FreeStock", null_as_zero: bool = False) -> DataFrame:
    """F3 / F4 on stored snapshots: SKUs of ``latest`` whose value differs from
    ``previous``; only the leaves that differ are read."""
    depth, nodes = changed_nodes(spark, latest, previous)
    new, old = (read_nodes(spark, p, depth, nodes) for p in (latest, previous))
    none = spark.read.parquet(f"{latest}/empty")
    return snapshot_comparison(none if new is None else new, none if old is None else old, key, value, null_as_zero).where(
        "changed").drop("changed")
