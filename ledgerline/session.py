"""Session helpers: building a session for tests / bench, loading the driver
tables, and resolving the shared checkpoint directory."""

from __future__ import annotations

import gc
import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "ledgerline") -> SparkSession:
    """Session with the settings the library assumes (AQE on, UTC, no UI)."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # remove reliable-checkpoint files once their DataFrames are gone
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the reliable checkpoint directory, setting it from
    ``spark.checkpoint.dir`` when the context has none yet.

    On a cluster the setting must name a folder that all executors share; only
    where a single process does all the work (master ``local[n]``, as in tests)
    and nothing is set, a temporary folder is set in its place."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if conf_dir:
        sc.setCheckpointDir(conf_dir)
        return sc.getCheckpointDir()
    if sc.master == "local" or sc.master.startswith("local["):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="ledgerline-ckpt-"))
        return sc.getCheckpointDir()
    raise RuntimeError("set spark.checkpoint.dir to a shared folder before "
                       "running operators that cut lineage")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path under the shared checkpoint directory for written tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, "ledgerline", name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def tables(spark: SparkSession, sf_dir: str, names) -> dict[str, DataFrame]:
    return {n: table(spark, sf_dir, n) for n in names}


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of steps that are over: it
    does when the driver collects their objects, by itself every half hour."""
    gc.collect()
    spark._jvm.System.gc()


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Deal the rows of a scan into ``spark.sql.shuffle.partitions`` tasks by
    hash of ``keys`` (round robin without keys), for CPU-heavy work per row. A
    plan option of the caller, the same at every size."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys) if keys else df.repartition(n)
