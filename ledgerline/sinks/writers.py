"""Sinks and versioned table writes.

Writes go through the DataFrame writer. Tables are replaced by writing a
new version directory (``version=<n>``) and reading the highest version, so
a job never overwrites the path it is reading and a failed write leaves the
previous version intact.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.sources.headers import STANDARD_CSV


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """M1: standard CSV with a header row and no index column: quotes doubled,
    blanks around cells kept."""
    out = df.coalesce(1) if single_file else df
    out.write.mode(mode).options(**STANDARD_CSV).csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite", partition_by=None) -> None:
    """M4: parquet export."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_json_lines(df: DataFrame, path: str, json_col: str | None = None, mode: str = "overwrite") -> None:
    """M5: one JSON document per line (an existing JSON text column, or the
    whole row)."""
    col = F.col(json_col) if json_col else F.to_json(F.struct(*df.columns))
    df.select(col.alias("value")).write.mode(mode).text(path)


def write_chunked_csv(df: DataFrame, path: str, file_col: str = "file_no", mode: str = "overwrite") -> None:
    """M3: one CSV file per chunk number: rows are shuffled by chunk so each
    chunk is written by one task into ``file_no=<n>/`` (chunks are bounded
    by the chunk size)."""
    (df.repartition(file_col).sortWithinPartitions(file_col)
     .write.mode(mode).partitionBy(file_col).options(**STANDARD_CSV).csv(path))


def write_table(df: DataFrame, path: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Append / overwrite / error(-if-exists) / ignore."""
    if mode not in ("append", "overwrite", "error", "errorifexists", "ignore"):
        raise ValueError(f"unknown write mode {mode}")
    df.write.mode(mode).format(fmt).save(path)


def write_reports(reports: dict[str, DataFrame], prefix: str, tag: str) -> list[str]:
    """M2: several report frames (usually subsets of one persisted result)
    written as ``<prefix>_<name>_<tag>`` CSV directories."""
    paths = []
    for name, df in reports.items():
        p = f"{prefix}_{name}_{tag}"
        write_csv(df, p)
        paths.append(p)
    return paths


def export_all(spark: SparkSession, frames: dict[str, DataFrame], out_dir: str, fmt: str = "csv") -> DataFrame:
    """M6: export every named frame; failures are collected, not raised.
    Returns (name, ok, error) rows and leaves the count to the caller."""
    results = []
    for name, df in frames.items():
        try:
            if fmt == "csv":
                write_csv(df, os.path.join(out_dir, name))
            else:
                write_parquet(df, os.path.join(out_dir, name))
            results.append((name, True, None))
        except Exception as e:  # noqa: BLE001 - reported per input
            results.append((name, False, f"{type(e).__name__}: {e}"))
    return spark.createDataFrame(results, "name string, ok boolean, error string")


# ---------------------------------------------------------------------------
# versioned tables


def write_version(df: DataFrame, base: str, version: int, replay: bool = False) -> str:
    """Write ``df`` as version ``version`` of the table at ``base``. A version
    is written once; with ``replay`` a re-run batch overwrites its own."""
    path = f"{base.rstrip('/')}/version={version}"
    df.write.mode("overwrite" if replay else "error").parquet(path)
    return path


def versions(spark: SparkSession, base: str) -> list[int]:
    """Complete versions of the table at ``base``, from the directory listing
    (no data is read); none if there is no such directory."""
    root = spark._jvm.org.apache.hadoop.fs.Path(base)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    found = [s.getPath() for s in fs.listStatus(root) if s.getPath().getName().startswith("version=")]
    done = [p for p in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(p.getName().split("=", 1)[1]) for p in done)


def read_version(spark: SparkSession, base: str, version: int | None = None, before: int | None = None) -> DataFrame | None:
    """One version of a table (default: the highest, or the highest below
    ``before``); None if there is none. Read errors are raised."""
    if version is None:
        known = [v for v in versions(spark, base) if before is None or v < before]
        if not known:
            return None
        version = known[-1]
    return spark.read.parquet(f"{base.rstrip('/')}/version={version}")
