"""Tables in buckets that grow with them: extendible hashing over a commit log.

A bucket (depth, code) holds the rows whose key hash ends in the ``depth`` bits
``code``. The directory of buckets is part of the manifest (``sinks.commitlog``)
and covers every hash once. A batch reads and writes only the buckets that its
keys fall into, so its tasks follow the touched bytes. A bucket of more than
``BUCKET_ROWS`` rows is split by as many further bits as it takes, when it is
written; ``compact`` joins sibling buckets that have become small. So buckets
keep their size while the table doubles, and their number follows the table.

Rows of one key stay together: a key with more rows than a bucket may have is a
bucket of its own.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ledgerline.sinks import commitlog as CL

#: Rows of a bucket, at most, unless they are of one key.
BUCKET_ROWS = 1_000_000
#: Bits of a key hash that buckets may use, and other ones that tasks of a bucket do.
MOST_BITS = 48
SLICE_BITS = 3
#: Compression of a bucket's files.
CODEC = "zstd"
ROOT = {"depth": 0, "code": 0, "rows": 0, "folder": None}


def hash_of(key: str) -> Column:
    return F.xxhash64(F.col(key).cast("string"))


def last_bits(h: Column, depth) -> Column:
    """The last ``depth`` bits (a number or a column) of a hash."""
    return h.bitwiseAND(F.shiftleft(F.lit(1).cast("bigint"), depth) - 1 if isinstance(depth, int) else
                        F.call_function("shiftleft", F.lit(1).cast("bigint"), depth) - 1)


def directory(state: dict, table: str) -> list[dict]:
    return state.setdefault("buckets", {}).get(table) or [dict(ROOT)]


def _directory_rows(spark: SparkSession, buckets: list[dict]) -> DataFrame:
    return spark.createDataFrame([(b["depth"], b["code"]) for b in buckets], "depth int, code bigint")


def with_bucket(rows: DataFrame, key: str, buckets: list[dict]) -> DataFrame:
    """Rows with (depth, code) of their bucket among ``buckets``; rows of other
    buckets drop out. A join with the directory on each depth that it has."""
    depths = sorted({b["depth"] for b in buckets})
    h = hash_of(key)
    if len(buckets) == 1:
        only = buckets[0]
        return rows.where(last_bits(h, only["depth"]) == only["code"]).select(
            "*", F.lit(only["depth"]).alias("depth"), F.lit(only["code"]).cast("bigint").alias("code"))
    places = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), last_bits(h, d).alias("code")) for d in depths]))
    # the directory is the driver's own list; without statistics of it the rows would be shuffled and sorted to meet it
    return rows.select("*", places.alias("_at")).select("*", "_at.depth", "_at.code").drop("_at").join(
        F.broadcast(_directory_rows(rows.sparkSession, buckets)), ["depth", "code"]).select(*rows.columns, "depth", "code")


def touched(keys: DataFrame, key: str, buckets: list[dict]) -> list[dict]:
    """The buckets that the keys fall into; the driver gets one row a bucket."""
    found = with_bucket(keys.select(key).distinct(), key, buckets).select("depth", "code").distinct().collect()
    wanted = {(r["depth"], r["code"]) for r in found}
    return [b for b in buckets if (b["depth"], b["code"]) in wanted]


def read_buckets(spark: SparkSession, base: str, buckets: list[dict]) -> DataFrame | None:
    folders = [f"{base.rstrip('/')}/{b['folder']}" for b in buckets if b["folder"]]
    return spark.read.option("mergeSchema", True).parquet(*folders) if folders else None


def read_table(spark: SparkSession, base: str, table: str, state: dict | None = None) -> DataFrame | None:
    """The whole table as of the head or a given state; None if it has no row yet."""
    state = CL.head(spark, base)[1] if state is None else state
    return read_buckets(spark, base, directory(state, table))


def split_depth(bucket: dict, rows: int, keys: int, limit: int) -> int:
    """Depth of the parts of a bucket, so that each has about ``limit`` rows at
    most; no more parts than it has keys, so a large key doesn't split others."""
    if rows <= limit or keys < 2:
        return bucket["depth"]
    return min(MOST_BITS, bucket["depth"] + math.ceil(math.log2(min(rows / limit, keys))))


def dealt_out(rows: DataFrame, key: str, buckets: list[dict]) -> DataFrame:
    """Rows with (depth, code, slice), where the rows of these are: a bucket is
    folded and written in up to 2 ** ``SLICE_BITS`` tasks."""
    part = F.shiftrightunsigned(hash_of(key), 64 - SLICE_BITS).alias("slice")
    # of a single bucket depth and code are constants, which no grouping counts as columns
    by = ["depth", "code", "slice"] if len(buckets) > 1 else ["slice"]
    return with_bucket(rows, key, buckets).select("*", part).repartition(*by)


def rewritten(counts: DataFrame, content: Callable[[Callable[[DataFrame], DataFrame]], DataFrame], base: str, table: str,
              key: str, old: list[dict], limit: int) -> list[dict]:
    """Write the new content of the buckets ``old``, split where they are too
    large; returns the buckets that stand in their place. ``counts`` has the
    rows (n) that each key will have; ``content`` deals its rows out by the
    function that it gets, so they are shuffled once, to where they are written,
    and never kept."""
    counts = counts.persist(StorageLevel.DISK_ONLY)  # read twice
    try:
        sizes = {(r["depth"], r["code"]): (r["rows"], r["keys"]) for r in with_bucket(counts, key, old).groupBy("depth", "code").agg(
            F.sum("n").alias("rows"), F.count("*").alias("keys")).collect()}
        parts = []
        for b in old:
            depth = split_depth(b, *sizes.get((b["depth"], b["code"]), (0, 0)), limit)
            parts += [{**ROOT, "depth": depth, "code": b["code"] | more << b["depth"]} for more in range(1 << depth - b["depth"])]
        numbers = {(r["depth"], r["code"]): r["rows"] for r in with_bucket(counts, key, parts).groupBy("depth", "code").agg(
            F.sum("n").alias("rows")).collect()}
    finally:
        counts.unpersist()
    folder = CL.stage(content(lambda rows: dealt_out(rows, key, parts)).drop("slice"), base, table, ("depth", "code"), CODEC)
    for p in parts:
        p["rows"] = numbers.get((p["depth"], p["code"]), 0)
        p["folder"] = f"{folder}/depth={p['depth']}/code={p['code']}" if p["rows"] else None
    return parts


def update(state: dict, base: str, table: str, key: str, keys: DataFrame,
           counts: Callable[[DataFrame | None], DataFrame],
           fold: Callable[[DataFrame | None, Callable[[DataFrame], DataFrame]], DataFrame], limit: int = BUCKET_ROWS) -> list[dict]:
    """Replace the content of the buckets that ``keys`` fall into by ``fold``
    of it (None: they are empty), of which ``counts`` gives the rows of each key
    (see ``rewritten``); returns the buckets written."""
    buckets = directory(state, table)
    old = touched(keys, key, buckets)
    if not old:
        return []
    stored = read_buckets(keys.sparkSession, base, old)
    new = rewritten(counts(stored), lambda place: fold(stored, place), base, table, key, old, limit)
    gone = {(b["depth"], b["code"]) for b in old}
    state["buckets"][table] = sorted([b for b in buckets if (b["depth"], b["code"]) not in gone] + new,
                                     key=lambda b: (b["depth"], b["code"]))
    return new


def siblings(buckets: list[dict], limit: int) -> list[tuple[dict, list[dict]]]:
    """(joined bucket, its parts) wherever siblings have at most half of
    ``limit`` rows together, joined as far up as that holds."""
    found = {(b["depth"], b["code"]): (b["rows"], [b]) for b in buckets}
    for depth in range(max(b["depth"] for b in buckets), 0, -1):
        for (d, code), (rows, parts) in list(found.items()):
            other = found.get((d, code | 1 << depth - 1))
            if d == depth and not code >> depth - 1 and other and rows + other[0] <= limit // 2:
                found[depth - 1, code] = (rows + other[0], parts + other[1])
                del found[d, code], found[d, code | 1 << depth - 1]
    return [({**ROOT, "depth": d, "code": c, "rows": rows}, parts) for (d, c), (rows, parts) in found.items() if len(parts) > 1]


def compact(spark: SparkSession, base: str, table: str, key: str, limit: int = BUCKET_ROWS) -> int:
    """Join small sibling buckets, in a commit of its own; returns how many
    buckets have gone."""
    gone = 0

    def change(state: dict) -> dict | None:
        nonlocal gone
        buckets = directory(state, table)
        groups = siblings(buckets, limit)
        if not groups:
            gone = 0
            return None
        small = [b for _, parts in groups for b in parts]
        rows = read_buckets(spark, base, small)
        new = [b for b, _ in groups]
        if rows is not None:
            new = rewritten(rows.groupBy(key).agg(F.count("*").alias("n")), lambda place: place(rows), base, table, key, new, limit)
        state["buckets"][table] = sorted([b for b in buckets if b not in small] + new, key=lambda b: (b["depth"], b["code"]))
        gone = len(small) - len(new)
        return state
    CL.transact(spark, base, change)
    return gone
