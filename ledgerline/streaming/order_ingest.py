"""Incremental order ingest: payload pages arriving as JSON-lines
files ``{"page_no": n, "payload": "<page JSON text>"}`` are merged into the
orders table per micro-batch (I5) and the items of touched orders are
replaced (I6).

* Look-back: each fetch asks for some hours back, so the same pages come again.
  A page whose text was taken within ``LOOK_BACK`` is dropped before it is
  parsed, by a stateful operator whose state is the digests of that time. Time
  is that of the batch that brings a page, so no page is ever late. The operator
  moves digests only; the pages of those that it leaves are read from their files.
* Both tables are in buckets that split as they grow (``sinks.buckets``); a
  batch reads and writes the buckets that its orders fall into. While it does,
  the batch's orders are in files of plain columns under ``BATCHES``.
* Orders, items and the batch's number become visible by one commit
  (``sinks.commitlog``): a replayed batch that was committed is left out, and
  another writer's commit in between makes the batch merge anew into its result.

Payload order across batches is (batch, page, position).
"""

from __future__ import annotations

import re
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ledgerline.operators import orders as O
from ledgerline.sinks import buckets as B
from ledgerline.sinks import commitlog as CL

PAGE_SCHEMA = "page_no bigint, payload string"
#: How far back a fetch reaches, fixed value.
LOOK_BACK = "2 hours"
TABLES = (("orders", O.orders_after, O.merge_orders), ("order_items", O.items_after, O.replace_items))
#: Folder of batches that are being merged.
BATCHES = "_batches"


def _scan_batch(batch: DataFrame, batch_id: int) -> DataFrame:
    scanned = O.scan_pages(batch, "payload", "page_no")
    # order payloads across batches: (batch, page, position)
    return scanned.select(F.struct(F.lit(batch_id).cast("bigint").alias("_b"), F.col("ord._page").alias("_page"),
                                   F.col("ord._pos").alias("_pos")).alias("ord"), "v")


def once_within(pages: DataFrame, look_back: str = LOOK_BACK) -> DataFrame:
    """(file, digest) of a stream's pages, without those whose payload came within ``look_back`` before."""
    seen = pages.select(F.col("_metadata.file_path").alias("file"), F.sha2("payload", 256).alias("digest"),
                        F.current_timestamp().alias("_seen"))
    return seen.withWatermark("_seen", look_back).dropDuplicatesWithinWatermark(["digest"]).drop("_seen")


def pages_of(kept: DataFrame) -> DataFrame | None:
    """The pages that ``once_within`` left, from their files; None without any.
    Where it left all pages of these files they are read as they are, without a
    join; else a page that stands in them twice comes twice, which folds to the same."""
    files = sorted(unquote(r["file"]) for r in kept.select("file").distinct().collect())
    if not files:
        return None
    pages = kept.sparkSession.read.schema(PAGE_SCHEMA).json([re.sub(r"([\[\]{}*?\\])", r"\\\1", f) for f in files])
    pages = pages.where("payload is not null")
    if pages.count() == kept.where("digest is not null").count():
        return pages
    return pages.withColumn("digest", F.sha2("payload", 256)).join(kept.select("digest"), "digest", "left_semi").drop("digest")


def make_order_handler(out_dir: str, bucket_rows: int = B.BUCKET_ROWS, writer: str = "order_ingest"):
    """foreachBatch function; ``writer`` names the stream in the manifests."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        staged: list[str] = []

        def change(state: dict) -> dict | None:
            if state["applied"].get(writer, -1) >= batch_id:
                return None
            parsed = O.order_rows(_scan_batch(batch, batch_id))
            if not staged:
                # the pages of one micro-batch are parsed once for orders and items, and
                # their plain columns kept in files: a first fetch is the whole table
                staged.append(CL.stage(parsed, out_dir, BATCHES, codec=B.CODEC))
            rows = spark.read.schema(parsed.schema).parquet(f"{out_dir.rstrip('/')}/{staged[0]}")
            keys = rows.select("order_id").distinct().persist(StorageLevel.DISK_ONLY)
            try:
                written = [B.update(state, out_dir, name, "order_id", keys, lambda old, c=counts: c(rows, old),
                                    lambda old, place, f=fold: f(rows, old, place=place), bucket_rows)
                           for name, counts, fold in TABLES]
            finally:
                keys.unpersist()
            state["applied"][writer] = batch_id
            return state if any(written) else None
        try:
            CL.transact(spark, out_dir, change)
        finally:
            for folder in staged:
                CL.discard(spark, out_dir, folder)
    return handle


def start_order_ingest(spark: SparkSession, pages_dir: str, out_dir: str, checkpoint: str,
                       interval: str = "120 seconds", available_now: bool = False,
                       max_files: int | None = None, look_back: str = LOOK_BACK, bucket_rows: int = B.BUCKET_ROWS):
    r = spark.readStream.schema(PAGE_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)

    def handle(batch: DataFrame, batch_id: int) -> None:
        kept = batch.persist(StorageLevel.DISK_ONLY)
        try:
            pages = pages_of(kept)
            if pages is not None:
                make_order_handler(out_dir, bucket_rows, f"order_ingest {CL.stream_id(spark, checkpoint)}")(pages, batch_id)
        finally:
            kept.unpersist()
    w = once_within(r.json(pages_dir), look_back).writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def read_orders(spark: SparkSession, out_dir: str, name: str = "orders") -> DataFrame | None:
    return B.read_table(spark, out_dir, name)
