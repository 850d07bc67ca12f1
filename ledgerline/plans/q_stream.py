"""Registered queries: the streaming jobs (L1-L4) run with ``availableNow``
over files landed from the given tables; their final output must equal the
batch result, so they reuse the batch oracles (F0, F1, I5, I6)."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import functions as F

from ledgerline.plans import duck, q_reconcile  # noqa: F401  (registers the F1 oracle reused below)
from ledgerline.plans.fixtures import fixture, with_fixtures
from ledgerline.plans.q_orders import FETCH_STRIDE, _items_out, _merged_out, order_payload_pages
from ledgerline.plans.registry import REGISTRY, register
from ledgerline.session import release, scratch_path
from ledgerline.sinks.writers import write_csv
from ledgerline.streaming import feed_watch as W
from ledgerline.streaming import order_ingest as OI

#: Modification time of the first landing, in ms; later ones count from it.
FIRST_LANDING = 1_700_000_000_000


def _run_dir(spark, name):
    return scratch_path(spark, f"streams/{name}/{uuid.uuid4().hex}")


def _land_csv(df, folder, minutes):
    """A delivery: a file for each task of the rows, all with one modification
    time of their own."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    staged = f"{folder}-staged-{uuid.uuid4().hex}"
    write_csv(df, staged)
    fs = path(staged).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(path(folder))
    for part in fs.globStatus(path(f"{staged}/part-*.csv")):
        target = path(f"{folder}/{uuid.uuid4().hex}.csv")
        fs.setTimes(part.getPath(), FIRST_LANDING + minutes * 60_000, -1)
        fs.rename(part.getPath(), target)


def _land_both_orders(df, folder, minutes, key, sku):
    """A delivery in which every other row stands in files of another header:
    the columns backwards, one more of them, and line breaks around SKUs."""
    _land_csv(df.where(F.col(key) % 2 == 0).drop(key), folder, minutes)
    odd = df.where(F.col(key) % 2 == 1).withColumn(sku, F.concat(F.lit("\n"), F.col(sku), F.lit(" \r\n ")))
    _land_csv(odd.select(*reversed([c for c in df.columns if c != key]), F.concat(F.lit('say "'), F.col(key), F.lit(', "\n')).alias("remark")),
              folder, minutes)


def watched(spark, sf):
    """Three runs of the feed watch. In the first, an older, partial delivery
    and a complete one (in files of two headers) land on each side; in the
    second, one that is older than both lands late; in the third, the newest
    delivery of all lands, but without the columns of a feed, and is refused.
    The complete files must be what counts."""
    run = _run_dir(spark, "feed_watch")
    hdir, vdir, out = (os.path.join(run, d) for d in ("hnau", "vs", "out"))
    n = spark.sparkContext.defaultParallelism
    sides = ((fixture(spark, sf, "feed_h").repartition(n, "row_id").persist(), hdir, "sku_oms_details_sku"),
             (fixture(spark, sf, "feed_v").repartition(n, "row_id").persist(), vdir, "supplier_sku"))
    try:
        for late in range(3):
            for df, folder, sku in sides:
                if late == 0:
                    _land_csv(df.where(F.col(sku).endswith("1")).drop("row_id"), folder, 30)
                    _land_both_orders(df, folder, 60, "row_id", sku)
                elif late == 1:
                    _land_csv(df.where(F.col(sku).endswith("2")).drop("row_id"), folder, 0)
                else:
                    _land_csv(df.select(F.col(sku).alias("remark")), folder, 90)
            W.start_feed_watch(spark, hdir, vdir, out, os.path.join(run, "checkpoint"), available_now=True).awaitTermination()
    finally:
        for df, _, _ in sides:
            df.unpersist()
    return out


def _vs_sql(select):
    return with_fixtures(select, "feed_v", extra=duck.vs_ctes())


@register("l1_feed_watch_cycle", "L1/L2", REGISTRY["f1_reconcile"].oracle)
def l1(spark, sf):
    return W.read_output(spark, watched(spark, sf), "reconcile")


@register("l1_feed_watch_inventory", "L1/I4", _vs_sql(
    "SELECT coalesce(account, '') AS Account, sku AS SupplierSKU, CAST(qty AS BIGINT) AS FreeStock FROM v_norm"))
def l1_inventory(spark, sf):
    return W.read_output(spark, watched(spark, sf), "inventory")


@register("l1_feed_watch_changes", "L1/F3", _vs_sql(
    "SELECT sku, coalesce(account, '') AS Account, CAST(qty AS BIGINT) AS latest_qty, CAST(NULL AS BIGINT) AS previous_qty "
    "FROM v_norm WHERE qty IS NOT NULL"))
def l1_changes(spark, sf):
    return W.read_output(spark, watched(spark, sf), "changes")


@register("l4_feed_watch_log", "L4/I13", _vs_sql("""
SELECT a.action, count(*) AS total_skus,
       CASE WHEN a.action = 'compare_tables' THEN count(qty) ELSE 0 END AS changes_detected
FROM v_norm, (VALUES ('refresh_inventory_latest'), ('compare_tables'), ('update_inventory')) a(action) GROUP BY a.action"""))
def l4(spark, sf):
    return W.read_output(spark, watched(spark, sf), "runlog").select("action", "total_skus", "changes_detected")


def ingested(spark, sf):
    """Two runs of the order ingest, a fetch landing before each."""
    run = _run_dir(spark, "orders")
    pages_dir, out = os.path.join(run, "pages"), os.path.join(run, "out")
    pages = order_payload_pages(spark, sf)
    for fetch in (1, 2):
        # pages are many times the tables that they are built from: only the ones that land are built, straight into packed files
        landing = pages.where(F.floor(F.col("page_no") / FETCH_STRIDE) == fetch)
        landing.write.mode("append").option("compression", "gzip").json(pages_dir)
        release(spark)
        OI.start_order_ingest(spark, pages_dir, out, os.path.join(run, "checkpoint"), available_now=True).awaitTermination()
        release(spark)
    return out


@register("l3_order_stream_merge", "L3", REGISTRY["i5_merge_orders"].oracle)
def l3(spark, sf):
    return _merged_out(OI.read_orders(spark, ingested(spark, sf)))


@register("l3_order_stream_items", "L3/I6", REGISTRY["i6_replace_items"].oracle)
def l3_items(spark, sf):
    return _items_out(OI.read_orders(spark, ingested(spark, sf), "order_items"))
