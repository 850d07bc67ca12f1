"""Registered queries: change feeds, chunk numbering, batches."""

from __future__ import annotations

from ledgerline.operators import feed as G
from ledgerline.plans.fixtures import with_fixtures
from ledgerline.plans.q_reconcile import changes
from ledgerline.plans.registry import register

SOURCES = list(G.DEFAULT_SOURCES)
CHUNK = G.DEFAULT_CHUNK_ROWS
BATCH = G.DEFAULT_BATCH_ITEMS


def feed_rows(spark, sf, null_as_zero: bool):
    ch = changes(spark, sf, null_as_zero)
    return G.change_feed(ch, SOURCES, sku="sku", qty="latest_qty",
                         order_cols=["sku", "latest_qty", "previous_qty"],
                         zero_nulls=null_as_zero)


def _feed_sql(select: str, null_as_zero: bool) -> str:
    where = ("coalesce(l.FreeStock, 0) <> coalesce(p.FreeStock, 0)" if null_as_zero
             else "l.FreeStock IS DISTINCT FROM p.FreeStock")
    qty = "coalesce(latest_qty, 0)" if null_as_zero else "latest_qty"
    values = ", ".join(f"({i}, '{s}')" for i, s in enumerate(SOURCES))
    return with_fixtures(select, "inventory", "inventory_latest", extra={
        "ch": ("SELECT l.SupplierSKU AS sku, l.FreeStock AS latest_qty, p.FreeStock AS previous_qty "
               "FROM inventory_latest l LEFT JOIN inventory p ON l.SupplierSKU = p.SupplierSKU "
               f"WHERE {where}"),
        "r": ("SELECT sku, latest_qty, row_number() OVER (ORDER BY sku, latest_qty NULLS FIRST, "
              "previous_qty NULLS FIRST) AS sku_rank FROM ch"),
        "src": f"SELECT * FROM (VALUES {values}) s(src_idx, source_code)",
        "feed": (f"SELECT sku, CASE WHEN coalesce(latest_qty, 0) > 0 THEN 1 ELSE 0 END AS stock_status, "
                 f"source_code, {qty} AS qty, sku_rank, "
                 f"CAST((sku_rank - 1) * {len(SOURCES)} + src_idx + 1 AS BIGINT) AS row_rank FROM r, src"),
    })


_FEED_COLS = "sku, stock_status, source_code, qty, sku_rank, row_rank"

register("g1_feed_null_safe", "G1", _feed_sql(f"SELECT {_FEED_COLS} FROM feed", False))(
    lambda spark, sf: feed_rows(spark, sf, False))
register("g1_feed_null_zero", "G1", _feed_sql(f"SELECT {_FEED_COLS} FROM feed", True))(
    lambda spark, sf: feed_rows(spark, sf, True))

_per_file = -(-CHUNK // len(SOURCES))


@register("g2_chunk_whole_changes", "G2/M3", _feed_sql(
    f"SELECT {_FEED_COLS}, CAST(floor((sku_rank - 1) / {_per_file}) + 1 AS BIGINT) AS file_no FROM feed",
    False))
def g2(spark, sf):
    return G.chunk_whole_changes(feed_rows(spark, sf, False), CHUNK, len(SOURCES))


@register("g3_chunk_exact_rows", "G3/M3", _feed_sql(
    f"SELECT {_FEED_COLS}, CAST(floor((row_rank - 1) / {CHUNK}) + 1 AS BIGINT) AS file_no FROM feed",
    True))
def g3(spark, sf):
    return G.chunk_exact_rows(feed_rows(spark, sf, True), CHUNK)


_ITEM = ("struct_pack(sku := sku, source_code := source_code, quantity := CAST(qty AS BIGINT), "
         "status := CAST(stock_status AS BIGINT))")


@register("g4_stock_item_batches", "G4", _feed_sql(f"""
SELECT CAST(floor((row_rank - 1) / {BATCH}) + 1 AS BIGINT) AS batch_id,
       CAST(count(*) AS BIGINT) AS n_items,
       CAST(to_json(list({_ITEM} ORDER BY row_rank)) AS VARCHAR) AS payload
FROM feed GROUP BY 1
""", True))
def g4(spark, sf):
    return G.stock_item_batches(feed_rows(spark, sf, True), BATCH)


@register("g5_send_summary", "G5", _feed_sql(f"""
SELECT CAST(floor((row_rank - 1) / {BATCH}) + 1 AS BIGINT) AS batch_id,
       CAST(count(*) AS BIGINT) AS n_items,
       CAST(to_json(arg_min({_ITEM}, row_rank)) AS VARCHAR) AS example
FROM feed GROUP BY 1
""", True))
def g5(spark, sf):
    return G.send_summary(feed_rows(spark, sf, True), BATCH)


@register("g5_send_totals", "G5", _feed_sql(f"""
SELECT CAST(coalesce(ceil(max(row_rank) / {BATCH}), 0) AS BIGINT) AS batches,
       CAST(count(*) AS BIGINT) AS items FROM feed
""", True))
def g5t(spark, sf):
    return G.send_totals(feed_rows(spark, sf, True), BATCH)
