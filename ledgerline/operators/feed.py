"""Change feeds and payload batches.

A change set (sku, qty) is fanned out over a short, fixed list of source
codes with ``posexplode`` of a literal array (no cross join), numbered
globally in SKU order (see ``numbering``), then cut into files or batches by
integer division of that number.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import stock_status
from ledgerline.operators.numbering import with_row_number

# Default source codes when none are given, fixed values.
DEFAULT_SOURCES = ("pos_337", "src_virtualstock")
# Default rows per feed file and items per API batch, fixed values.
DEFAULT_CHUNK_ROWS = 1000
DEFAULT_BATCH_ITEMS = 500


def parse_sources(sources_csv: str | None) -> list[str]:
    """Comma list of source codes; blank -> defaults."""
    out = [s.strip() for s in (sources_csv or "").split(",") if s.strip()]
    return out or list(DEFAULT_SOURCES)


def change_feed(changes: DataFrame, sources=DEFAULT_SOURCES, sku: str = "sku",
                qty: str = "qty", order_cols: list[str] | None = None,
                zero_nulls: bool = True) -> DataFrame:
    """G1 + numbering: each change x source -> (sku, stock_status, source_code,
    qty) with ``sku_rank`` (position of the change) and ``row_rank``
    (position of the feed row). ``zero_nulls`` writes a null quantity as 0."""
    sources = list(sources)
    order_cols = order_cols or [sku, qty]
    ranked = with_row_number(changes, order_cols, "sku_rank")
    q = F.coalesce(F.col(qty), F.lit(0)) if zero_nulls else F.col(qty)
    n = len(sources)
    return ranked.select(
        F.col(sku).alias("sku"),
        stock_status(qty).alias("stock_status"),
        q.alias("qty"),
        "sku_rank",
        F.posexplode(F.array(*[F.lit(s) for s in sources])).alias("src_idx", "source_code"),
    ).select(
        "sku", "stock_status", "source_code", "qty", "sku_rank",
        ((F.col("sku_rank") - 1) * n + F.col("src_idx") + 1).cast("bigint").alias("row_rank"),
    )


def chunk_whole_changes(feed: DataFrame, chunk_rows: int, n_sources: int) -> DataFrame:
    """A file is closed after the change whose rows bring it to at least
    ``chunk_rows`` rows, so all rows of a change share a file."""
    per_file = math.ceil(chunk_rows / n_sources)
    return feed.withColumn("file_no", (F.floor((F.col("sku_rank") - 1) / per_file) + 1).cast("bigint"))


def chunk_exact_rows(feed: DataFrame, chunk_rows: int) -> DataFrame:
    """Exactly ``chunk_rows`` rows per file; a change may be split."""
    return feed.withColumn("file_no", (F.floor((F.col("row_rank") - 1) / chunk_rows) + 1).cast("bigint"))


def stock_item_batches(feed: DataFrame, batch_items: int = DEFAULT_BATCH_ITEMS) -> DataFrame:
    """JSON arrays of ``batch_items`` items {sku, source_code, quantity,
    status} in feed order. Each group is bounded by ``batch_items``."""
    items = feed.select(
        (F.floor((F.col("row_rank") - 1) / batch_items) + 1).cast("bigint").alias("batch_id"),
        F.struct(
            F.col("row_rank").alias("r"),
            F.struct(
                F.col("sku").alias("sku"),
                F.col("source_code").alias("source_code"),
                F.col("qty").cast("bigint").alias("quantity"),
                F.col("stock_status").cast("bigint").alias("status"),
            ).alias("item"),
        ).alias("e"),
    )
    return items.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.to_json(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["item"])).alias("payload"),
    )


def send_summary(feed: DataFrame, batch_items: int = DEFAULT_BATCH_ITEMS) -> DataFrame:
    """G5 (dry run): per batch the item count and its first item."""
    b = (F.floor((F.col("row_rank") - 1) / batch_items) + 1).cast("bigint")
    item = F.struct(F.col("sku").alias("sku"), F.col("source_code").alias("source_code"),
                    F.col("qty").cast("bigint").alias("quantity"),
                    F.col("stock_status").cast("bigint").alias("status"))
    return feed.groupBy(b.alias("batch_id")).agg(
        F.count(F.lit(1)).alias("n_items"),
        F.to_json(F.min_by(item, F.col("row_rank"))).alias("example"),
    )


def send_totals(feed: DataFrame, batch_items: int = DEFAULT_BATCH_ITEMS) -> DataFrame:
    """G5 totals: batches and items of a send."""
    return feed.agg(
        F.coalesce(F.ceil(F.max("row_rank") / batch_items), F.lit(0)).cast("bigint").alias("batches"),
        F.count(F.lit(1)).alias("items"),
    )
