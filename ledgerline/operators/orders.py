"""Order payload ingest, merge and views (SURVEY A5, C11-C13, D3, D8, E10,
H4, I5, I6, J3, J4).

Payload pages are JSON documents ``{"results": [order, ...], "next": ...}``.
They are parsed to VARIANT once and exploded to one row per order with its
position ``ord`` (page order, then position in the page) and its members ``v``,
read in one pass over the order. Merging several
payloads of the same order is an aggregation per order key with
``max_by``/``min_by`` over ``ord`` (partial aggregation, no per-key sort).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.functions import jsonfn as J
from ledgerline.functions.scalars import strict_int


#: An order as it is read from VARIANT, in one pass over its members. VARIANT
#: members are those whose JSON type varies, or where null and absent differ.
ORDER_MEMBERS = {"order_reference": "variant", "order_id": "variant", "id": "variant", "retailer": "string",
                 "order_date": "string", "status": "variant", "supplier": "variant", "currency_code": "variant",
                 "subtotal": "double", "tax": "double", "total": "double", "shipping_address": "variant",
                 "retailer_data": "variant", "items": "variant"}


def scan_pages(pages: DataFrame, text_col: str = "payload", order_col: str = "page_no", items: bool = True) -> DataFrame:
    """A5: one row per order of each page: (ord, v) where ``ord`` is
    struct(page order, position) and ``v`` the order as struct of
    ``ORDER_MEMBERS`` (null: absent, or no object), on request without ``items``."""
    members = ", ".join(f"{name}: {kind}" for name, kind in ORDER_MEMBERS.items() if items or name != "items")
    v = F.try_parse_json(F.col(text_col))
    arr = F.try_variant_get(v, "$.results", f"array<struct<{members}>>")
    return (pages.select(F.col(order_col).alias("_page"), F.posexplode(arr).alias("_pos", "v"))
            .select(F.struct(F.col("_page"), F.col("_pos")).alias("ord"), "v"))


def order_key(v: Column) -> Column:
    """``order_reference`` or ``order_id`` or ``id`` (first truthy)."""
    return J.first_truthy_text(*[v[name] for name in ("order_reference", "order_id", "id")])


def flatten_orders(scanned: DataFrame) -> DataFrame:
    """A5 + C11-C13: typed order columns of each payload row (no merge)."""
    v = F.col("v")
    return scanned.select(
        "ord",
        order_key(v).alias("order_id"),
        v["retailer"].alias("retailer"),
        J.text(v["order_reference"], "$").alias("order_reference"),
        J.parse_iso_ts(v["order_date"]).alias("order_date"),
        J.text(v["status"], "$").alias("status"),
        J.supplier_id(v["supplier"]).alias("supplier_id"),
        J.text(v["currency_code"], "$").alias("currency_code"),
        *[F.coalesce(v[c], F.lit(0.0)).alias(c) for c in ("subtotal", "tax", "total")],
        F.to_json(v["shipping_address"]).alias("shipping_address"),
        F.to_json(v["retailer_data"]).alias("retailer_data"),
    ).where(F.col("order_id").isNotNull())


def _last_present(value: Column, is_present: Column) -> Column:
    return F.max_by(value, F.when(is_present, F.col("ord")))


def payload_columns(scanned: DataFrame, *extra: Column) -> DataFrame:
    """What ``merge_orders`` folds of each payload, in plain columns."""
    v = F.col("v")
    return scanned.select(
        "ord",
        order_key(v).alias("order_id"),
        v["retailer"].alias("retailer"),
        J.text(v["order_reference"], "$").alias("order_reference"),
        J.parse_iso_ts(v["order_date"]).alias("order_date"),
        J.text(v["status"], "$").alias("status"), v["status"].isNotNull().alias("_p_status"),
        J.supplier_id(v["supplier"]).alias("supplier_id"),
        J.text(v["currency_code"], "$").alias("currency_code"), v["currency_code"].isNotNull().alias("_p_cur"),
        *[F.coalesce(v[c], F.lit(0.0)).alias(c) for c in ("subtotal", "tax", "total")],
        F.to_json(v["shipping_address"]).alias("shipping_address"), v["shipping_address"].isNotNull().alias("_p_ship"),
        F.to_json(v["retailer_data"]).alias("retailer_data"), v["retailer_data"].isNotNull().alias("_p_data"), *extra,
    ).where(F.col("order_id").isNotNull())


def order_rows(scanned: DataFrame) -> DataFrame:
    """A5 of a batch that several folds read: ``payload_columns`` with the items
    as an array of ``ITEM_TYPE`` and their number. A VARIANT holds the names of
    its whole page, so a kept order of VARIANT members is many times this."""
    items = F.try_variant_get(F.col("v")["items"], "$", f"array<{ITEM_TYPE}>")
    return payload_columns(scanned, items.alias("items")).withColumn("n_items", F.coalesce(F.when(F.col("items").isNotNull(), F.size("items")), F.lit(0)))


def merge_orders(scanned: DataFrame, existing: DataFrame | None = None, items_col: str | None = None,
                 place: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Fold every payload of an order (in ``ord`` order) into one row.

    * status, currency_code, shipping_address, retailer_data: last payload holding the key
      (an explicit JSON null overwrites, an absent key keeps the old value);
    * order_date, supplier_id: last payload where they parse;
    * subtotal / tax / total: the last payload (absent -> 0.0);
    * retailer, order_reference: from the first payload (insert only).

    ``existing`` rows (same columns as the result) act as payload zero with
    every key present; existing orders without a new payload are passed
    through unchanged. ``items_col`` adds the last payload's items as JSON text
    (``items_from`` flattens them), so orders and items take one pass.

    ``scanned`` may also be ``order_rows``. ``place``, for a table that is
    written anew, adds columns that the key decides and deals the rows out by
    them; they come first in the result, which then needs no further shuffle."""
    extra = [F.to_json(F.col("v")["items"]).alias(items_col)] if items_col else []
    rows = payload_columns(scanned, *extra) if "v" in scanned.columns else scanned.drop("items", "n_items")
    if existing is not None:  # payload zero comes first; without one the payloads' own order will do
        rows = rows.withColumn("ord", F.struct(F.lit(1).alias("_src"), F.col("ord").alias("_o")))
    untouched = None
    if existing is not None:
        if "retailer_data" not in existing.columns:  # a table stored before the column was
            existing = existing.withColumn("retailer_data", F.lit(None).cast("string"))
        # only orders present in the new payloads are merged; the others pass
        # through an anti join (no aggregation of the whole existing table), or,
        # where all rows are dealt out anyway, are merged with nothing
        merged_too = existing
        if place is None:
            batch_keys = rows.select("order_id").distinct()
            untouched = existing.join(batch_keys, "order_id", "left_anti")
            merged_too = existing.join(batch_keys, "order_id", "left_semi")
        old = merged_too.select(
            F.struct(F.lit(0).alias("_src"), F.lit(None).cast(rows.schema["ord"].dataType["_o"].dataType)
                     .alias("_o")).alias("ord"),
            "order_id", "retailer", "order_reference", "order_date",
            "status", F.lit(True).alias("_p_status"), "supplier_id",
            "currency_code", F.lit(True).alias("_p_cur"), "subtotal", "tax", "total",
            "shipping_address", F.lit(True).alias("_p_ship"), "retailer_data", F.lit(True).alias("_p_data"),
            *[F.lit(None).cast("string").alias(items_col) for _ in extra])
        rows = old.unionByName(rows)
    # columns taken from the same payload share one aggregate, as each holds its own ``ord``
    last = ["subtotal", "tax", "total", *([items_col] if items_col else [])]
    placed = rows if place is None else place(rows)
    within = [c for c in placed.columns if c not in rows.columns]
    merged = placed.groupBy(*within, "order_id").agg(
        F.min_by(F.struct("retailer", "order_reference"), "ord").alias("_first"),
        _last_present(F.col("order_date"), F.col("order_date").isNotNull()).alias("order_date"),
        _last_present(F.col("status"), F.col("_p_status")).alias("status"),
        _last_present(F.col("supplier_id"), F.col("supplier_id").isNotNull()).alias("supplier_id"),
        _last_present(F.col("currency_code"), F.col("_p_cur")).alias("currency_code"),
        F.max_by(F.struct(*last), "ord").alias("_last"),
        _last_present(F.col("shipping_address"), F.col("_p_ship")).alias("shipping_address"),
        _last_present(F.col("retailer_data"), F.col("_p_data")).alias("retailer_data"),
    ).select(*within, "order_id", "_first.*", "order_date", "status", "supplier_id", "currency_code",
             *[f"_last.{c}" for c in last[:3]], "shipping_address", "retailer_data", *[f"_last.{c}" for c in last[3:]])
    if untouched is None:
        return merged
    return untouched.unionByName(merged, allowMissingColumns=True).select(*merged.columns)


ITEM_FIELDS = ("part_number", "retailer_sku_reference", "supplier_sku_reference", "line_reference", "name")


ITEM_NUMBERS = ("unit_cost_price", "subtotal", "tax", "tax_rate", "total")
#: An item as it is read from VARIANT, in one pass over its members.
ITEM_TYPE = "struct<" + ", ".join([*(f"{c}: string" for c in (*ITEM_FIELDS, "quantity", "promised_date")),
                                   *(f"{c}: double" for c in ITEM_NUMBERS)]) + ">"


def _item_columns(it: Column) -> dict[str, Column]:
    """The flat columns of an item of ``ITEM_TYPE``."""
    return {c: it[c] for c in ITEM_FIELDS} | {
        "quantity": F.coalesce(strict_int(it["quantity"]), F.lit(0))} | {
        c: F.coalesce(it[c], F.lit(0.0)) for c in ITEM_NUMBERS} | {
        "promised_date": J.parse_iso_ts(it["promised_date"])}


def items_from(orders: DataFrame, items_col: str) -> DataFrame:
    """(order_id, flat item columns) of orders with an item array as JSON text."""
    array = F.try_variant_get(F.try_parse_json(items_col), "$", f"array<{ITEM_TYPE}>")
    return orders.select("order_id", F.explode(array).alias("it")).select(
        "order_id", *[c.alias(name) for name, c in _item_columns(F.col("it")).items()])


def replace_items(scanned: DataFrame, existing_items: DataFrame | None = None,
                  fk: str = "order_id", place: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Items of every touched order are replaced by the items of its last
    payload; items of untouched orders are kept. One scan and one aggregation:
    the last payload's item array per order, then one row per item. ``place`` is
    that of ``merge_orders``; ``scanned`` is ``order_rows`` with it."""
    if place is not None:
        return _replaced_in_place(scanned, existing_items, fk, place)
    items = F.to_json(F.col("v")["items"])
    last = (scanned.select(order_key(F.col("v")).alias("order_id"), "ord", items.alias("_items"))
            .where(F.col("order_id").isNotNull())
            .groupBy("order_id").agg(F.max_by("_items", "ord").alias("_items")))
    new = items_from(last, "_items")
    if existing_items is None:
        return new
    kept = existing_items.join(last.select(F.col("order_id").alias("_t")),
                               F.col(fk) == F.col("_t"), "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def _replaced_in_place(rows: DataFrame, existing_items: DataFrame | None, fk: str, place: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """I6 with one shuffle of both tables: payloads stand before the stored
    items of their order, newest first; the first payload is kept, or else all
    stored items."""
    rows = rows.select(F.col("order_id").alias(fk), "ord", "n_items", "items")
    stored = [] if existing_items is None else [c for c in existing_items.columns if c != fk]
    if stored:
        old = existing_items.select(fk, F.struct(*stored).alias("_old"))
        rows = rows.unionByName(old, allowMissingColumns=True)
    placed = place(rows)
    within = [c for c in placed.columns if c not in rows.columns]
    # of payloads at one place the one with more items, as ``items_after`` counts them
    newest = Window.partitionBy(*within, fk).orderBy(F.col("ord").desc_nulls_last(), F.col("n_items").desc())
    first = placed.select("*", F.row_number().over(newest).alias("_n"), F.rank().over(newest).alias("_rank")).where(
        "_n = 1 OR (ord IS NULL AND _rank = 1)").drop("_n", "_rank")
    is_new = F.col("ord").isNotNull()
    none = F.lit(None).cast(first.schema["items"].dataType.elementType)
    flat = first.select(*within, fk, is_new.alias("_new"), *(["_old"] if stored else []),
                        F.explode(F.when(is_new, F.col("items")).otherwise(F.array(none))).alias("it"))
    columns = _item_columns(F.col("it"))
    if stored:
        columns = {c: F.when(F.col("_new"), columns.get(c)).otherwise(F.col("_old")[c] if c in stored else None)
                   for c in [*stored, *(c for c in columns if c not in stored)]}
    return flat.select(*within, fk, *[c.alias(name) for name, c in columns.items()])


def items_after(rows: DataFrame, existing_items: DataFrame | None = None, fk: str = "order_id") -> DataFrame:
    """(key, n): how many items ``replace_items`` leaves each order with, from
    keys and counts alone."""
    counts = rows.select(F.col("order_id").alias(fk), "ord", "n_items", F.lit(0).alias("_kept"))
    if existing_items is not None:
        counts = counts.unionByName(existing_items.select(fk, F.lit(1).alias("_kept")), allowMissingColumns=True)
    last = F.max_by("n_items", F.when(F.col("ord").isNotNull(), F.struct("ord", "n_items")))
    return counts.groupBy(fk).agg(F.coalesce(last.cast("bigint"), F.sum("_kept")).alias("n")).where("n > 0")


def orders_after(rows: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """(key, n): the orders that ``merge_orders`` leaves, one row each."""
    keys = rows.select("order_id")
    if existing is not None:
        keys = keys.unionByName(existing.select("order_id"))
    return keys.distinct().withColumn("n", F.lit(1).cast("bigint"))


def filter_orders(orders: DataFrame, status: str | None = None, retailer: str | None = None,
                  date_from: str | None = None, date_to: str | None = None,
                  date_col: str = "order_date") -> DataFrame:
    """D3 (+H4): status equality (``All`` = no filter), retailer equality,
    from <= date < to + 1 day (swapped bounds repaired), newest first, then by
    order id."""
    if date_from and date_to and date_from > date_to:
        date_from, date_to = date_to, date_from
    ts_type = orders.schema[date_col].dataType  # bounds in the column's own type
    out = orders
    if status and status != "All":
        out = out.where(F.col("status") == status)
    if retailer:
        out = out.where(F.col("retailer") == retailer)
    if date_from:
        out = out.where(F.col(date_col) >= F.lit(date_from).cast(ts_type))
    if date_to:
        out = out.where(F.col(date_col) < F.lit(date_to).cast(ts_type) + F.expr("INTERVAL 1 DAY"))
    return out.orderBy(F.col(date_col).desc_nulls_last(), F.col("order_id").asc())


def updated_since(df: DataFrame, ts_col: str, as_of: str, hours: int) -> DataFrame:
    """Rows with ``ts >= as_of - hours`` (``as_of`` explicit for tests)."""
    bound = F.lit(as_of).cast(df.schema[ts_col].dataType) - F.make_interval(hours=F.lit(hours))
    return df.where(F.col(ts_col) >= bound)


def items_of_order(items: DataFrame, orders: DataFrame, key: str, fk: str) -> DataFrame:
    """Parent-child fetch: the items of the given orders."""
    return items.join(orders.select(F.col(key).alias("_k")).distinct(), F.col(fk) == F.col("_k"), "left_semi")


# Export column names of the flat order and item files, fixed values.
ORDER_EXPORT = ("order_id", "retailer", "order_reference", "order_date", "status", "supplier_id",
                "currency", "subtotal", "tax", "total")
ITEM_EXPORT = {"order_id": "order_fk", "line_reference": "line_reference", "part_number": "part_number",
               "name": "name", "quantity": "qty", "unit_cost_price": "unit_cost", "subtotal": "subtotal",
               "tax": "tax", "tax_rate": "tax_rate", "total": "total", "promised_date": "promised_date",
               "retailer_sku_reference": "retailer_sku", "supplier_sku_reference": "supplier_sku"}


def export_orders(orders: DataFrame) -> DataFrame:
    """Flat order export, ISO date text (empty when missing), newest
    first, then by order id."""
    return orders.select(
        "order_id", "retailer", "order_reference",
        F.coalesce(F.date_format("order_date", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("")).alias("order_date"),
        "status", "supplier_id", F.col("currency_code").alias("currency"),
        "subtotal", "tax", "total", F.col("order_date").alias("_d"),
    ).orderBy(F.col("_d").desc_nulls_last(), F.col("order_id").asc()).drop("_d")


def export_items(items: DataFrame) -> DataFrame:
    """Item export with renamed columns."""
    cols = []
    for src, dst in ITEM_EXPORT.items():
        c = F.col(src)
        if src == "promised_date":
            c = F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
        cols.append(c.alias(dst))
    return items.select(*cols)
