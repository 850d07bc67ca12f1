"""Registered queries: order payload ingest and views (A5, C11-C13, I5, I6,
D3, D8, E10, H4, J3, J4).

Payload pages are built in Spark from ``orders`` and ``lineitem`` with
``to_json`` (two fetches: every order, then updates of every fourth order
with absent keys, explicit nulls and unparsable dates); the oracle works on
the rows before JSON.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import orders as O
from ledgerline.plans.fixtures import with_fixtures
from ledgerline.plans.registry import in_order, register
from ledgerline.session import spread, table

PAGE = 50  # orders per payload page
FETCH_STRIDE = 10 ** 12


def _v(c):
    return c.cast("variant")


def _absent():
    return F.lit(None).cast("variant")


def _jnull():
    return F.parse_json(F.lit("null"))


def _iso(c, fmt):
    return F.date_format(c, fmt)


ORDER_COLUMNS = ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


def _item_row():
    """An item's columns in the order that sorts an order's items."""
    return F.struct(
        F.col("l_linenumber").alias("ln"),
        F.col("l_partkey").cast("string").alias("part"),
        F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_tax").alias("rate"),
        F.col("l_shipdate").alias("shipdate"),
    )


def _item(i):
    return F.struct(
        F.concat(F.lit("P"), i["part"]).alias("part_number"),
        i["ln"].cast("string").alias("line_reference"),
        i["quantity"].alias("quantity"),
        F.concat(F.lit("Part "), i["part"]).alias("name"),
        i["unit"].alias("unit_cost_price"),
        i["price"].alias("subtotal"),
        (i["price"] * i["rate"]).alias("tax"),
        i["rate"].alias("tax_rate"),
        (i["price"] + i["price"] * i["rate"]).alias("total"),
        _iso(i["shipdate"], "yyyy-MM-dd'T'HH:mm:ss").alias("promised_date"),
    )


def _orders_with_items(spark, sf):
    """Orders with their items (null: none) and ``bucket``, the number of their
    page. Both tables are dealt out by it as they are, so a page is put together
    where its orders are, and no JSON or part of it is shuffled or sorted."""
    orders, li = table(spark, sf, "orders"), table(spark, sf, "lineitem").where("l_orderkey is not null")
    o = orders.select(F.col("o_orderkey").alias("_ok"), F.struct(*ORDER_COLUMNS).alias("_order"), F.lit(None).alias("_item"))
    i = li.select(F.col("l_orderkey").alias("_ok"), F.lit(None).alias("_order"), _item_row().alias("_item"))
    both = spread(o.unionByName(i).select(F.floor(F.col("_ok") / PAGE).alias("bucket"), "*"), "bucket")
    items = F.array_sort(F.collect_list("_item"))
    return both.groupBy("bucket", "_ok").agg(F.collect_list("_order").alias("_orders"), items.alias("_all")).select(
        "bucket", F.explode("_orders").alias("_order"), F.when(F.size("_all") > 0, F.col("_all")).alias("items")).select(
        "bucket", "_order.*", "items")


def order_payload_pages(spark, sf):
    """Pages ``{"results": [...], "next": null}`` of two fetches. Each fetch
    is serialised from a typed struct; VARIANT is used only where a key's JSON
    type varies (supplier) or must be an explicit ``null``."""
    base = _orders_with_items(spark, sf)
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    ks = k.cast("string")
    n = (cust % 100).cast("string")
    keys = [
        F.when(k % 10 == 0, F.lit("")).otherwise(F.concat(F.lit("REF-"), ks)).alias("order_reference"),
        F.when(k % 30 == 0, F.lit("")).when(k % 10 == 0, F.concat(F.lit("OID-"), ks)).alias("order_id"),
        k.alias("id"),
    ]
    od = F.col("o_orderdate")
    date1 = (F.when(k % 4 == 0, _iso(od, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
             .when(k % 4 == 1, _iso(od, "yyyy-MM-dd HH:mm:ss"))
             .when(k % 4 == 2, _iso(od, "yyyyMMdd'T'HHmmss"))
             .when(k % 9 == 0, F.lit("n/a"))
             .otherwise(_iso(od, "yyyy-MM-dd'T'HH:mm:ss")))
    supplier = F.parse_json(
        F.when(k % 5 == 0, n)
        .when(k % 5 == 1, F.concat(F.lit('{"id":"'), n, F.lit('"}')))
        .when(k % 5 == 2, F.concat(F.lit('"/api/suppliers/'), n, F.lit('/"')))
        .when(k % 5 == 3, F.concat(F.lit('"sup-'), n, F.lit('x"')))
        .otherwise(F.lit('"abc"')))
    ship1 = F.struct(F.concat(F.lit("C"), (cust % 13).cast("string")).alias("city"),
                     F.when(cust % 3 == 0, F.lit("DE")).otherwise(F.lit("FR")).alias("country"))
    json1 = F.to_json(F.struct(
        *keys,
        F.concat(F.lit("R"), (cust % 7).cast("string")).alias("retailer"),
        date1.alias("order_date"),
        F.col("o_orderstatus").alias("status"),
        supplier.alias("supplier"),
        F.when(cust % 2 == 0, F.lit("USD")).otherwise(F.lit("EUR")).alias("currency_code"),
        F.col("o_totalprice").alias("subtotal"),
        (F.col("o_totalprice") * 0.1).alias("tax"),
        (F.col("o_totalprice") * 1.1).alias("total"),
        ship1.alias("shipping_address"),
        F.struct(F.concat(F.lit("L"), (cust % 5).cast("string")).alias("lane")).alias("retailer_data"),
        F.transform("items", _item).alias("items"),
    ))
    json2 = F.to_json(F.struct(
        *keys,
        F.lit("CHANGED").alias("retailer"),
        F.when(k % 7 == 0, F.lit("n/a"))
        .otherwise(_iso(od + F.expr("INTERVAL 1 DAY"), "yyyy-MM-dd HH:mm:ss")).alias("order_date"),
        F.when(k % 3 == 1, _v(F.lit("U"))).when(k % 3 == 2, _jnull()).otherwise(_absent()).alias("status"),
        F.when(k % 5 == 0, _jnull()).otherwise(_absent()).alias("currency_code"),
        F.when(k % 3 != 0, F.col("o_totalprice") * 2).alias("subtotal"),
        F.when(k % 11 == 0, F.struct(F.lit("MOVED").alias("city"), F.lit("DE").alias("country")))
        .alias("shipping_address"),
        F.when(k % 13 == 0, F.struct(F.lit("X").alias("lane"))).alias("retailer_data"),
        F.transform(F.filter("items", lambda i: i["ln"] == 1), _item).alias("items"),
    ))
    # both fetches from one pass over the base: every order in fetch 1, every
    # fourth order again in fetch 2
    fetches = F.when(k % 4 == 1, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    both = (base.select(F.explode(fetches).alias("fetch"), "*")
            .select("fetch", "bucket", k.alias("k"), F.when(F.col("fetch") == 1, json1).otherwise(json2).alias("js")))
    pages = both.groupBy("fetch", "bucket").agg(
        F.array_join(F.array_sort(F.collect_list(F.struct("k", "js")))["js"], ",").alias("results"))
    return pages.select(
        (F.col("fetch") * FETCH_STRIDE + F.col("bucket")).cast("bigint").alias("page_no"),
        F.concat(F.lit('{"results":['), F.col("results"), F.lit('],"next":null}')).alias("payload"))


def scanned(spark, sf, items=True):
    return O.scan_pages(order_payload_pages(spark, sf), items=items)


# ---------------------------------------------------------------------------
# Oracle: the same rows before JSON, and the merge rules written in SQL.

_KEY = ("CASE WHEN o_orderkey % 30 = 0 THEN CAST(o_orderkey AS VARCHAR) "
        "WHEN o_orderkey % 10 = 0 THEN concat('OID-', CAST(o_orderkey AS VARCHAR)) "
        "ELSE concat('REF-', CAST(o_orderkey AS VARCHAR)) END")
_REF = "CASE WHEN o_orderkey % 10 = 0 THEN '' ELSE concat('REF-', CAST(o_orderkey AS VARCHAR)) END"
_OD = "date_trunc('second', o_orderdate)"
_DATE1 = f"CASE WHEN o_orderkey % 4 = 3 AND o_orderkey % 9 = 0 THEN NULL ELSE {_OD} END"
_SUP = ("CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE CAST(o_custkey % 100 AS BIGINT) END")
_CUR = "CASE WHEN o_custkey % 2 = 0 THEN 'USD' ELSE 'EUR' END"
_SHIP1 = ("concat('{\"city\":\"C', CAST(o_custkey % 13 AS VARCHAR), '\",\"country\":\"', "
          "CASE WHEN o_custkey % 3 = 0 THEN 'DE' ELSE 'FR' END, '\"}')")
_DATA1 = "concat('{\"lane\":\"L', CAST(o_custkey % 5 AS VARCHAR), '\"}')"
_FMT = "'%Y-%m-%d %H:%M:%S'"

_PAYLOAD_ROWS = f"""
SELECT 1 AS fetch_no, {_KEY} AS order_id, concat('R', CAST(o_custkey % 7 AS VARCHAR)) AS retailer,
       {_REF} AS order_reference, strftime({_DATE1}, {_FMT}) AS order_date, o_orderstatus AS status,
       {_SUP} AS supplier_id, {_CUR} AS currency_code,
       o_totalprice AS subtotal, o_totalprice * 0.1 AS tax,
       o_totalprice * 1.1 AS total, {_SHIP1} AS shipping_address, {_DATA1} AS retailer_data
FROM orders WHERE o_orderkey <> 0
UNION ALL
SELECT 2, {_KEY}, 'CHANGED', {_REF},
       CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE strftime({_OD} + INTERVAL 1 DAY, {_FMT}) END,
       CASE WHEN o_orderkey % 3 = 1 THEN 'U' ELSE NULL END,
       NULL, NULL,
       CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_totalprice * 2 END, 0.0, 0.0,
       CASE WHEN o_orderkey % 11 = 0 THEN '{{"city":"MOVED","country":"DE"}}' ELSE NULL END,
       CASE WHEN o_orderkey % 13 = 0 THEN '{{"lane":"X"}}' ELSE NULL END
FROM orders WHERE o_orderkey % 4 = 1 AND o_orderkey <> 0
"""


def _flat(df):
    return df.select(
        F.floor(F.col("ord._page") / FETCH_STRIDE).cast("int").alias("fetch_no"),
        "order_id", "retailer", "order_reference",
        F.date_format("order_date", "yyyy-MM-dd HH:mm:ss").alias("order_date"),
        "status", "supplier_id", "currency_code",
        "subtotal", "tax", "total", "shipping_address", "retailer_data")


@register("a5_order_payload_scan", "A5/C11/C12/C13", _PAYLOAD_ROWS)
def a5(spark, sf):
    return _flat(O.flatten_orders(scanned(spark, sf, items=False)))


_MERGED = f"""
SELECT {_KEY} AS order_id, concat('R', CAST(o_custkey % 7 AS VARCHAR)) AS retailer, {_REF} AS order_reference,
       CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 7 <> 0 THEN {_OD} + INTERVAL 1 DAY ELSE {_DATE1} END AS order_date,
       CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 = 1 THEN 'U'
            WHEN o_orderkey % 4 = 1 AND o_orderkey % 3 = 2 THEN NULL ELSE o_orderstatus END AS status,
       {_SUP} AS supplier_id,
       CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 5 = 0 THEN NULL ELSE {_CUR} END AS currency_code,
       CASE WHEN o_orderkey % 4 = 1 THEN (CASE WHEN o_orderkey % 3 = 0 THEN 0.0 ELSE o_totalprice * 2 END)
            ELSE o_totalprice END AS subtotal,
       CASE WHEN o_orderkey % 4 = 1 THEN 0.0 ELSE o_totalprice * 0.1 END AS tax,
       CASE WHEN o_orderkey % 4 = 1 THEN 0.0 ELSE o_totalprice * 1.1 END AS total,
       CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 11 = 0 THEN '{{"city":"MOVED","country":"DE"}}'
            ELSE {_SHIP1} END AS shipping_address,
       CASE WHEN o_orderkey % 4 = 1 AND o_orderkey % 13 = 0 THEN '{{"lane":"X"}}' ELSE {_DATA1} END AS retailer_data
FROM orders WHERE o_orderkey <> 0
"""
_MERGED_OUT = ("SELECT order_id, retailer, order_reference, strftime(order_date, " + _FMT + ") AS order_date, "
               "status, supplier_id, currency_code, subtotal AS subtotal, tax AS tax, "
               "total AS total, shipping_address, retailer_data FROM merged")


def merged_orders(spark, sf):
    return O.merge_orders(scanned(spark, sf, items=False))


def _merged_out(df):
    return df.select("order_id", "retailer", "order_reference",
                     F.date_format("order_date", "yyyy-MM-dd HH:mm:ss").alias("order_date"),
                     "status", "supplier_id", "currency_code",
                     "subtotal", "tax", "total", "shipping_address", "retailer_data")


@register("i5_merge_orders", "I5", with_fixtures(_MERGED_OUT, extra={"merged": _MERGED}))
def i5(spark, sf):
    return _merged_out(merged_orders(spark, sf))


def _fetches(spark, sf):
    """The first fetch and the later one, as two scans."""
    pages = order_payload_pages(spark, sf)
    fetch = F.floor(F.col("page_no") / FETCH_STRIDE)
    return O.scan_pages(pages.where(fetch == 1)), O.scan_pages(pages.where(fetch > 1))


@register("i5_merge_into_stored", "I5", with_fixtures(_MERGED_OUT, extra={"merged": _MERGED}))
def i5_stored(spark, sf):
    first, later = _fetches(spark, sf)
    return _merged_out(O.merge_orders(later, O.merge_orders(first)))


_ITEMS = f"""
SELECT {_KEY} AS order_id, concat('P', CAST(l_partkey AS VARCHAR)) AS part_number,
       CAST(l_linenumber AS VARCHAR) AS line_reference, CAST(l_quantity AS INTEGER) AS quantity,
       concat('Part ', CAST(l_partkey AS VARCHAR)) AS name,
       l_extendedprice / l_quantity AS unit_cost_price, l_extendedprice AS subtotal,
       l_extendedprice * l_tax AS tax, l_tax AS tax_rate, l_extendedprice + l_extendedprice * l_tax AS total,
       date_trunc('second', l_shipdate) AS promised_date
FROM orders JOIN lineitem ON l_orderkey = o_orderkey
WHERE o_orderkey <> 0 AND (o_orderkey % 4 <> 1 OR l_linenumber = 1)
"""
_ITEM_OUT = ("SELECT order_id, part_number, line_reference, CAST(quantity AS BIGINT) AS quantity, name, "
             "unit_cost_price AS unit_cost_price, subtotal AS subtotal, tax AS tax, "
             "tax_rate AS tax_rate, total AS total, "
             "strftime(promised_date, " + _FMT + ") AS promised_date FROM items")


def replaced_items(spark, sf):
    return O.replace_items(scanned(spark, sf))


def _items_out(df):
    return df.select("order_id", "part_number", "line_reference", F.col("quantity").cast("bigint").alias("quantity"),
                     "name", "unit_cost_price", "subtotal", "tax", "tax_rate", "total",
                     F.date_format("promised_date", "yyyy-MM-dd HH:mm:ss").alias("promised_date"))


@register("i6_replace_items", "I6/J8", with_fixtures(_ITEM_OUT, extra={"items": _ITEMS}))
def i6(spark, sf):
    return _items_out(replaced_items(spark, sf))


@register("i6_replace_stored_items", "I6", with_fixtures(_ITEM_OUT, extra={"items": _ITEMS}))
def i6_stored(spark, sf):
    first, later = _fetches(spark, sf)
    return _items_out(O.replace_items(later, O.replace_items(first)))


# D3 / H4: status F, retailer R3, bounds given swapped
_D3 = dict(status="F", retailer="R3", date_from="1995-12-31", date_to="1994-01-01")


@register("d3_filter_orders", "D3/H4", with_fixtures(
    _MERGED_OUT.replace(" FROM merged", ", row_number() OVER (ORDER BY merged.order_date DESC NULLS LAST, order_id) AS position FROM merged")
    + " WHERE status = 'F' AND retailer = 'R3' AND merged.order_date >= TIMESTAMP '1994-01-01' "
    "AND merged.order_date < TIMESTAMP '1995-12-31' + INTERVAL 1 DAY", extra={"merged": _MERGED}))
def d3(spark, sf):
    return in_order(_merged_out(O.filter_orders(merged_orders(spark, sf), **_D3)))


@register("j4_export_orders", "J4/H4", with_fixtures(
    "SELECT order_id, retailer, order_reference, coalesce(strftime(order_date, '%Y-%m-%dT%H:%M:%S'), '') AS order_date, "
    "status, supplier_id, currency_code AS currency, subtotal AS subtotal, tax AS tax, "
    "total AS total, row_number() OVER (ORDER BY merged.order_date DESC NULLS LAST, order_id) AS position FROM merged",
    extra={"merged": _MERGED}))
def j4(spark, sf):
    return in_order(O.export_orders(merged_orders(spark, sf)))


@register("j3_export_items", "J3", with_fixtures(
    "SELECT order_id AS order_fk, line_reference, part_number, name, CAST(quantity AS BIGINT) AS qty, "
    "unit_cost_price AS unit_cost, subtotal AS subtotal, tax AS tax, "
    "tax_rate AS tax_rate, total AS total, "
    "coalesce(strftime(promised_date, '%Y-%m-%dT%H:%M:%S'), '') AS promised_date, "
    "CAST(NULL AS VARCHAR) AS retailer_sku, CAST(NULL AS VARCHAR) AS supplier_sku FROM items",
    extra={"items": _ITEMS}))
def j3(spark, sf):
    e = O.export_items(replaced_items(spark, sf))
    return e.select(*[F.col(c).cast("bigint").alias(c) if c == "qty" else c for c in e.columns])


@register("e10_items_of_orders", "E10", with_fixtures(
    _ITEM_OUT + " WHERE order_id IN (SELECT order_id FROM merged WHERE status = 'F' AND retailer = 'R3' "
    "AND order_date >= TIMESTAMP '1994-01-01' AND order_date < TIMESTAMP '1995-12-31' + INTERVAL 1 DAY)",
    extra={"merged": _MERGED, "items": _ITEMS}))
def e10(spark, sf):
    """Orders with their items in one pass; the filter runs before the items are flattened."""
    merged = O.merge_orders(scanned(spark, sf), items_col="_items")
    return _items_out(O.items_from(O.filter_orders(merged, **_D3), "_items"))


@register("e10_parent_child_fetch", "E10", """
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem
WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P')""")
def e10_fetch(spark, sf):
    orders = table(spark, sf, "orders").where("o_orderstatus = 'P'")
    return O.items_of_order(table(spark, sf, "lineitem"), orders, "o_orderkey", "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


AS_OF = "2024-01-10 00:00:00"


@register("d8_updated_since", "D8", f"""
SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, user_id, event_type, value, props FROM events
WHERE ts >= TIMESTAMP '{AS_OF}' - INTERVAL 48 HOUR""")
def d8(spark, sf):
    e = O.updated_since(table(spark, sf, "events"), "ts", AS_OF, 48)
    return e.select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"),
                    "user_id", "event_type", "value", "props")
