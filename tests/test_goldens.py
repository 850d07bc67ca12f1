"""Small golden cases."""

import json

from ledgerline.operators import catalog as C
from ledgerline.operators import feed as G
from ledgerline.operators import reconcile as R

def _node(i, name, *kids):
    return {"id": i, "name": name, "children_data": list(kids)}


TREE = _node(10, "All", _node(20, "Tools", _node(21, "Saws"), _node(22, "Drills", _node(23, "Bits"), _node(24, "Chucks"))),
             _node(30, "Garden", _node(31, "Seeds")), _node(40, "Paint"))


def test_category_tree_json(spark):
    trees = spark.createDataFrame([(1, json.dumps(TREE))], "tree_id int, tree string")
    flat = C.flatten_tree_json(trees)
    rows = {r["id"]: r for r in flat.collect()}
    assert len(rows) == 9
    assert rows["24"]["path"] == "All/Tools/Drills/Chucks"
    assert max(r["depth"] for r in rows.values()) == 3
    parents = {r["parent_id"] for r in rows.values() if r["parent_id"]}
    assert len([i for i in rows if i not in parents]) == 5


def test_category_tree_generic_keys(spark):
    data = [{"value": "a", "label": "A", "children": [{"code": "b", "children": []}]}]
    flat = C.flatten_tree_json(spark.createDataFrame([(1, json.dumps(data))], "tree_id int, tree string"))
    got = sorted((r["id"], r["name"], r["parent_id"]) for r in flat.collect())
    assert got == [("a", "A", None), ("b", "b", "a")]


def test_stock_change_golden(spark):
    inv = spark.createDataFrame([("wh", "bolt", 40), ("wh", "nut", 3), ("wh", "cog", None), ("wh", "pin", 6)],
                                "Account string, SupplierSKU string, FreeStock int")
    latest = spark.createDataFrame([("wh", "bolt", 41), ("wh", "nut", 3), ("wh", "cog", 2), ("wh", "gear", 9)],
                                   "Account string, SupplierSKU string, FreeStock int")
    ch = R.changed_skus(latest, inv)
    assert sorted((r.sku, r.latest_qty) for r in ch.collect()) == [("bolt", 41), ("cog", 2), ("gear", 9)]
    feed = G.change_feed(ch, G.DEFAULT_SOURCES, qty="latest_qty", order_cols=["sku"])
    rows = feed.collect()
    assert len(rows) == 6 and all(r.stock_status == 1 for r in rows)
    assert sorted(r.row_rank for r in rows) == list(range(1, 7))


def test_parse_sources():
    assert G.parse_sources("") == list(G.DEFAULT_SOURCES)
    assert G.parse_sources(" a, ,b ") == ["a", "b"]


def test_sample_product_payload(spark):
    sample = {"product": {"sku": "T-7", "name": "Hand saw", "price": 12.5, "status": 1, "visibility": 4,
                          "type_id": "simple", "custom_attributes": [
                              {"attribute_code": "brand", "value": "Sharp"},
                              {"attribute_code": "description", "value": "Cuts wood."}]}}
    df = spark.createDataFrame([(json.dumps(sample),)], "payload string")
    r = C.extract_draft(df).first()
    assert (r.sku, r.name, r.price, r.status, r.description) == ("T-7", "Hand saw", 12.5, 1, "Cuts wood.")


def test_route_entities(spark):
    df = spark.createDataFrame([('{"product": {"sku": "X"}}',), ('{"category": {"id": 3}}',),
                                ('{"attributeSet": {"attribute_set_id": 4}}',), ('{"other": 1}',), ("{bad",)],
                               "payload string")
    got = [(r.kind, r.entity_key) for r in C.route_entities(df).collect()]
    assert got == [("product", "X"), ("category", "3"), ("attribute_set", "4"), ("error:unknown_shape", None),
                   ("error:invalid_json", None)]


def test_product_import_payload_defaults(spark):
    df = spark.createDataFrame([("S1", None, 0, '{"rrp": 9.5}', False, None, "", None, '{"color":"red"}', "", '["u1","u2"]')],
                               "sku string, name string, attribute_set_id int, price string, status boolean, "
                               "visibility int, type_id string, weight double, custom_attributes string, "
                               "extension_attributes string, image_urls string")
    p = json.loads(C.product_import_payload(df).first().json)["product"]
    assert p["attribute_set_id"] == 4 and p["visibility"] == 4 and p["type_id"] == "simple"
    assert p["status"] == 2 and p["price"] == 9.5 and p["weight"] == 0.0 and p["name"] is None
    assert [m["position"] for m in p["media_gallery_entries"]] == [1, 2]
    assert p["media_gallery_entries"][0]["label"] == "S1"
    assert p["custom_attributes"] == [{"attribute_code": "color", "value": "red"}]
    assert p["extension_attributes"] == {}


def test_build_product_payload_rules(spark):
    rows = spark.createDataFrame(
        [("S1", "", "12.5", "3.9", 1, 4, "simple", " 1, x,22 ,", 2, "  Nice  ",
          [("color", "red"), ("size", ""), ("mat", None)], ["3", "a", "7"]),
         ("", "n", "", "", 1, 4, "simple", "", 2, None, [], []),
         ("S3", "n", "abc", "", 1, 4, "simple", "", 2, None, [], []),
         ("S4", "n", "", "", 1, 4, "simple", "", 0, None, [], [])],
        "sku string, name string, price_text string, qty_text string, status_code int, visibility_code int, "
        "type_id string, websites_text string, attribute_set_id int, description string, "
        "custom_attributes array<struct<attribute_code:string,value:string>>, category_ids array<string>")
    out = {r.sku: r for r in C.build_product_payload(rows).collect()}
    p = json.loads(out["S1"].payload)["product"]
    assert p["name"] == "S1" and p["price"] == 12.5
    assert p["extension_attributes"] == {"website_ids": [1, 22], "stock_item": {"qty": 3, "is_in_stock": True}}
    assert p["custom_attributes"] == [{"attribute_code": "color", "value": "red"},
                                      {"attribute_code": "category_ids", "value": [3, 7]},
                                      {"attribute_code": "description", "value": "Nice"}]
    assert out[""].error == "no_sku" and out[""].payload is None
    assert out["S3"].error == "bad_number"
    assert out["S4"].error == "no_attribute_set"


def test_chunk_boundaries(spark):
    ch = spark.createDataFrame([(f"S{i}", i) for i in range(1, 8)], "sku string, qty int")
    feed = G.change_feed(ch, ["a", "b"], qty="qty", order_cols=["sku"])
    whole = {(r.sku, r.source_code): r.file_no for r in G.chunk_whole_changes(feed, 5, 2).collect()}
    # 5 rows per file with 2 sources: a file closes after the change that reaches 5 rows -> 3 changes per file
    assert [whole[(f"S{i}", "a")] for i in range(1, 8)] == [1, 1, 1, 2, 2, 2, 3]
    assert all(whole[(s, "a")] == whole[(s, "b")] for s, _ in whole)
    exact = sorted((r.row_rank, r.file_no) for r in G.chunk_exact_rows(feed, 5).collect())
    assert [f for _, f in exact] == [1] * 5 + [2] * 5 + [3] * 4
    batches = {r.batch_id: r.n_items for r in G.stock_item_batches(feed, 4).collect()}
    assert batches == {1: 4, 2: 4, 3: 4, 4: 2}


def test_order_merge_with_existing_table(spark):
    from ledgerline.operators import orders as O
    existing = spark.createDataFrame(
        [("A", "R1", "A", None, "O", 7, "USD", 10.0, 1.0, 11.0, '{"city":"X"}'),
         ("B", "R2", "B", None, "F", 8, "EUR", 20.0, 2.0, 22.0, None)],
        "order_id string, retailer string, order_reference string, order_date timestamp_ntz, status string, "
        "supplier_id bigint, currency_code string, subtotal double, tax double, total double, "
        "shipping_address string")
    page = json.dumps({"results": [{"order_reference": "A", "retailer": "NEW", "status": None, "subtotal": 5,
                                    "supplier": "/s/9/"}], "next": None})
    pages = spark.createDataFrame([(1, page)], "page_no bigint, payload string")
    merged = {r.order_id: r for r in O.merge_orders(O.scan_pages(pages), existing).collect()}
    a, b = merged["A"], merged["B"]
    assert a.retailer == "R1"                       # insert-only field keeps the stored value
    assert a.status is None                         # explicit JSON null overwrites
    assert a.currency_code == "USD"                 # absent key keeps the stored value
    assert (a.subtotal, a.tax, a.total) == (5.0, 0.0, 0.0)  # amounts always overwrite (absent -> 0.0)
    assert a.supplier_id == 9 and a.shipping_address == '{"city":"X"}'
    assert (b.status, b.subtotal, b.currency_code) == ("F", 20.0, "EUR")  # untouched order passes through


def test_deep_trees(spark):
    """Every node of a chain of 500 is returned, from rows and from JSON."""
    n = 500
    rows = spark.createDataFrame([(k, f"n{k}", k - 1 if k else None) for k in range(n)], "category_id int, name string, parent_id int")
    flat = C.flatten_tree_rows(spark, rows)
    assert flat.count() == n and flat.agg({"depth": "max"}).first()[0] == n - 1
    deep = 70
    tree = None
    for k in reversed(range(deep)):
        tree = _node(k, f"n{k}", *([tree] if tree else []))
    got = C.flatten_tree_json(spark.createDataFrame([(1, json.dumps(tree))], "tree_id int, tree string"))
    assert got.count() == deep and got.agg({"depth": "max"}).first()[0] == deep - 1


def test_tree_cycles_are_reported(spark):
    rows = spark.createDataFrame([(1, "r", None), (2, "a", 1), (3, "x", 4), (4, "y", 3), (5, "z", 4), (6, "o", 99)],
                                 "category_id int, name string, parent_id int")
    flat = C.flatten_tree_rows(spark, rows)
    assert sorted(r.category_id for r in flat.collect()) == [1, 2]
    lost = {r.category_id: r.reason for r in C.unreached_nodes(rows, flat).collect()}
    assert lost == {3: "cycle_or_below", 4: "cycle_or_below", 5: "cycle_or_below", 6: "missing_parent"}
