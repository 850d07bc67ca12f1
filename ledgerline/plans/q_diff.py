"""Registered queries: keyed diff, duplicates, sync, upsert, deletes, key sets
(H1, F5-F8, I1-I4, I8-I13, E5, E6, J2, D7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import diff as D
from ledgerline.operators import setops as S
from ledgerline.operators import upsert as U
from ledgerline.plans import duck
from ledgerline.plans.fixtures import fixture, with_fixtures
from ledgerline.plans.q_reconcile import vs_norm
from ledgerline.plans.registry import register

KEYS = ["SupplierSKU"]
COMPARE = ["Account", "FreeStock"]


def _snapshots(spark, sf):
    return fixture(spark, sf, "inventory_latest"), fixture(spark, sf, "inventory")


def _dedupe_sql(src: str, name: str) -> str:
    return (f"SELECT SupplierSKU, Account, FreeStock, 1 AS p, n FROM ("
            f"SELECT *, row_number() OVER (PARTITION BY SupplierSKU ORDER BY Account ASC NULLS FIRST, "
            f"FreeStock ASC NULLS FIRST) AS rn, count(*) OVER (PARTITION BY SupplierSKU) AS n "
            f"FROM {src}) WHERE rn = 1")


_DIFF_CTES = {
    "s": _dedupe_sql("inventory_latest", "s"),
    "t": _dedupe_sql("inventory", "t"),
    "j": """
SELECT CASE WHEN s.p IS NOT NULL THEN s.SupplierSKU ELSE t.SupplierSKU END AS k,
       s.p IS NOT NULL AS in_s, t.p IS NOT NULL AS in_t,
       s.Account AS Account_src, t.Account AS Account_tgt,
       s.FreeStock AS FreeStock_src, t.FreeStock AS FreeStock_tgt,
       coalesce(s.n, 0) AS ns, coalesce(t.n, 0) AS nt,
       s.p IS NOT NULL AND t.p IS NOT NULL AND s.Account IS DISTINCT FROM t.Account AS mod_a,
       s.p IS NOT NULL AND t.p IS NOT NULL AND s.FreeStock IS DISTINCT FROM t.FreeStock AS mod_f
FROM s FULL OUTER JOIN t ON s.SupplierSKU IS NOT DISTINCT FROM t.SupplierSKU
""",
    "jc": """
SELECT *, CASE WHEN NOT in_t THEN 'added' WHEN NOT in_s THEN 'removed'
               WHEN mod_a OR mod_f THEN 'modified' ELSE 'same' END AS change,
       coalesce(TRY_CAST(FreeStock_src AS DOUBLE), 0) > 0 AS fs_s_in,
       coalesce(TRY_CAST(FreeStock_tgt AS DOUBLE), 0) > 0 AS fs_t_in,
       coalesce(TRY_CAST(Account_src AS DOUBLE), 0) > 0 AS ac_s_in,
       coalesce(TRY_CAST(Account_tgt AS DOUBLE), 0) > 0 AS ac_t_in
FROM j
""",
}


def _diff_sql(select: str) -> str:
    return with_fixtures(select, "inventory", "inventory_latest", extra=_DIFF_CTES)


def _diff_args(spark, sf):
    src, tgt = _snapshots(spark, sf)
    return src, tgt, KEYS, KEYS, COMPARE


@register("f5_keyed_diff", "F5/C16/E4", _diff_sql("""
SELECT coalesce(CAST(k AS VARCHAR), '') AS key, change, Account_src, Account_tgt, FreeStock_src, FreeStock_tgt
FROM jc WHERE change <> 'same'
"""))
def f5(spark, sf):
    return D.keyed_diff(*_diff_args(spark, sf))


def _cnt(cond):
    return f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


@register("f5s_diff_stats", "F5s", _diff_sql(f"""
SELECT CAST(sum(ns) AS BIGINT) AS total_src, CAST(sum(nt) AS BIGINT) AS total_tgt,
       {_cnt("change = 'added'")} AS added, {_cnt("change = 'removed'")} AS removed,
       {_cnt("change = 'modified'")} AS modified, {_cnt("change = 'same'")} AS same
FROM jc
"""))
def f5s(spark, sf):
    return D.diff_stats(*_diff_args(spark, sf))


@register("f5s_diff_column_counts", "F5s", _diff_sql(f"""
SELECT 'Account' AS column_name, {_cnt("mod_a")} AS modified FROM jc
UNION ALL SELECT 'FreeStock', {_cnt("mod_f")} FROM jc
"""))
def f5c(spark, sf):
    return D.diff_column_counts(*_diff_args(spark, sf))


_FLIPS = f"""
SELECT 'Account' AS column_name, {_cnt("in_s AND in_t AND ac_s_in AND NOT ac_t_in")} AS src_in_tgt_out,
       {_cnt("in_s AND in_t AND NOT ac_s_in AND ac_t_in")} AS src_out_tgt_in FROM jc
UNION ALL
SELECT 'FreeStock', {_cnt("in_s AND in_t AND fs_s_in AND NOT fs_t_in")},
       {_cnt("in_s AND in_t AND NOT fs_s_in AND fs_t_in")} FROM jc
"""


@register("f6_in_stock_flips", "F6", _diff_sql(_FLIPS))
def f6(spark, sf):
    return D.in_stock_flips(*_diff_args(spark, sf))


@register("f7_diff_report", "F7", _diff_sql(f"""
SELECT 'totals' AS section, 'source_rows' AS metric, CAST(sum(ns) AS BIGINT) AS value FROM jc
UNION ALL SELECT 'totals', 'target_rows', CAST(sum(nt) AS BIGINT) FROM jc
UNION ALL SELECT 'totals', 'added', {_cnt("change = 'added'")} FROM jc
UNION ALL SELECT 'totals', 'removed', {_cnt("change = 'removed'")} FROM jc
UNION ALL SELECT 'totals', 'modified', {_cnt("change = 'modified'")} FROM jc
UNION ALL SELECT 'totals', 'same', {_cnt("change = 'same'")} FROM jc
UNION ALL SELECT 'modified_values', 'Account', {_cnt("mod_a")} FROM jc
UNION ALL SELECT 'modified_values', 'FreeStock', {_cnt("mod_f")} FROM jc
UNION ALL SELECT 'stock_to_none', 'Account', {_cnt("in_s AND in_t AND ac_s_in AND NOT ac_t_in")} FROM jc
UNION ALL SELECT 'none_to_stock', 'Account', {_cnt("in_s AND in_t AND NOT ac_s_in AND ac_t_in")} FROM jc
UNION ALL SELECT 'stock_to_none', 'FreeStock', {_cnt("in_s AND in_t AND fs_s_in AND NOT fs_t_in")} FROM jc
UNION ALL SELECT 'none_to_stock', 'FreeStock', {_cnt("in_s AND in_t AND NOT fs_s_in AND fs_t_in")} FROM jc
"""))
def f7(spark, sf):
    return D.diff_report(*_diff_args(spark, sf))


_STOCK_ORDER = "row_id ASC NULLS FIRST, sku ASC NULLS FIRST, account ASC NULLS FIRST, qty ASC NULLS FIRST"


@register("h1_first_per_key", "H1", with_fixtures(f"""
SELECT row_id, sku, account, qty FROM (
  SELECT *, row_number() OVER (PARTITION BY sku ORDER BY {_STOCK_ORDER}) AS rn FROM stock_wh)
WHERE rn = 1
""", "stock_wh"))
def h1(spark, sf):
    return D.first_per_key(fixture(spark, sf, "stock_wh"), ["sku"], ["row_id"])


@register("f8_duplicate_rows", "F8", with_fixtures(f"""
SELECT row_id, sku, account, qty FROM (
  SELECT *, row_number() OVER (PARTITION BY coalesce(CAST(sku AS VARCHAR), ''),
                                            coalesce(CAST(account AS VARCHAR), '')
                               ORDER BY {_STOCK_ORDER}) AS rn FROM stock_wh)
WHERE rn > 1
""", "stock_wh"))
def f8(spark, sf):
    return D.duplicate_rows(fixture(spark, sf, "stock_wh"), ["sku", "account"], ["row_id"])


_SYNC_BODY = """
SELECT CASE WHEN s.p IS NOT NULL THEN s.Account ELSE t.Account END AS Account,
       CASE WHEN t.p IS NOT NULL THEN t.SupplierSKU ELSE s.SupplierSKU END AS SupplierSKU,
       CASE WHEN s.p IS NOT NULL THEN s.FreeStock ELSE t.FreeStock END AS FreeStock
FROM t FULL OUTER JOIN s ON s.SupplierSKU IS NOT DISTINCT FROM t.SupplierSKU
"""
_SYNC_SQL = _diff_sql(_SYNC_BODY)


def synced(spark, sf):
    src, tgt = _snapshots(spark, sf)
    return D.sync_into(src, tgt, KEYS, KEYS, COMPARE)


register("i1_sync_into_target", "I1/B8", _SYNC_SQL)(synced)


@register("i1_sync_touched", "I1", with_fixtures(
    "SELECT CAST(count(*) AS BIGINT) AS touched FROM (SELECT DISTINCT SupplierSKU FROM inventory_latest)",
    "inventory_latest"))
def i1c(spark, sf):
    return D.sync_touched(fixture(spark, sf, "inventory_latest"), KEYS)


# Insert-or-replace of a batch derived from stock_wh into inventory


def upsert_batch(spark, sf):
    w = fixture(spark, sf, "stock_wh")
    return w.select(
        "row_id",
        F.col("account").alias("Account"),
        F.when(F.col("row_id") % 50 == 0, F.lit(None))
        .otherwise(F.replace(F.trim("sku"), F.lit("p-"), F.lit("SKU"))).alias("SupplierSKU"),
        F.floor("qty").cast("int").alias("FreeStock"))


_BATCH_SQL = ("SELECT row_id, account AS Account, CASE WHEN row_id % 50 = 0 THEN NULL "
              "ELSE replace(trim(sku), 'p-', 'SKU') END AS SupplierSKU, "
              "CAST(floor(qty) AS INTEGER) AS FreeStock FROM stock_wh")


@register("i2_insert_or_replace", "I2/B7", with_fixtures("""
SELECT Account, SupplierSKU, FreeStock FROM u WHERE SupplierSKU IS NULL
UNION ALL
SELECT Account, SupplierSKU, FreeStock FROM (
  SELECT *, row_number() OVER (PARTITION BY SupplierSKU ORDER BY src DESC, row_id DESC NULLS LAST,
         Account DESC NULLS LAST, FreeStock DESC NULLS LAST) AS rn
  FROM u WHERE SupplierSKU IS NOT NULL) WHERE rn = 1
""", "inventory", "stock_wh", extra={
    "batch": _BATCH_SQL,
    "u": ("SELECT Account, SupplierSKU, FreeStock, 0 AS src, CAST(NULL AS BIGINT) AS row_id FROM inventory "
          "UNION ALL SELECT Account, SupplierSKU, FreeStock, 1, row_id FROM batch"),
}))
def i2(spark, sf):
    return U.insert_or_replace(fixture(spark, sf, "inventory"), upsert_batch(spark, sf),
                               ["SupplierSKU"], ["row_id"])


@register("i2_plain_insert", "I2/I3", with_fixtures(
    "SELECT Account, SupplierSKU, FreeStock FROM inventory UNION ALL "
    "SELECT Account, SupplierSKU, FreeStock FROM batch",
    "inventory", "stock_wh", extra={"batch": _BATCH_SQL}))
def i2p(spark, sf):
    return U.insert_or_replace(fixture(spark, sf, "inventory"),
                               upsert_batch(spark, sf).drop("row_id"), None)


@register("i4_refresh_latest", "I4", with_fixtures(
    "SELECT coalesce(account, '') AS Account, sku AS SupplierSKU, qty AS FreeStock FROM v_norm",
    "feed_v", extra=duck.vs_ctes()))
def i4(spark, sf):
    return U.refresh_latest_from_norm(vs_norm(spark, sf))


# E5 / E6 / J2 / D7 over the two snapshots' keys

register("e5_anti_join", "E5", with_fixtures(
    "SELECT * FROM inventory_latest l WHERE NOT EXISTS "
    "(SELECT 1 FROM inventory p WHERE p.SupplierSKU = l.SupplierSKU)",
    "inventory", "inventory_latest"))(
    lambda spark, sf: S.anti_join(*_snapshots(spark, sf), KEYS))
register("e6_semi_join", "E6", with_fixtures(
    "SELECT * FROM inventory_latest l WHERE EXISTS "
    "(SELECT 1 FROM inventory p WHERE p.SupplierSKU = l.SupplierSKU)",
    "inventory", "inventory_latest"))(
    lambda spark, sf: S.semi_join(*_snapshots(spark, sf), KEYS))

_KS = "SELECT SupplierSKU, Account FROM {}"
for _name, _op, _fn in (("union", "UNION", S.key_union), ("intersection", "INTERSECT", S.key_intersection),
                        ("difference", "EXCEPT", S.key_difference)):
    register(f"j2_key_{_name}", "J2", with_fixtures(
        f"{_KS.format('inventory_latest')} {_op} {_KS.format('inventory')}",
        "inventory", "inventory_latest"))(
        (lambda fn: lambda spark, sf: fn(*_snapshots(spark, sf), ["SupplierSKU", "Account"]))(_fn))


@register("d7_selected_ids", "D7", with_fixtures(
    "SELECT * FROM products WHERE part_number IN (SELECT concat('P', CAST(l_partkey AS VARCHAR)) "
    "FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1998-01-01')",
    "products"))
def d7(spark, sf):
    ids = selected_ids(spark, sf)
    return S.in_ids(fixture(spark, sf, "products"), ids, "part_number")


def selected_ids(spark, sf):
    """Ids picked by a user: parts of recent returns (derived from lineitem)."""
    from ledgerline.session import table
    li = table(spark, sf, "lineitem")
    return li.where((F.col("l_returnflag") == "R") & (F.col("l_shipdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))) \
        .select(F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("part_number"))


_IDS_SQL = ("SELECT concat('P', CAST(l_partkey AS VARCHAR)) AS part_number FROM lineitem "
            "WHERE l_returnflag = 'R' AND l_shipdate >= TIMESTAMP '1998-01-01'")


@register("i9_bulk_update", "I9", with_fixtures("""
SELECT part_number, short_description, brand_name, category_name, vendor_id, msrp,
       CASE WHEN part_number IN (SELECT part_number FROM ids) THEN 2 ELSE status END AS status,
       CASE WHEN part_number IN (SELECT part_number FROM ids) THEN 1 ELSE visibility END AS visibility
FROM pm
""", "products", extra={"ids": _IDS_SQL, "pm": "SELECT *, 1 AS status, 4 AS visibility FROM products"}))
def i9(spark, sf):
    pm = fixture(spark, sf, "products").withColumn("status", F.lit(1)).withColumn("visibility", F.lit(4))
    return U.bulk_update(pm, selected_ids(spark, sf), "part_number", {"status": 2, "visibility": 1})


@register("i10_bulk_delete", "I10", with_fixtures(
    "SELECT * FROM products WHERE part_number NOT IN (SELECT part_number FROM ids)",
    "products", extra={"ids": _IDS_SQL}))
def i10(spark, sf):
    return U.delete_by_ids(fixture(spark, sf, "products"), selected_ids(spark, sf), "part_number")


# Deleting orders (urgent, still open) and the effect on their items


def deleted_orders(spark, sf):
    from ledgerline.session import table
    o = table(spark, sf, "orders")
    return o.where((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") == "O"))


_DEL_SQL = "SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'O'"


@register("i8_cascade_orders", "I8", f"SELECT * FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ({_DEL_SQL}))")
def i8o(spark, sf):
    from ledgerline.session import table
    return U.delete_by_ids(table(spark, sf, "orders"), deleted_orders(spark, sf), "o_orderkey")


@register("i8_cascade_items", "I8/I11", with_fixtures(
    f"SELECT * FROM order_items WHERE order_fk NOT IN (SELECT o_orderkey FROM ({_DEL_SQL}))", "order_items"))
def i8i(spark, sf):
    return U.delete_by_ids(fixture(spark, sf, "order_items"), deleted_orders(spark, sf), "order_fk", "o_orderkey")


@register("i11_fk_set_null", "I11", with_fixtures(f"""
SELECT CASE WHEN order_fk IN (SELECT o_orderkey FROM ({_DEL_SQL})) THEN NULL ELSE order_fk END AS order_fk,
       line_reference, part_number, quantity, subtotal, tax, tax_rate, promised_date
FROM order_items""", "order_items"))
def i11n(spark, sf):
    return U.fk_set_null(fixture(spark, sf, "order_items"), deleted_orders(spark, sf), "order_fk", "o_orderkey")


@register("i11_fk_restrict", "I11", with_fixtures(
    f"SELECT * FROM ({_DEL_SQL}) d WHERE EXISTS (SELECT 1 FROM order_items i WHERE i.order_fk = d.o_orderkey)",
    "order_items"))
def i11r(spark, sf):
    return U.fk_restrict_rejected(deleted_orders(spark, sf), fixture(spark, sf, "order_items"),
                                  "order_fk", "o_orderkey")


AS_OF = "2025-01-01 00:00:00"
CREATED = "2024-01-01 00:00:00"


@register("i12_stamp_changes", "I12", with_fixtures(f"""
SELECT n.Account, n.SupplierSKU, n.FreeStock,
       strftime(CASE WHEN o.p IS NULL THEN TIMESTAMP '{AS_OF}' ELSE o.created_at END, '%Y-%m-%d %H:%M:%S') AS created_at,
       strftime(CASE WHEN o.p IS NULL OR n.Account IS DISTINCT FROM o.Account
                          OR n.FreeStock IS DISTINCT FROM o.FreeStock
                     THEN TIMESTAMP '{AS_OF}' ELSE o.updated_at END, '%Y-%m-%d %H:%M:%S') AS updated_at
FROM synced n LEFT JOIN (SELECT *, 1 AS p, TIMESTAMP '{CREATED}' AS created_at, TIMESTAMP '{CREATED}' AS updated_at
                         FROM inventory) o ON n.SupplierSKU IS NOT DISTINCT FROM o.SupplierSKU
""", "inventory", "inventory_latest", extra={**_DIFF_CTES, "synced": _SYNC_BODY}))
def i12(spark, sf):
    old = fixture(spark, sf, "inventory").withColumn("created_at", F.lit(CREATED).cast("timestamp")) \
        .withColumn("updated_at", F.lit(CREATED).cast("timestamp"))
    out = U.stamp_changes(synced(spark, sf), old, KEYS, COMPARE, AS_OF)
    return out.select("Account", "SupplierSKU", "FreeStock",
                      F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
                      F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss").alias("updated_at"))


@register("i13_run_log_row", "I13/L4", with_fixtures(f"""
SELECT '{AS_OF}' AS timestamp, CAST(count(*) AS BIGINT) AS total_skus,
       CAST(sum(CASE WHEN l.FreeStock IS DISTINCT FROM p.FreeStock THEN 1 ELSE 0 END) AS BIGINT) AS changes_detected,
       '0.00 seconds' AS execution_time, 'compare_tables' AS action
FROM inventory_latest l LEFT JOIN inventory p ON l.SupplierSKU = p.SupplierSKU
""", "inventory", "inventory_latest"))
def i13(spark, sf):
    from ledgerline.operators.reconcile import snapshot_comparison
    latest, prev = _snapshots(spark, sf)
    summary = snapshot_comparison(latest, prev).agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("changed").cast("int")).alias("changed"))
    return U.run_log_row(summary, "compare_tables", "total", "changed", 0.0, AS_OF)
