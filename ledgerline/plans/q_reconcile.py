"""Registered queries: reconciliation (F0, F1, F1s, D5) and the two-sided
comparison family (F2, F2k, F2p, F2r, D4, D6, K1), change detection (F3, F4)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ledgerline.operators import digest as D
from ledgerline.operators import reconcile as R
from ledgerline.operators.quality import validate_mapping
from ledgerline.plans import duck
from ledgerline.plans.fixtures import fixture, with_fixtures
from ledgerline.plans.registry import in_order, register
from ledgerline.session import scratch_path

# ---------------------------------------------------------------------------
# F0 / F1 / F1s / D5


def hnau_norm(spark, sf):
    return R.normalise_hnau(fixture(spark, sf, "feed_h"))


def vs_norm(spark, sf):
    return R.normalise_vs(fixture(spark, sf, "feed_v"))


def reconciled(spark, sf):
    return R.reconcile(hnau_norm(spark, sf), vs_norm(spark, sf))


def _norm_ctes():
    return {**duck.hnau_ctes(), **duck.vs_ctes()}


_JOINED = """
SELECT coalesce(h.sku, v.sku) AS sku, h.qty AS hnau_qty, v.qty AS vs_qty,
       CAST(coalesce(v.qty, 0) - coalesce(h.qty, 0) AS BIGINT) AS qty_diff,
       h.supplier_id AS supplier_id, v.account AS account,
       CASE WHEN h.sku IS NULL THEN 'ONLY_IN_VS'
            WHEN v.sku IS NULL THEN 'ONLY_IN_HNAU'
            WHEN coalesce(h.qty, 0) = coalesce(v.qty, 0) THEN 'MATCH'
            ELSE 'QTY_MISMATCH' END AS status
FROM h_norm h FULL OUTER JOIN v_norm v ON h.sku = v.sku
"""


def _joined_sql(select: str) -> str:
    return with_fixtures(select, "feed_h", "feed_v", extra={**_norm_ctes(), "joined": _JOINED})


register("f0_normalise_hnau", "F0", with_fixtures(
    "SELECT sku, qty, supplier_id FROM h_norm", "feed_h", extra=duck.hnau_ctes()))(hnau_norm)
register("f0_normalise_vs", "F0", with_fixtures(
    "SELECT sku, qty, account FROM v_norm", "feed_v", extra=duck.vs_ctes()))(vs_norm)


# ---- F0 with quantities beyond a bigint: every 40th row, and SKUs whose sum is too large

_BIG_QTY = """SELECT account, supplier_sku, CASE WHEN row_id % 40 = 3 THEN concat('9', cast(row_id AS {t}), '0000000000000000000')
  WHEN supplier_sku LIKE '%77' THEN '9000000000000000000' WHEN row_id % 40 = 5 THEN concat('(', cast(row_id AS {t}), '00000000000000000000)')
  ELSE free_stock END AS free_stock FROM {v}"""
_BIG_EXACT = ("CASE WHEN {s} LIKE '(%' THEN -CAST(TRY_CAST(trim({s}, '()') AS DECIMAL(38,0)) AS DECIMAL(38,0)) "
              "ELSE coalesce(TRY_CAST({s} AS DECIMAL(38,0)), 0) END").format(s="free_stock")
_BIG_CTES = {"big": _BIG_QTY.format(t="VARCHAR", v="feed_v"), "big_sku": (
    f"SELECT {duck.clean_sku('supplier_sku')} AS sku, sum({_BIG_EXACT}) AS qty, count(*) AS n_rows, "
    f"max(abs({_BIG_EXACT})) AS most, min({duck.strip('account')}) AS account FROM big GROUP BY 1")}
_FITS = "most < 9223372036854775808 AND abs(qty) < 9223372036854775808"


def _big_feed(spark, sf):
    return spark.sql(_BIG_QTY.format(t="string", v="{v}"), v=fixture(spark, sf, "feed_v"))


@register("f0_large_quantities", "F0/C2", with_fixtures(
    f"SELECT sku, CAST(qty AS BIGINT) AS qty, account FROM big_sku WHERE {_FITS}", "feed_v", extra=_BIG_CTES))
def f0_large(spark, sf):
    return R.normalise_vs(_big_feed(spark, sf))


@register("f0_rejected_quantities", "F0/C2", with_fixtures(
    f"SELECT sku, CAST(qty AS DECIMAL(38,0)) AS qty, n_rows, account FROM big_sku WHERE NOT ({_FITS})", "feed_v", extra=_BIG_CTES))
def f0_rejected(spark, sf):
    return R.rejected_quantities(_big_feed(spark, sf), "supplier_sku", "free_stock", "account", "account")


register("f1_reconcile", "F1", _joined_sql("SELECT * FROM joined"))(reconciled)


@register("f1s_reconcile_stats", "F1s", _joined_sql("""
SELECT CAST(sum(CASE WHEN status <> 'ONLY_IN_VS' THEN 1 ELSE 0 END) AS BIGINT) AS hnau_rows,
       CAST(sum(CASE WHEN status <> 'ONLY_IN_HNAU' THEN 1 ELSE 0 END) AS BIGINT) AS vs_rows,
       CAST(sum(CASE WHEN status = 'MATCH' THEN 1 ELSE 0 END) AS BIGINT) AS matches,
       CAST(sum(CASE WHEN status = 'QTY_MISMATCH' THEN 1 ELSE 0 END) AS BIGINT) AS qty_mismatches,
       CAST(sum(CASE WHEN status = 'ONLY_IN_HNAU' THEN 1 ELSE 0 END) AS BIGINT) AS only_in_hnau,
       CAST(sum(CASE WHEN status = 'ONLY_IN_VS' THEN 1 ELSE 0 END) AS BIGINT) AS only_in_vs,
       CAST(sum(coalesce(hnau_qty, 0)) AS BIGINT) AS total_hnau_qty,
       CAST(sum(coalesce(vs_qty, 0)) AS BIGINT) AS total_vs_qty,
       CAST(sum(CASE WHEN status = 'QTY_MISMATCH' THEN abs(qty_diff) ELSE 0 END) AS BIGINT) AS sum_abs_qty_diff,
       round(avg(CASE WHEN status = 'QTY_MISMATCH' THEN abs(qty_diff) END), 4) AS avg_abs_qty_diff,
       CAST(sum(CASE WHEN coalesce(hnau_qty, 0) > 0 AND coalesce(vs_qty, 0) <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS hnau_in_vs_out,
       CAST(sum(CASE WHEN coalesce(vs_qty, 0) > 0 AND coalesce(hnau_qty, 0) <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS vs_in_hnau_out
FROM joined
"""))
def f1s(spark, sf):
    return R.reconcile_stats(reconciled(spark, sf))


_D5_WHERE = {
    "mismatch": "status = 'QTY_MISMATCH'",
    "only_hnau": "status = 'ONLY_IN_HNAU'",
    "only_vs": "status = 'ONLY_IN_VS'",
    "hnau_in_vs_out": "coalesce(hnau_qty, 0) > 0 AND coalesce(vs_qty, 0) <= 0",
    "vs_in_hnau_out": "coalesce(vs_qty, 0) > 0 AND coalesce(hnau_qty, 0) <= 0",
}


def _d5(name):
    def build(spark, sf):
        return in_order(R.reconcile_subset(reconciled(spark, sf), name))
    return build


for _n, _w in _D5_WHERE.items():
    _o = "abs(qty_diff) DESC, sku" if _n == "mismatch" else "sku NULLS FIRST"
    register(f"d5_{_n}", "D5/H3", _joined_sql(
        f"SELECT *, row_number() OVER (ORDER BY {_o}) AS position FROM joined WHERE {_w}"))(_d5(_n))

# ---------------------------------------------------------------------------
# F2 family over stock_wh (warehouse) and stock_ecom (e-commerce)

_ORDER = ["row_id", "sku", "account", "qty"]


def stock_sides(spark, sf, clamp=False):
    a = R.normalise_stock(fixture(spark, sf, "stock_wh"), "sku", "account", "qty",
                          clamp=clamp, order_cols=_ORDER)
    b = R.normalise_stock(fixture(spark, sf, "stock_ecom"), "sku", "account", "qty",
                          clamp=clamp, order_cols=_ORDER)
    return a, b


def compared(spark, sf, agg="sum", clamp=False):
    a, b = stock_sides(spark, sf, clamp)
    return R.compare_sides(a, b, agg)


def _duck_norm(src: str, clamp: bool) -> str:
    q = "TRY_CAST(qty AS DOUBLE)"
    if clamp:
        q = f"CASE WHEN {q} < 0 THEN 0 ELSE {q} END"
    return (f"SELECT upper({duck.strip('CAST(sku AS VARCHAR)')}) AS sku_key, "
            f"upper({duck.strip('CAST(account AS VARCHAR)')}) AS account_key, "
            f"{q} AS qty, row_id, sku, account, qty AS qty_raw FROM {src} "
            f"WHERE sku IS NOT NULL AND account IS NOT NULL")


def _duck_agg(agg: str) -> str:
    order = "row_id ASC NULLS FIRST, sku ASC NULLS FIRST, account ASC NULLS FIRST, qty_raw ASC NULLS FIRST"
    if agg == "max":
        return "max(qty)"
    if agg == "min":
        return "min(qty)"
    if agg == "first":
        return f"first(qty ORDER BY {order}) FILTER (WHERE qty IS NOT NULL)"
    if agg == "last":
        order_desc = order.replace("ASC NULLS FIRST", "DESC NULLS LAST")
        return f"first(qty ORDER BY {order_desc}) FILTER (WHERE qty IS NOT NULL)"
    return "coalesce(sum(qty), 0.0)"


def _merged_ctes(agg: str = "sum", clamp: bool = False) -> dict[str, str]:
    return {
        "a0": _duck_norm("stock_wh", clamp),
        "b0": _duck_norm("stock_ecom", clamp),
        "a1": f"SELECT sku_key, account_key, {_duck_agg(agg)} AS qty_wh FROM a0 GROUP BY ALL",
        "b1": f"SELECT sku_key, account_key, {_duck_agg(agg)} AS qty_ecom FROM b0 GROUP BY ALL",
        "m0": """
SELECT coalesce(a1.sku_key, b1.sku_key) AS sku_key,
       coalesce(a1.account_key, b1.account_key) AS account_key,
       coalesce(qty_wh, 0.0) AS qty_wh, coalesce(qty_ecom, 0.0) AS qty_ecom,
       qty_wh IS NOT NULL AS present_wh, qty_ecom IS NOT NULL AS present_ecom
FROM a1 FULL OUTER JOIN b1 ON a1.sku_key = b1.sku_key AND a1.account_key = b1.account_key
""",
        "merged": """
SELECT sku_key, account_key, qty_wh, qty_ecom, present_wh, present_ecom,
       qty_wh - qty_ecom AS qty_diff,
       CASE WHEN qty_wh - qty_ecom = 0 THEN 'Match' ELSE 'Mismatch' END AS status,
       CASE WHEN present_wh AND present_ecom THEN 'Both'
            WHEN present_wh THEN 'Warehouse Only'
            WHEN present_ecom THEN 'E-Commerce Only' ELSE '—' END AS source_status,
       qty_wh > 0 AS in_stock_wh, qty_ecom > 0 AS in_stock_ecom
FROM m0
""",
    }


def _merged_sql(select: str, agg: str = "sum", clamp: bool = False) -> str:
    return with_fixtures(select, "stock_wh", "stock_ecom", extra=_merged_ctes(agg, clamp))


_F2_COLS = ("sku_key, account_key, round(qty_wh, 4) AS qty_wh, round(qty_ecom, 4) AS qty_ecom, "
            "present_wh, present_ecom, round(qty_diff, 4) AS qty_diff, status, source_status, "
            "in_stock_wh, in_stock_ecom")


def _round_f2(df):
    return df.select(
        "sku_key", "account_key", F.round("qty_wh", 4).alias("qty_wh"),
        F.round("qty_ecom", 4).alias("qty_ecom"), "present_wh", "present_ecom",
        F.round("qty_diff", 4).alias("qty_diff"), "status", "source_status",
        "in_stock_wh", "in_stock_ecom")


def _f2(agg):
    def build(spark, sf):
        return _round_f2(compared(spark, sf, agg))
    return build


for _agg in R.AGGREGATORS:
    register(f"f2_compare_{_agg}", "F2", _merged_sql(f"SELECT {_F2_COLS} FROM merged", _agg))(_f2(_agg))


@register("f2_compare_clamped", "F2/C4", _merged_sql(f"SELECT {_F2_COLS} FROM merged", "sum", True))
def f2_clamped(spark, sf):
    return _round_f2(compared(spark, sf, "sum", clamp=True))


@register("f2k_compare_kpis", "F2k", _merged_sql("""
SELECT CAST(count(*) AS BIGINT) AS total_rows,
       CAST(sum(CASE WHEN status = 'Match' THEN 1 ELSE 0 END) AS BIGINT) AS matched,
       CAST(sum(CASE WHEN status = 'Mismatch' THEN 1 ELSE 0 END) AS BIGINT) AS mismatched,
       CAST(sum(CASE WHEN source_status = 'Both' THEN 1 ELSE 0 END) AS BIGINT) AS both,
       CAST(sum(CASE WHEN source_status = 'Warehouse Only' THEN 1 ELSE 0 END) AS BIGINT) AS wh_only,
       CAST(sum(CASE WHEN source_status = 'E-Commerce Only' THEN 1 ELSE 0 END) AS BIGINT) AS ecom_only,
       CAST(sum(CASE WHEN in_stock_wh AND NOT in_stock_ecom THEN 1 ELSE 0 END) AS BIGINT) AS instock_wh_oos_ecom,
       CAST(sum(CASE WHEN in_stock_ecom AND NOT in_stock_wh THEN 1 ELSE 0 END) AS BIGINT) AS instock_ecom_oos_wh,
       round(coalesce(sum(qty_wh), 0.0), 4) AS qty_wh_total,
       round(coalesce(sum(qty_ecom), 0.0), 4) AS qty_ecom_total,
       round(coalesce(sum(abs(qty_diff)), 0.0), 4) AS abs_diff_total
FROM merged
"""))
def f2k(spark, sf):
    k = R.compare_kpis(compared(spark, sf))
    return k.select(*[F.round(c, 4).alias(c) if c.endswith("_total") else c for c in k.columns])


def _f2p(column):
    def build(spark, sf):
        return R.value_counts(compared(spark, sf), column)
    return build


for _col in ("status", "source_status"):
    register(f"f2p_counts_{_col}", "F2p", _merged_sql(
        f"SELECT {_col} AS value, CAST(count(*) AS BIGINT) AS n FROM merged GROUP BY {_col}"))(_f2p(_col))


@register("f2r_rollup_by_account", "F2r", _merged_sql("""
SELECT account_key, CAST(count(DISTINCT sku_key) AS BIGINT) AS total_items,
       CAST(sum(CASE WHEN status = 'Match' THEN 1 ELSE 0 END) AS BIGINT) AS matched,
       CAST(sum(CASE WHEN status = 'Mismatch' THEN 1 ELSE 0 END) AS BIGINT) AS mismatched,
       CAST(sum(CASE WHEN source_status = 'Warehouse Only' THEN 1 ELSE 0 END) AS BIGINT) AS wh_only,
       CAST(sum(CASE WHEN source_status = 'E-Commerce Only' THEN 1 ELSE 0 END) AS BIGINT) AS ecom_only,
       round(sum(qty_wh), 4) AS qty_wh_total, round(sum(qty_ecom), 4) AS qty_ecom_total,
       round(sum(abs(qty_diff)), 4) AS abs_diff_total,
       CAST(sum(CASE WHEN in_stock_wh AND NOT in_stock_ecom THEN 1 ELSE 0 END) AS BIGINT) AS instock_wh_oos_ecom,
       CAST(sum(CASE WHEN in_stock_ecom AND NOT in_stock_wh THEN 1 ELSE 0 END) AS BIGINT) AS instock_ecom_oos_wh
FROM merged GROUP BY account_key
"""))
def f2r(spark, sf):
    r = R.rollup_by_account(compared(spark, sf))
    return r.select(*[F.round(c, 4).alias(c) if c.endswith("_total") else c for c in r.columns])


@register("d4_filter_comparison", "D4", _merged_sql(
    f"SELECT {_F2_COLS} FROM merged WHERE status IN ('Mismatch') "
    "AND source_status IN ('Both', 'Warehouse Only') AND (qty_wh > 0 OR qty_ecom > 0)"))
def d4(spark, sf):
    return _round_f2(R.filter_comparison(compared(spark, sf), ["Mismatch"],
                                         ["Both", "Warehouse Only"], any_qty_positive=True))


_D6_WHERE = {
    "mismatch": "status = 'Mismatch'",
    "instock_wh_oos_ecom": "in_stock_wh AND NOT in_stock_ecom",
    "instock_ecom_oos_wh": "in_stock_ecom AND NOT in_stock_wh",
}


def _d6(name):
    def build(spark, sf):
        return _round_f2(R.comparison_subset(compared(spark, sf), name))
    return build


for _n, _w in _D6_WHERE.items():
    register(f"d6_{_n}", "D6", _merged_sql(f"SELECT {_F2_COLS} FROM merged WHERE {_w}"))(_d6(_n))


# ---------------------------------------------------------------------------
# K1: mapping check per side


@register("k1_validate_mapping", "K1", with_fixtures("""
SELECT 'warehouse' AS side, * FROM (
  SELECT CAST(sum(CASE WHEN sku IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_sku,
         CAST(sum(CASE WHEN account IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_account,
         CAST(sum(CASE WHEN TRY_CAST(qty AS DOUBLE) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS bad_qty,
         CAST(sum(CASE WHEN TRY_CAST(qty AS DOUBLE) < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_qty
  FROM stock_wh) x,
 (SELECT CAST(count(*) AS BIGINT) AS dup_key_groups FROM (
    SELECT 1 FROM stock_wh
    GROUP BY coalesce(upper(regexp_replace(CAST(sku AS VARCHAR), '^\\s+|\\s+$', '', 'g')), ''),
             coalesce(upper(regexp_replace(CAST(account AS VARCHAR), '^\\s+|\\s+$', '', 'g')), '')
    HAVING count(*) > 1)) d
UNION ALL
SELECT 'ecommerce' AS side, * FROM (
  SELECT CAST(sum(CASE WHEN sku IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_sku,
         CAST(sum(CASE WHEN account IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS null_account,
         CAST(sum(CASE WHEN TRY_CAST(qty AS DOUBLE) IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS bad_qty,
         CAST(sum(CASE WHEN TRY_CAST(qty AS DOUBLE) < 0 THEN 1 ELSE 0 END) AS BIGINT) AS negative_qty
  FROM stock_ecom) x,
 (SELECT CAST(count(*) AS BIGINT) AS dup_key_groups FROM (
    SELECT 1 FROM stock_ecom
    GROUP BY coalesce(upper(regexp_replace(CAST(sku AS VARCHAR), '^\\s+|\\s+$', '', 'g')), ''),
             coalesce(upper(regexp_replace(CAST(account AS VARCHAR), '^\\s+|\\s+$', '', 'g')), '')
    HAVING count(*) > 1)) d
""", "stock_wh", "stock_ecom"))
def k1(spark, sf):
    wh = validate_mapping(fixture(spark, sf, "stock_wh"), "sku", "account", "qty")
    ec = validate_mapping(fixture(spark, sf, "stock_ecom"), "sku", "account", "qty")
    return (wh.select(F.lit("warehouse").alias("side"), "*")
            .unionByName(ec.select(F.lit("ecommerce").alias("side"), "*")))


# ---------------------------------------------------------------------------
# Changed SKUs between inventory (previous) and inventory_latest


def changes(spark, sf, null_as_zero=False):
    return R.changed_skus(fixture(spark, sf, "inventory_latest"), fixture(spark, sf, "inventory"),
                          null_as_zero=null_as_zero)


_CHANGES_BASE = """
SELECT l.SupplierSKU AS sku, l.Account AS Account, l.FreeStock AS latest_qty, p.FreeStock AS previous_qty
FROM inventory_latest l LEFT JOIN inventory p ON l.SupplierSKU = p.SupplierSKU
"""

register("f3_changed_null_safe", "F3", with_fixtures(
    _CHANGES_BASE + " WHERE l.FreeStock IS DISTINCT FROM p.FreeStock",
    "inventory", "inventory_latest"))(lambda spark, sf: changes(spark, sf, False))
register("f4_changed_null_zero", "F4", with_fixtures(
    _CHANGES_BASE + " WHERE coalesce(l.FreeStock, 0) <> coalesce(p.FreeStock, 0)",
    "inventory", "inventory_latest"))(lambda spark, sf: changes(spark, sf, True))


# ---- F3 on stored snapshots: only the leaves that differ are read


def changes_by_digest(spark, sf, latest, previous):
    run = scratch_path(spark, f"snapshots/{uuid.uuid4().hex}")
    paths = [D.write_snapshot(rows, f"{run}/{name}", leaf_rows=1500) for name, rows in (("latest", latest), ("previous", previous))]
    return D.changed_since(spark, *paths)


register("f3_changed_by_digest", "F3", with_fixtures(
    _CHANGES_BASE + " WHERE l.FreeStock IS DISTINCT FROM p.FreeStock", "inventory", "inventory_latest"))(
    lambda spark, sf: changes_by_digest(spark, sf, fixture(spark, sf, "inventory_latest"), fixture(spark, sf, "inventory")))


@register("f3_few_changed_by_digest", "F3", with_fixtures("""
SELECT SupplierSKU AS sku, Account, FreeStock AS latest_qty, FreeStock - 1 AS previous_qty
FROM inventory_latest WHERE SupplierSKU LIKE '%77' AND FreeStock IS NOT NULL""", "inventory_latest"))
def f3_few(spark, sf):
    latest = fixture(spark, sf, "inventory_latest")
    fewer = F.when(F.col("SupplierSKU").endswith("77"), F.col("FreeStock") - 1).otherwise(F.col("FreeStock"))
    return changes_by_digest(spark, sf, latest, latest.withColumn("FreeStock", fewer))
