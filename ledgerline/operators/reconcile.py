"""Stock reconciliation between two systems.

Plan shape: each side is normalised and aggregated by its key (partial +
final aggregation, so a hot SKU is combined map-side before the shuffle),
then the two aggregated sides are full-outer-joined on that same key. Both
aggregates are already hash-partitioned and sorted on the key, so the
sort-merge join adds no extra exchange or sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import (
    clamp_negative,
    clean_sku,
    normalise_key,
    parse_qty,
    parse_qty_long,
    strip_ws,
    to_double,
)

# Reconciliation status labels, fixed values.
MATCH = "MATCH"
QTY_MISMATCH = "QTY_MISMATCH"
ONLY_IN_HNAU = "ONLY_IN_HNAU"
ONLY_IN_VS = "ONLY_IN_VS"


def _feed_rows(feed: DataFrame, sku_col: str, qty: Column, attr_col: str, attr_name: str) -> DataFrame:
    rows = feed.select(clean_sku(sku_col).alias("sku"), qty.alias("qty"), strip_ws(F.col(attr_col).cast("string")).alias(attr_name))
    return rows.where(F.col("sku").isNotNull())


def normalise_feed(feed: DataFrame, sku_col: str, qty_col: str, attr_col: str,
                   attr_name: str) -> DataFrame:
    """clean SKU, parse quantity, strip the attribute column, drop null
    SKUs, then one row per SKU with ``sum(qty)`` and ``min(attr)``. A SKU of
    which a quantity or the sum is beyond a bigint is not here but in
    ``rejected_quantities``."""
    rows = _feed_rows(feed, sku_col, parse_qty_long(qty_col), attr_col, attr_name)
    totals = rows.groupBy("sku").agg(F.try_sum("qty").alias("qty"), F.min(attr_name).alias(attr_name),
                                     F.count_if(F.col("qty").isNull()).alias("_beyond"))
    return totals.where((F.col("_beyond") == 0) & F.col("qty").isNotNull()).drop("_beyond")


def rejected_quantities(feed: DataFrame, sku_col: str, qty_col: str, attr_col: str, attr_name: str) -> DataFrame:
    """(sku, qty, n_rows, attr) of the SKUs that ``normalise_feed`` leaves
    out: the exact sum as decimal(38,0), null beyond 38 digits."""
    rows = _feed_rows(feed, sku_col, parse_qty(qty_col), attr_col, attr_name)
    totals = rows.groupBy("sku").agg(
        F.when(F.count_if(F.col("qty").isNull()) == 0, F.try_sum("qty")).cast("decimal(38,0)").alias("qty"),
        F.count("*").alias("n_rows"), F.min(attr_name).alias(attr_name),
        F.count_if(F.col("qty").try_cast("bigint").isNull()).alias("_beyond"))
    return totals.where((F.col("_beyond") > 0) | F.col("qty").try_cast("bigint").isNull()).drop("_beyond")


def normalise_hnau(feed: DataFrame) -> DataFrame:
    return normalise_feed(feed, "sku_oms_details_sku", "online_salable_qty_quantity",
                          "sku_oms_details_sap_supplier_id", "supplier_id")


def normalise_vs(feed: DataFrame) -> DataFrame:
    return normalise_feed(feed, "supplier_sku", "free_stock", "account", "account")


def reconcile(h_norm: DataFrame, v_norm: DataFrame) -> DataFrame:
    """full outer join of two normalised feeds on the SKU.

    Presence is decided by the key (marker columns), not by the quantity."""
    h = h_norm.select("sku", F.col("qty").alias("hnau_qty"), "supplier_id",
                      F.lit(True).alias("_in_h"))
    v = v_norm.select("sku", F.col("qty").alias("vs_qty"), "account",
                      F.lit(True).alias("_in_v"))
    j = h.join(v, on="sku", how="full")
    hq = F.coalesce(F.col("hnau_qty"), F.lit(0))
    vq = F.coalesce(F.col("vs_qty"), F.lit(0))
    status = (
        F.when(F.col("_in_h").isNull(), F.lit(ONLY_IN_VS))
        .when(F.col("_in_v").isNull(), F.lit(ONLY_IN_HNAU))
        .when(hq == vq, F.lit(MATCH))
        .otherwise(F.lit(QTY_MISMATCH))
    )
    return j.select(
        "sku",
        F.col("hnau_qty").cast("bigint").alias("hnau_qty"),
        F.col("vs_qty").cast("bigint").alias("vs_qty"),
        (vq - hq).cast("bigint").alias("qty_diff"),
        "supplier_id",
        "account",
        status.alias("status"),
    )


def _cnt(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def reconcile_stats(joined: DataFrame) -> DataFrame:
    """F1s: twelve measures in one row from the F1 result (one pass).

    Row counts of both sides come from key presence, so no extra scan."""
    st = F.col("status")
    hq = F.coalesce(F.col("hnau_qty"), F.lit(0))
    vq = F.coalesce(F.col("vs_qty"), F.lit(0))
    absd = F.abs(F.col("qty_diff"))
    return joined.agg(
        _cnt(st != ONLY_IN_VS).alias("hnau_rows"),
        _cnt(st != ONLY_IN_HNAU).alias("vs_rows"),
        _cnt(st == MATCH).alias("matches"),
        _cnt(st == QTY_MISMATCH).alias("qty_mismatches"),
        _cnt(st == ONLY_IN_HNAU).alias("only_in_hnau"),
        _cnt(st == ONLY_IN_VS).alias("only_in_vs"),
        F.sum(hq).cast("bigint").alias("total_hnau_qty"),
        F.sum(vq).cast("bigint").alias("total_vs_qty"),
        F.sum(F.when(st == QTY_MISMATCH, absd).otherwise(0)).cast("bigint").alias("sum_abs_qty_diff"),
        F.round(F.avg(F.when(st == QTY_MISMATCH, absd)), 4).alias("avg_abs_qty_diff"),
        _cnt((hq > 0) & (vq <= 0)).alias("hnau_in_vs_out"),
        _cnt((vq > 0) & (hq <= 0)).alias("vs_in_hnau_out"),
    )


# The five report subsets of a reconciliation, as predicates.
def _hq() -> Column:
    return F.coalesce(F.col("hnau_qty"), F.lit(0))


def _vq() -> Column:
    return F.coalesce(F.col("vs_qty"), F.lit(0))


RECONCILE_SUBSETS = {
    "mismatch": lambda: F.col("status") == QTY_MISMATCH,
    "only_hnau": lambda: F.col("status") == ONLY_IN_HNAU,
    "only_vs": lambda: F.col("status") == ONLY_IN_VS,
    "hnau_in_vs_out": lambda: (_hq() > 0) & (_vq() <= 0),
    "vs_in_hnau_out": lambda: (_vq() > 0) & (_hq() <= 0),
}


def reconcile_subset(joined: DataFrame, name: str) -> DataFrame:
    """D5 (+H3 ordering): one of the five report subsets, sorted as reported."""
    out = joined.where(RECONCILE_SUBSETS[name]())
    if name == "mismatch":
        return out.orderBy(F.abs(F.col("qty_diff")).desc(), F.col("sku").asc())
    return out.orderBy("sku")


# ---------------------------------------------------------------------------
# two-sided comparison with duplicate aggregation (sku, account) roles.

AGGREGATORS = ("sum", "max", "min", "first", "last")


def normalise_stock(df: DataFrame, sku: str, account: str, qty: str, *,
                    upper_keys: bool = True, strip_keys: bool = True,
                    clamp: bool = False, order_cols: list[str] | None = None) -> DataFrame:
    """Keys normalised to text, quantity coerced (and clamped).

    ``order_cols`` carries the row order used by first/last aggregation."""
    q = to_double(F.col(qty))
    if clamp:
        q = clamp_negative(q)
    order_cols = order_cols or []
    order = F.struct(*[F.col(c) for c in order_cols]) if order_cols else F.lit(None)
    return (
        df.select(
            normalise_key(sku, strip_keys, upper_keys).alias("sku_key"),
            normalise_key(account, strip_keys, upper_keys).alias("account_key"),
            q.alias("qty"),
            order.alias("_ord"),
        )
        .where(F.col("sku_key").isNotNull() & F.col("account_key").isNotNull())
    )


def _dup_agg(aggfunc: str) -> Column:
    q = F.col("qty")
    if aggfunc == "max":
        return F.max(q)
    if aggfunc == "min":
        return F.min(q)
    if aggfunc == "first":
        # H2: first non-null in row order; rows with null qty do not compete
        return F.min_by(q, F.when(q.isNotNull(), F.col("_ord")))
    if aggfunc == "last":
        return F.max_by(q, F.when(q.isNotNull(), F.col("_ord")))
    # sum (also the fallback for unknown names): all-null sums to 0
    return F.coalesce(F.sum(q), F.lit(0.0))


def aggregate_duplicates(norm: DataFrame, aggfunc: str, name: str) -> DataFrame:
    """One row per (sku_key, account_key) with the chosen duplicate aggregate."""
    return norm.groupBy("sku_key", "account_key").agg(_dup_agg(aggfunc).alias(name))


def compare_sides(a_norm: DataFrame, b_norm: DataFrame, aggfunc: str = "sum") -> DataFrame:
    """outer comparison of warehouse (a) and e-commerce (b) stock.

    Presence comes from a non-null aggregated quantity; missing quantity
    counts as 0; Match iff the difference is 0."""
    a = aggregate_duplicates(a_norm, aggfunc, "qty_wh")
    b = aggregate_duplicates(b_norm, aggfunc, "qty_ecom")
    m = a.join(b, on=["sku_key", "account_key"], how="full")
    pw = F.col("qty_wh").isNotNull()
    pe = F.col("qty_ecom").isNotNull()
    qw = F.coalesce(F.col("qty_wh"), F.lit(0.0))
    qe = F.coalesce(F.col("qty_ecom"), F.lit(0.0))
    diff = qw - qe
    source_status = (
        F.when(pw & pe, F.lit("Both"))
        .when(pw, F.lit("Warehouse Only"))
        .when(pe, F.lit("E-Commerce Only"))
        .otherwise(F.lit("—"))
    )
    return m.select(
        "sku_key", "account_key",
        qw.alias("qty_wh"), qe.alias("qty_ecom"),
        pw.alias("present_wh"), pe.alias("present_ecom"),
        diff.alias("qty_diff"),
        F.when(diff == 0, F.lit("Match")).otherwise(F.lit("Mismatch")).alias("status"),
        source_status.alias("source_status"),
        (qw > 0).alias("in_stock_wh"),
        (qe > 0).alias("in_stock_ecom"),
    )


def compare_kpis(merged: DataFrame) -> DataFrame:
    """F2k: counts by status and presence, cross-stock counts, totals."""
    st, ss = F.col("status"), F.col("source_status")
    iw, ie = F.col("in_stock_wh"), F.col("in_stock_ecom")
    return merged.agg(
        F.count(F.lit(1)).alias("total_rows"),
        _cnt(st == "Match").alias("matched"),
        _cnt(st == "Mismatch").alias("mismatched"),
        _cnt(ss == "Both").alias("both"),
        _cnt(ss == "Warehouse Only").alias("wh_only"),
        _cnt(ss == "E-Commerce Only").alias("ecom_only"),
        _cnt(iw & ~ie).alias("instock_wh_oos_ecom"),
        _cnt(ie & ~iw).alias("instock_ecom_oos_wh"),
        F.coalesce(F.sum("qty_wh"), F.lit(0.0)).alias("qty_wh_total"),
        F.coalesce(F.sum("qty_ecom"), F.lit(0.0)).alias("qty_ecom_total"),
        F.coalesce(F.sum(F.abs("qty_diff")), F.lit(0.0)).alias("abs_diff_total"),
    )


def value_counts(merged: DataFrame, column: str) -> DataFrame:
    """F2p: value counts of one label column (for charts)."""
    return merged.groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def rollup_by_account(merged: DataFrame) -> DataFrame:
    """F2r: per-account roll-up. SKU is unique per account after the
    comparison, so distinct SKUs equal the row count (no distinct needed)."""
    st, ss = F.col("status"), F.col("source_status")
    iw, ie = F.col("in_stock_wh"), F.col("in_stock_ecom")
    return merged.groupBy("account_key").agg(
        F.count(F.lit(1)).alias("total_items"),
        _cnt(st == "Match").alias("matched"),
        _cnt(st == "Mismatch").alias("mismatched"),
        _cnt(ss == "Warehouse Only").alias("wh_only"),
        _cnt(ss == "E-Commerce Only").alias("ecom_only"),
        F.sum("qty_wh").alias("qty_wh_total"),
        F.sum("qty_ecom").alias("qty_ecom_total"),
        F.sum(F.abs("qty_diff")).alias("abs_diff_total"),
        _cnt(iw & ~ie).alias("instock_wh_oos_ecom"),
        _cnt(ie & ~iw).alias("instock_ecom_oos_wh"),
    )


def filter_comparison(merged: DataFrame, statuses=None, presence=None,
                      any_qty_positive: bool = False) -> DataFrame:
    """Status IN, presence IN, optionally any quantity > 0. ``None``
    means no filter; an empty selection keeps no row."""
    out = merged
    if statuses is not None:
        out = out.where(F.col("status").isin(list(statuses))) if statuses else out.where(F.lit(False))
    if presence is not None:
        out = out.where(F.col("source_status").isin(list(presence))) if presence else out.where(F.lit(False))
    if any_qty_positive:
        out = out.where((F.col("qty_wh") > 0) | (F.col("qty_ecom") > 0))
    return out


COMPARISON_SUBSETS = {
    "mismatch": lambda: F.col("status") == "Mismatch",
    "instock_wh_oos_ecom": lambda: F.col("in_stock_wh") & ~F.col("in_stock_ecom"),
    "instock_ecom_oos_wh": lambda: F.col("in_stock_ecom") & ~F.col("in_stock_wh"),
}


def comparison_subset(merged: DataFrame, name: str) -> DataFrame:
    """Mismatch and cross-stock subsets of the comparison."""
    return merged.where(COMPARISON_SUBSETS[name]())


# ---------------------------------------------------------------------------
# Changed SKUs between a previous and a latest snapshot.

def snapshot_comparison(latest: DataFrame, previous: DataFrame, key: str = "SupplierSKU",
                        value: str = "FreeStock", null_as_zero: bool = False) -> DataFrame:
    """Every row of ``latest`` with its previous value and a ``changed`` flag
    (F3: null-safe; F4: null counts as 0). The key is a primary key of the
    snapshot tables; ``previous`` is still reduced to one row per key (its
    smallest value) before the join, so copies of a key never pair up."""
    prev = previous.groupBy(F.col(key).alias("_k")).agg(F.min(F.col(value)).alias("previous_qty"))
    j = latest.select(F.col(key).alias("sku"), F.col(value).alias("latest_qty"), "Account") \
        .join(prev, F.col("sku") == F.col("_k"), "left")
    if null_as_zero:
        changed = F.coalesce(F.col("latest_qty"), F.lit(0)) != F.coalesce(F.col("previous_qty"), F.lit(0))
    else:
        changed = ~F.col("latest_qty").eqNullSafe(F.col("previous_qty"))
    return j.select("sku", "Account", "latest_qty", "previous_qty", changed.alias("changed"))


def changed_skus(latest: DataFrame, previous: DataFrame, key: str = "SupplierSKU",
                 value: str = "FreeStock", null_as_zero: bool = False) -> DataFrame:
    """F3 (null-safe) / F4 (null = 0): SKUs of ``latest`` whose value differs
    from ``previous`` (left join; SKUs only in ``previous`` never reported)."""
    return snapshot_comparison(latest, previous, key, value, null_as_zero) \
        .where("changed").drop("changed")
