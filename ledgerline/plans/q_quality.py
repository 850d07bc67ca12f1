"""Registered queries: data-quality audits (K2-K6, K8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import quality as Q
from ledgerline.plans.fixtures import fixture, with_fixtures
from ledgerline.plans.q_catalog import _EAV, eav
from ledgerline.plans.registry import register
from ledgerline.session import table

_NN = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]


@register("k2_not_null_audit", "K2", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, CAST(count(*) - count({c}) AS BIGINT) AS nulls FROM orders" for c in _NN))
def k2(spark, sf):
    return Q.not_null_audit(table(spark, sf, "orders"), _NN)


@register("k3_unique_audit", "K3", """
SELECT l_orderkey, l_linenumber, CAST(count(*) AS BIGINT) AS n FROM lineitem
WHERE l_orderkey IS NOT NULL AND l_linenumber IS NOT NULL
GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1""")
def k3(spark, sf):
    return Q.unique_violations(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@register("k3_primary_key_audit", "K3", with_fixtures("""
SELECT SupplierSKU, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM inventory UNION ALL SELECT * FROM inventory_latest)
GROUP BY SupplierSKU HAVING count(*) > 1""", "inventory", "inventory_latest"))
def k3pk(spark, sf):
    both = fixture(spark, sf, "inventory").unionByName(fixture(spark, sf, "inventory_latest"))
    return Q.unique_violations(both, ["SupplierSKU"], primary_key=True)


# CHECK rules on lineitem (name -> SQL boolean), fixed values of this audit.
RULES = {
    "quantity_positive": "l_quantity > 0",
    "discount_range": "l_discount BETWEEN 0 AND 0.1",
    "tax_range": "l_tax BETWEEN 0 AND 0.08",
    "returnflag_enum": "l_returnflag IN ('R', 'A', 'N')",
    "linestatus_enum": "l_linestatus IN ('O', 'F')",
    "price_non_negative": "l_extendedprice >= 0",
}


@register("k4_check_audit", "K4", " UNION ALL ".join(
    f"SELECT '{k}' AS rule, CAST(sum(CASE WHEN coalesce({v}, true) THEN 0 ELSE 1 END) AS BIGINT) AS violations "
    f"FROM lineitem" for k, v in RULES.items()))
def k4(spark, sf):
    return Q.check_violations(table(spark, sf, "lineitem"), RULES)


def eav_with_conflicts(spark, sf):
    """Typed EAV rows, plus a second typed value on every 9th size row."""
    e = eav(spark, sf)
    return e.withColumn("value_text", F.when((F.col("attribute_code") == "size")
                                             & (F.col("value_int") % 9 == 0), F.lit("x"))
                        .otherwise(F.col("value_text")))


@register("k5_exactly_one_value", "K5", with_fixtures("""
SELECT * FROM (SELECT part_number, attribute_code,
                      CASE WHEN attribute_code = 'size' AND value_int % 9 = 0 THEN 'x' ELSE value_text END AS value_text,
                      value_int, value_decimal FROM eav)
WHERE (CASE WHEN value_text IS NULL THEN 0 ELSE 1 END) + (CASE WHEN value_int IS NULL THEN 0 ELSE 1 END)
    + (CASE WHEN value_decimal IS NULL THEN 0 ELSE 1 END) <> 1""", "products", extra={"eav": _EAV}))
def k5(spark, sf):
    return Q.exactly_one_violations(eav_with_conflicts(spark, sf), ["value_text", "value_int", "value_decimal"])


@register("k6_orphan_lineitems", "K6", "SELECT * FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN "
          "(SELECT p_partkey FROM part WHERE p_partkey IS NOT NULL)")
def k6(spark, sf):
    return Q.orphan_rows(table(spark, sf, "lineitem"), table(spark, sf, "part"), "l_partkey", "p_partkey")


@register("k6_orphan_orders", "K6", "SELECT * FROM orders WHERE o_custkey IS NOT NULL AND o_custkey NOT IN "
          "(SELECT c_custkey FROM customer WHERE c_custkey IS NOT NULL)")
def k6o(spark, sf):
    return Q.orphan_rows(table(spark, sf, "orders"), table(spark, sf, "customer"), "o_custkey", "c_custkey")


@register("k6_orphans_of_open_orders", "K6", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN "
          "(SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def k6_open(spark, sf):
    """Line items whose order is not among the unfinished ones: orphans there are."""
    parents = table(spark, sf, "orders").where("o_orderstatus <> 'F'")
    return Q.orphan_rows(table(spark, sf, "lineitem"), parents, "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


_RUN_COLS = ["source", "hnau_file", "vs_file", "hnau_mtime", "vs_mtime"]


def run_keys(spark, sf):
    """Ingestion run keys derived from events: one per (type, user bucket, day)."""
    e = table(spark, sf, "events")
    return e.select(F.col("event_type").alias("source"),
                    F.when(F.col("user_id") % 7 == 0, F.lit(None))
                    .otherwise(F.concat(F.lit("h"), (F.col("user_id") % 10).cast("string"))).alias("hnau_file"),
                    F.concat(F.lit("v"), (F.col("user_id") % 4).cast("string")).alias("vs_file"),
                    F.when(F.col("user_id") % 5 == 0, F.lit(None))
                    .otherwise(F.dayofmonth("ts").cast("bigint")).alias("hnau_mtime"),
                    F.lit(None).cast("bigint").alias("vs_mtime"),
                    (F.col("user_id") % 3 == 0).alias("_done"))


_RUNS_SQL = """
SELECT event_type AS source, CASE WHEN user_id % 7 = 0 THEN NULL ELSE concat('h', CAST(user_id % 10 AS VARCHAR)) END AS hnau_file,
       concat('v', CAST(user_id % 4 AS VARCHAR)) AS vs_file,
       CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(dayofmonth(ts) AS BIGINT) END AS hnau_mtime,
       CAST(NULL AS BIGINT) AS vs_mtime, user_id % 3 = 0 AS done FROM events"""


@register("k8_unseen_runs", "K8/L2", with_fixtures("""
SELECT DISTINCT source, hnau_file, vs_file, hnau_mtime, vs_mtime FROM runs r
WHERE NOT EXISTS (SELECT 1 FROM runs l WHERE l.done
  AND l.source = r.source AND coalesce(l.hnau_file, '') = coalesce(r.hnau_file, '')
  AND coalesce(l.vs_file, '') = coalesce(r.vs_file, '') AND coalesce(l.hnau_mtime, 0) = coalesce(r.hnau_mtime, 0)
  AND coalesce(l.vs_mtime, 0) = coalesce(r.vs_mtime, 0))""", extra={"runs": _RUNS_SQL}))
def k8(spark, sf):
    runs = run_keys(spark, sf)
    ledger = runs.where("_done").drop("_done")
    return Q.unseen_runs(runs.drop("_done"), ledger, _RUN_COLS)
