"""Invariants over the derived fixtures."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SMALL
from ledgerline.operators import diff as D
from ledgerline.operators import numbering as N
from ledgerline.operators import upsert as U
from ledgerline.plans import q_feed, q_reconcile
from ledgerline.plans.fixtures import fixture


def test_reconcile_status_counts_add_up(spark):
    j = q_reconcile.reconciled(spark, SMALL)
    s = q_reconcile.f1s(spark, SMALL).first()
    assert s.matches + s.qty_mismatches + s.only_in_hnau + s.only_in_vs == j.count()


def test_sync_then_diff_is_clean(spark):
    src, tgt = fixture(spark, SMALL, "inventory_latest"), fixture(spark, SMALL, "inventory")
    synced = D.sync_into(src, tgt, ["SupplierSKU"], ["SupplierSKU"], ["Account", "FreeStock"])
    d = D.keyed_diff(src, synced, ["SupplierSKU"], ["SupplierSKU"], ["Account", "FreeStock"])
    assert d.where(F.col("change").isin("added", "modified")).count() == 0


def test_feed_rows_are_changes_times_sources(spark):
    changes = q_reconcile.changes(spark, SMALL, True).count()
    assert q_feed.feed_rows(spark, SMALL, True).count() == changes * len(q_feed.SOURCES)


def test_insert_or_replace_is_idempotent(spark):
    tgt = fixture(spark, SMALL, "inventory")
    batch = fixture(spark, SMALL, "inventory_latest").where(F.col("SupplierSKU").isNotNull())
    once = U.insert_or_replace(tgt, batch, ["SupplierSKU"])
    twice = U.insert_or_replace(once, batch, ["SupplierSKU"])
    assert sorted(once.collect()) == sorted(twice.collect())


def test_global_numbering_matches_row_number(spark):
    df = spark.range(10000).select((F.col("id") * 7919 % 10007).alias("k"), (F.col("id") % 13).alias("v"))
    got = N.with_row_number(df, ["k", "v"], "rn").select("k", "v", "rn")
    want = df.select("k", "v", F.row_number().over(Window.orderBy("k", "v")).alias("rn"))
    assert sorted(got.collect()) == sorted(want.collect())


def test_duplicates_keep_identical_copies(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (1, "a", 1), (2, "a", 5), (3, None, 1)],
                               "row_id int, k string, v int")
    dups = D.duplicate_rows(df, ["k"], ["row_id"])
    # key "a": first is row 1 (one copy kept), two more copies of row 1 and row 2 are duplicates
    assert sorted(tuple(r) for r in dups.collect()) == [(1, "a", 1), (1, "a", 1), (2, "a", 5)]


def test_first_per_key_hot_key_plan_has_partial_aggregation(spark):
    df = fixture(spark, SMALL, "stock_wh")
    plan = D.first_per_key(df, ["sku"], ["row_id"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan


def test_pages(spark):
    from ledgerline.operators import catalog as C
    df = spark.range(3000).select((F.col("id") * 7 % 3001).alias("k"))
    values = sorted(r.k for r in df.collect())
    for page_no in (0, 5, 29, 40):
        got = sorted(r.k for r in C.page(df, ["k"], page_no, 100).collect())
        assert got == values[page_no * 100:page_no * 100 + 100]


def test_hot_key_results(spark):
    """A key holding a third of all rows: aggregation-based operators give
    the same result as a brute-force statement."""
    n = 30000
    df = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, F.lit("HOT")).otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string"))).alias("k"),
        F.col("id").alias("row_id"), (F.col("id") % 5).alias("v"))
    first = {r.k: (r.row_id, r.v) for r in D.first_per_key(df, ["k"], ["row_id"]).collect()}
    assert first["HOT"] == (0, 0)
    dups = D.duplicate_rows(df, ["k"], ["row_id"]).count()
    assert dups == n - df.select("k").distinct().count()
    up = U.insert_or_replace(df.where(F.lit(False)), df, ["k"], ["row_id"])
    hot = up.where(F.col("k") == "HOT").first()
    assert hot.row_id == max(i for i in range(n) if i % 3 == 0)


def test_null_keys_match_null_safely(spark):
    src = spark.createDataFrame([(None, 1), ("", 2), ("a", 3)], "k string, v int")
    tgt = spark.createDataFrame([(None, 1), ("", 5), ("b", 4)], "k string, v int")
    d = {(r.key, r.change): (r.v_src, r.v_tgt) for r in D.keyed_diff(src, tgt, ["k"], ["k"], ["v"]).collect()}
    # null matches null (same), '' matches '' (modified), a added, b removed
    assert d == {("", "modified"): (2, 5), ("a", "added"): (3, None), ("b", "removed"): (None, 4)}
    synced = sorted(D.sync_into(src, tgt, ["k"], ["k"], ["v"]).collect(), key=lambda r: (r.k is not None, r.k or ""))
    assert [(r.k, r.v) for r in synced] == [(None, 1), ("", 2), ("a", 3), ("b", 4)]


def test_numbering_spreads_identical_hot_rows(spark):
    # 30k identical rows plus a few distinct ones: numbering stays a permutation
    df = spark.range(30000).select(F.lit("HOT").alias("k")).union(spark.createDataFrame([("A",), ("Z",)], "k string"))
    out = N.with_row_number(df, ["k"], "rn")
    rows = out.collect()
    assert sorted(r.rn for r in rows) == list(range(1, 30003))
    by = {r.k: r.rn for r in rows if r.k != "HOT"}
    assert by == {"A": 1, "Z": 30002}
    # the hot value is spread over several range partitions (AQE would
    # coalesce this small shuffle into one partition, so switch that off here)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        hot = N.with_row_number(df, ["k"], "rn").where(F.col("k") == "HOT")
        parts = hot.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set(key, old)
    assert parts > 1


def test_insert_or_replace_semantics(spark):
    tgt = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), (None, 3, "z")], "k string, v int, note string")
    batch = spark.createDataFrame([(1, "a", 10), (2, "a", 11), (3, None, 12), (4, "c", 13)],
                                  "row_id int, k string, v int")
    out = sorted((r.k or "", r.v, r.note) for r in U.insert_or_replace(tgt, batch, ["k"], ["row_id"]).collect())
    # a: last batch row wins and replaces the whole row (note -> null); b untouched;
    # null keys never collide (target and batch rows both kept); c inserted
    assert out == [("", 3, "z"), ("", 12, None), ("a", 11, None), ("b", 2, "y"), ("c", 13, None)]
