"""The batch reconciliation cycle end to end on sf0.001."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SMALL
from ledgerline.operators import cycle as CY
from ledgerline.operators import reconcile as R
from ledgerline.plans import q_reconcile
from ledgerline.sinks import commitlog as CL
from ledgerline.sources.readers import read_csv_strings


def test_cycle_two_versions(spark):
    out = tempfile.mkdtemp()
    h, v = q_reconcile.hnau_norm(spark, SMALL), q_reconcile.vs_norm(spark, SMALL)
    j1 = CY.run_cycle(spark, h, v, out, 1, report_tag="20250101")
    assert j1.count() == q_reconcile.reconciled(spark, SMALL).count()
    # five CSV reports with the date tag, equal to the subsets
    for name in R.RECONCILE_SUBSETS:
        p = os.path.join(out, "reports_csv", f"{CY.REPORT_FILES[name]}_20250101")
        assert read_csv_strings(spark, p).count() == R.reconcile_subset(j1, name).count()
    # the first run compares with an empty inventory: every SKU with stock changed
    known = v.where(F.col("qty").isNotNull()).count()
    assert CL.read(spark, out, "changes").count() == known
    # second run with every VS quantity raised by one: every SKU with stock changes
    v2 = v.withColumn("qty", F.col("qty") + 1)
    CY.run_cycle(spark, h, v2, out, 2)
    assert CL.read(spark, out, "changes").count() == known
    stats = CL.read_all(spark, out, "stats")
    assert sorted(r.version for r in stats.select("version").collect()) == [1, 2]
    log = [tuple(r) for r in CL.read_all(spark, out, "runlog").select("version", "action", "total_skus", "changes_detected").collect()]
    n = v.count()
    assert sorted(log) == sorted((k, a, n, c) for k in (1, 2) for a, c in (
        ("refresh_inventory_latest", 0), ("compare_tables", known), ("update_inventory", 0)))
    # re-running version 2 overwrites its own output (idempotent)
    CY.run_cycle(spark, h, v2, out, 2)
    assert CL.read_all(spark, out, "runlog").count() == 6
    # without the update the inventory stays at version 2: a third run with the
    # original quantities changes every SKU again, and so does a fourth
    CY.run_cycle(spark, h, v, out, 3, update_inventory=False)
    CY.run_cycle(spark, h, v, out, 4, update_inventory=False)
    assert CL.read(spark, out, "changes").count() == known


def test_comparison_job(spark):
    import pytest
    from ledgerline.operators.compare_job import run_comparison
    from ledgerline.plans.fixtures import fixture
    wh, ec = fixture(spark, SMALL, "stock_wh"), fixture(spark, SMALL, "stock_ecom")
    roles = ("sku", "account", "qty")
    with pytest.raises(ValueError, match="unpicked:quantity"):
        run_comparison(spark, wh, ec, ("sku", "account", None), roles)
    out = tempfile.mkdtemp()
    res = run_comparison(spark, wh, ec, roles, roles, out_dir=out, fmt="csv")
    want = q_reconcile.compared(spark, SMALL)
    assert res["comparison"].count() == want.count()
    k = res["kpis"].first()
    assert k.matched + k.mismatched == k.total_rows
    assert spark.read.option("header", True).csv(os.path.join(out, "by_account")).count() == \
        res["by_account"].count()


def test_comparison_job_guesses_roles(spark):
    from ledgerline.operators.compare_job import guess_roles, run_comparison
    from ledgerline.plans.fixtures import fixture
    wh, ec = fixture(spark, SMALL, "stock_wh"), fixture(spark, SMALL, "stock_ecom")
    assert guess_roles(wh) == ("sku", "account", "qty")
    res = run_comparison(spark, wh, ec)
    assert res["comparison"].count() == q_reconcile.compared(spark, SMALL).count()
