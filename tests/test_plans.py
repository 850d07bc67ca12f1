"""Physical-plan checks: no Python in hot paths, pushed filters, pruned
scans, no extra exchange between aggregation and join."""

import contextlib
import io
import re

from conftest import SMALL
from ledgerline.plans import q_reconcile
from ledgerline.plans.registry import load_all


def _plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_reconcile_one_join_no_python(spark):
    p = _plan(q_reconcile.reconciled(spark, SMALL))
    assert len(re.findall(r"^\(\d+\) (SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin)", p, re.M)) == 1
    # one exchange per side: the aggregation's hash partitioning is reused by the join
    assert len(re.findall(r"^\(\d+\) Exchange", p, re.M)) == 2
    assert "Python" not in p and "ArrowEval" not in p and "BatchEvalPython" not in p


def test_reconcile_scan_is_pruned_and_filtered(spark):
    p = _plan(q_reconcile.reconciled(spark, SMALL))
    assert "PushedFilters" in p
    scans = re.findall(r"ReadSchema: struct<([^>]*)>", p)
    assert scans and all("l_extendedprice" not in s for s in scans)


def test_no_registered_query_uses_python_udfs_or_pair_joins(spark):
    names = [n for n in load_all() if not n.startswith("l")]
    for name in names:
        df = load_all()[name].build(spark, SMALL)
        p = _plan(df)
        assert "BatchEvalPython" not in p and "ArrowEvalPython" not in p, name
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p, name
