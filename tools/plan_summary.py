"""Summarise the physical plan of every registered query (or a subset):
exchanges, joins, aggregates, windows, Python nodes, pushed filters.

Usage: python tools/plan_summary.py [--sf DIR] [--markdown] [name-substring ...]
"""

from __future__ import annotations

import argparse
import contextlib
import io
import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NODES = ("Exchange", "BroadcastExchange", "SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin",
         "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate", "SortAggregate", "ObjectHashAggregate",
         "Window", "Generate", "BatchEvalPython", "ArrowEvalPython", "TakeOrderedAndProject")


def summarise(df) -> dict:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    text = buf.getvalue()
    tree = text.split("\n\n")[0]
    counts = Counter(re.findall(r"\b(" + "|".join(NODES) + r")\b", tree))
    pushed = len(re.findall(r"PushedFilters: \[[^\]]+\]", text))
    scans = len(re.findall(r"^\(\d+\) Scan ", text, re.M))
    return {"nodes": dict(counts), "scans": scans, "scans_with_pushed_filters": pushed}


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="/root/testdata/sf0.1")
    ap.add_argument("--markdown", action="store_true")
    ap.add_argument("names", nargs="*")
    args = ap.parse_args()
    from ledgerline.plans.registry import load_all
    from ledgerline.session import build_session
    spark = build_session()
    reg = load_all()
    names = [n for n in reg if (not args.names or any(s in n for s in args.names)) and not n.startswith("l")]
    if args.markdown:
        print("| query | exchanges | joins | aggregates | other | scans (pushed filters) |")
        print("| --- | --- | --- | --- | --- | --- |")
    for n in names:
        s = summarise(reg[n].build(spark, args.sf))
        c = s["nodes"]
        ex = c.get("Exchange", 0)
        joins = ", ".join(f"{k} {v}" for k, v in c.items() if "Join" in k or k == "CartesianProduct")
        aggs = ", ".join(f"{k} {v}" for k, v in c.items() if "Aggregate" in k)
        other = ", ".join(f"{k} {v}" for k, v in c.items()
                          if k in ("BroadcastExchange", "Window", "Generate", "TakeOrderedAndProject",
                                   "BatchEvalPython", "ArrowEvalPython"))
        if args.markdown:
            print(f"| {n} | {ex} | {joins} | {aggs} | {other} | {s['scans']} ({s['scans_with_pushed_filters']}) |")
        else:
            print(n, s)
    spark.stop()


if __name__ == "__main__":
    main()
