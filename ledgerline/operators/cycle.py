"""The reconciliation cycle as one batch job: F0 x 2 -> F1
written once -> {F1s, the five reports (D5, M2), F3 against the previous
inventory} -> I4 -> run log (I13).

All outputs become visible together, by one commit (``sinks.commitlog``): a
reader never sees half a cycle. Of two cycles at once the later one takes its
change set anew against the inventory that the earlier one has committed; the
reconciliation itself, which doesn't depend on other cycles, is written once
and read back for each report.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import reconcile as R
from ledgerline.operators import upsert as U
from ledgerline.sinks import commitlog as CL
from ledgerline.sinks.writers import write_csv

# Report file stems of the five subsets and the date-tag format, fixed values.
REPORT_FILES = {
    "mismatch": "stock_mismatches",
    "only_hnau": "only_in_hnau",
    "only_vs": "only_in_vs",
    "hnau_in_vs_out": "hnau_in_vs_out",
    "vs_in_hnau_out": "vs_in_hnau_out",
}
REPORT_TAG_FORMAT = "%d_%m_%Y"


def run_cycle(spark: SparkSession, hnau_norm: DataFrame, vs_norm: DataFrame, out_dir: str, version: int | None = None,
              report_tag: str | None = None, started: float | None = None,
              update_inventory: bool = True, also=None) -> DataFrame:
    """Run one reconciliation cycle on two normalised feeds; returns the
    written reconciliation (read back from storage).

    ``version`` numbers the cycle (default: the next one); running a number
    again replaces its outputs. ``report_tag`` (e.g.
    ``time.strftime(REPORT_TAG_FORMAT)``) additionally exports the five reports
    as CSV folders ``reports_csv/<stem>_<tag>`` (M2). ``inventory`` is advanced
    to the latest stock only with ``update_inventory``; the change set is always
    taken against the inventory before this cycle (an empty one on the first
    run). The run log gets a row for the refresh, the comparison with its number
    of changed SKUs, and the update. ``also(state, version)``, if given, makes
    further changes of the same commit; False from it leaves all as it is."""
    t0 = started if started is not None else time.time()
    base = out_dir.rstrip("/")

    def stored(folder: str, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{base}/{folder}")

    once = {"reconcile": CL.stage(R.reconcile(hnau_norm, vs_norm), base, "reconcile")}
    joined = spark.read.parquet(f"{base}/{once['reconcile']}")
    for name in R.RECONCILE_SUBSETS:
        subset = R.reconcile_subset(joined, name)
        once[f"reports/{name}"] = CL.stage(subset, base, f"reports/{name}")
        if report_tag:
            write_csv(subset, os.path.join(out_dir, "reports_csv", f"{REPORT_FILES[name]}_{report_tag}"))
    latest = U.refresh_latest_from_norm(vs_norm)
    once["inventory_latest"] = CL.stage(latest, base, "inventory_latest")
    latest = stored(once["inventory_latest"], latest.schema)
    t1 = time.time()

    def change(state: dict) -> dict | None:
        number = version if version is not None else (CL.latest(state, "reconcile") or 0) + 1
        if also is not None and also(state, number) is False:
            return None
        previous = CL.read(spark, base, "inventory", before=number, state=state)
        if previous is None:  # the first run compares with an empty table
            previous = latest.where(F.lit(False))
        t2 = time.time()
        compared = R.snapshot_comparison(latest, previous)
        for name, folder in once.items():
            CL.put(state, name, number, folder)
        CL.put(state, "changes", number, CL.stage(compared.where("changed").drop("changed"), base, "changes"))
        t3 = time.time()
        counts = compared.agg(F.count(F.lit(1)).alias("total"), F.count_if("changed").alias("changed"), F.lit(0).alias("none"))
        counts = spark.createDataFrame(counts.collect(), counts.schema)  # one row, for three rows of the log
        if update_inventory:
            CL.put(state, "inventory", number, once["inventory_latest"])
        at = time.strftime("%Y-%m-%d %H:%M:%S")
        log = U.run_log_row(counts, "refresh_inventory_latest", "total", "none", t1 - t0, at).unionAll(
            U.run_log_row(counts, "compare_tables", "total", "changed", t3 - t2, at))
        if update_inventory:
            log = log.unionAll(U.run_log_row(counts, "update_inventory", "total", "none", time.time() - t3, at))
        CL.append(R.reconcile_stats(joined).withColumn("version", F.lit(number)), base, "stats", number, state)
        CL.append(log.withColumn("version", F.lit(number)), base, "runlog", number, state)
        return state

    CL.transact(spark, base, change)
    return joined
