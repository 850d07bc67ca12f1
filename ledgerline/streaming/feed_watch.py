"""Feed watch: the polling loop re-aimed as a Structured
Streaming query.

The stream is that of the files themselves (path, modification time, length)
of both landing folders, so a file without rows is seen too and only those
files are read whose stock counts. Per micro-batch:

1. a side's delivery is all its files of the newest modification time, if that
   is newer than every delivery taken before, as the committed ``newest`` state
   tells (K8 / L2): an older delivery that arrives late never replaces newer
   stock. Further files of the time taken last complete that delivery;
2. each file's own header says which cells are the SKU, the quantity and the
   supplier or account (by their names, else by the synonyms of B3), so files
   may have other column orders, further columns and line breaks in cells. A
   file with a header and no rows is a delivery without stock; a file without a
   header or without those columns is refused, as the ledger says, and the next
   older delivery counts;
3. what is taken is normalised (F0; SKUs whose quantity no bigint holds go to
   ``<side>_rejected``); a side without a delivery keeps its last normalised feed;
4. the reconciliation (F1), its statistics (F1s), the five reports (D5),
   ``inventory_latest`` (I4), the change set against the previous
   ``inventory`` (F3), the run-log rows (I13 / L4), the state and the ledger
   become visible by one commit (``sinks.commitlog``). A replayed batch that was
   committed is left out.
"""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.operators import cycle as C
from ledgerline.operators import reconcile as R
from ledgerline.sinks import commitlog as CL
from ledgerline.sources import shaping as SH
from ledgerline.sources.headers import EXTRA, header_groups, named, put_together, read_group
from ledgerline.sources.readers import not_available

#: Per side: role -> (the feed's own column name, the role of B3 if there is none).
SIDES = {
    "hnau": {"sku": ("sku_oms_details_sku", "sku"), "qty": ("online_salable_qty_quantity", "qty"),
             "attr": ("sku_oms_details_sap_supplier_id", "account")},
    "vs": {"sku": ("supplier_sku", "sku"), "qty": ("free_stock", "qty"), "attr": ("account", "account")},
}
ATTRIBUTE = {"hnau": "supplier_id", "vs": "account"}
FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
LEDGER_SCHEMA = "side string, file_path string, file_mtime timestamp, status string"


def resolve(names: list[str], side: str) -> dict[str, str] | None:
    """Role -> column of a header; None if a role has no column."""
    plain = {n.strip().lower(): n for n in reversed(names)}
    out: dict[str, str] = {}
    for role, (name, synonyms) in SIDES[side].items():
        column = plain.get(name) or SH.known_column([n for n in names if n not in out.values()], synonyms)
        if column is None:
            return None
        out[role] = column
    return out


def read_delivery(spark: SparkSession, side: str, paths: list[str]) -> tuple[DataFrame | None, list[str]]:
    """(sku_raw, qty_raw, attr_raw) rows of a delivery's files, None if no file
    can be read; and the files that are refused."""
    parts, used = [], set()
    for names, files in header_groups(spark, paths, multi_line=True):
        roles = resolve(names, side)
        if roles is not None:
            rows = read_group(spark, names, files, multi_line=True).where(F.col(EXTRA).isNull())
            parts.append(rows.select(*[not_available(named(roles[r])).alias(f"{r}_raw") for r in ("sku", "qty", "attr")]))
            used |= set(files)
    refused = [p for p in paths if not any(_same_file(p, u) for u in used)]
    return (put_together(parts) if parts else None), refused


def _same_file(a: str, b: str) -> bool:
    return a.split(":", 1)[-1].lstrip("/") == b.split(":", 1)[-1].lstrip("/")


def feed_stream(spark: SparkSession, hnau_dir: str, vs_dir: str, glob: str = "*.csv",
                max_files: int | None = None) -> DataFrame:
    """(side, path, mtime) of every landed file; no content is read."""
    def side(name: str, path: str) -> DataFrame:
        r = (spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", glob).option("latestFirst", True))
        if max_files:
            r = r.option("maxFilesPerTrigger", max_files)
        return r.load(path).select(F.lit(name).alias("side"), "path", F.col("modificationTime").alias("mtime"))
    return side("hnau", hnau_dir).unionByName(side("vs", vs_dir))


def _newest(files: DataFrame, side: str, before) -> tuple | None:
    """(mtime, paths) of a side's newest delivery in the batch."""
    found = files.where(F.col("side") == side)
    if before is not None:
        found = found.where(F.col("mtime") < F.lit(before))
    row = found.groupBy("mtime").agg(F.array_sort(F.collect_set("path")).alias("paths")).orderBy(F.desc("mtime")).first()
    return None if row is None else (row["mtime"], row["paths"])


def _stamp(mtime) -> str:
    return mtime.isoformat(timespec="microseconds")


def make_batch_handler(out_dir: str, writer: str = "feed_watch"):
    """foreachBatch function running one reconciliation cycle per batch;
    ``writer`` names the stream in the manifests."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        spark, t0 = batch.sparkSession, time.time()
        state = CL.head(spark, out_dir)[1]
        if state["applied"].get(writer, -1) >= batch_id:
            return
        files = batch.persist()
        try:
            newest, staged, refused = dict(state.get("newest", {})), {}, []
            for side in SIDES:
                before, known = None, state.get("newest", {}).get(side)
                while (found := _newest(files, side, before)) is not None:
                    before, paths = found
                    if known and _stamp(before) < known["mtime"]:
                        break
                    if known and _stamp(before) == known["mtime"]:
                        paths = sorted({*paths, *known["paths"]})
                    rows, bad = read_delivery(spark, side, paths)
                    refused += bad
                    if rows is not None:
                        columns = ("sku_raw", "qty_raw", "attr_raw", ATTRIBUTE[side])
                        staged[f"{side}_norm"] = CL.stage(R.normalise_feed(rows, *columns), out_dir, f"{side}_norm")
                        staged[f"{side}_rejected"] = CL.stage(R.rejected_quantities(rows, *columns), out_dir, f"{side}_rejected")
                        newest[side] = {"mtime": _stamp(before), "paths": [p for p in paths if p not in bad]}
                        break
            bad_rows = spark.createDataFrame([(p,) for p in refused], "bad string").distinct()
            ledger = files.select("side", F.col("path").alias("file_path"), F.col("mtime").alias("file_mtime")).distinct().join(
                bad_rows, F.col("file_path") == F.col("bad"), "left").select(
                "side", "file_path", "file_mtime", F.when(F.col("bad").isNull(), F.lit("seen")).otherwise(F.lit("refused")).alias("status"))

            def also(state: dict, number: int) -> bool:
                if state["applied"].get(writer, -1) >= batch_id:
                    return False
                state["applied"][writer] = batch_id
                state["newest"] = newest
                for name, folder in staged.items():
                    CL.put(state, name, number, folder)
                CL.append(ledger, out_dir, "ledger", None, state)
                return True

            norm = {}
            for side in SIDES:
                name = f"{side}_norm"
                folder = staged.get(name) or CL.entries(state, name).get(CL.latest(state, name))
                norm[side] = None if folder is None else spark.read.parquet(f"{out_dir.rstrip('/')}/{folder}")
            if staged and all(n is not None for n in norm.values()):
                C.run_cycle(spark, norm["hnau"], norm["vs"], out_dir, started=t0, also=also)
            else:
                def change(state: dict) -> dict | None:
                    return state if also(state, (CL.latest(state, "reconcile") or 0) + 1) else None
                CL.transact(spark, out_dir, change)
        finally:
            files.unpersist()

    return handle


def start_feed_watch(spark: SparkSession, hnau_dir: str, vs_dir: str, out_dir: str, checkpoint: str,
                     interval: str | None = "120 seconds", available_now: bool = False,
                     max_files: int | None = None):
    """Start the watch; ``available_now`` processes what is there and stops
    (tests, back-fills), otherwise a processing-time trigger every
    ``interval`` (120 s by default, like the polling loop)."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        make_batch_handler(out_dir, f"feed_watch {CL.stream_id(spark, checkpoint)}")(batch, batch_id)
    w = (feed_stream(spark, hnau_dir, vs_dir, max_files=max_files).writeStream
         .foreachBatch(handle).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=interval)
    return w.start()


def read_output(spark: SparkSession, out_dir: str, name: str, number: int | None = None) -> DataFrame | None:
    """Latest entry (or entry ``number``) of one output of the watch
    (``reconcile``, ``inventory``, ``reports/mismatch`` ...)."""
    return CL.read(spark, out_dir, name, number)


def read_history(spark: SparkSession, out_dir: str, name: str) -> DataFrame | None:
    """All rows of ``ledger``, ``runlog`` or ``stats``."""
    return CL.read_all(spark, out_dir, name)
