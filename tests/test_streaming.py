"""Feed watch across two runs of the same streaming query (L1, L2, L4)."""

import os
import tempfile
import time

from pyspark.sql import functions as F

from conftest import SMALL
from ledgerline.operators import reconcile as R
from ledgerline.plans.fixtures import fixture
from ledgerline.streaming import feed_watch as W


def _land(df, path):
    df.coalesce(1).write.mode("append").option("header", True).csv(path)


def test_feed_watch_incremental(spark):
    run = tempfile.mkdtemp()
    hdir, vdir, out, ck = (os.path.join(run, d) for d in ("h", "v", "out", "ck"))
    h = fixture(spark, SMALL, "feed_h").drop("row_id")
    v = fixture(spark, SMALL, "feed_v").drop("row_id")
    _land(h, hdir)
    _land(v, vdir)
    W.start_feed_watch(spark, hdir, vdir, out, ck, available_now=True).awaitTermination()
    first = W.read_output(spark, out, "reconcile")
    want = R.reconcile(R.normalise_hnau(h), R.normalise_vs(v))
    assert sorted(first.collect()) == sorted(want.collect())
    # the first run compares with an empty inventory
    assert W.read_output(spark, out, "changes").count() == R.normalise_vs(v).where("qty is not null").count()

    # second run: only a new VS file (every quantity doubled) arrives
    time.sleep(1.1)
    v2 = v.withColumn("free_stock", F.concat(F.col("free_stock"), F.lit("0")))
    _land(v2, vdir)
    W.start_feed_watch(spark, hdir, vdir, out, ck, available_now=True).awaitTermination()
    second = W.read_output(spark, out, "reconcile")
    want2 = R.reconcile(R.normalise_hnau(h), R.normalise_vs(v2))
    assert sorted(second.collect()) == sorted(want2.collect())
    # the change set compares the new latest stock with the first run's inventory
    changes = W.read_output(spark, out, "changes")
    latest1 = R.normalise_vs(v).select("sku", "qty")
    latest2 = R.normalise_vs(v2).select("sku", F.col("qty").alias("q2"))
    expected = latest1.join(latest2, "sku").where(~F.col("qty").eqNullSafe(F.col("q2"))).count()
    assert changes.count() == expected
    # the ledger holds each landed file once; run log and stats have two versions
    ledger = W.read_history(spark, out, "ledger")
    assert ledger.count() == ledger.select("file_path").distinct().count() == 3
    assert W.read_history(spark, out, "runlog").count() == 6

    # an older file that lands late changes nothing
    for f in os.listdir(vdir):
        if f.endswith(".csv"):
            last = os.path.getmtime(os.path.join(vdir, f))
    _land(v.limit(3), vdir)
    for f in os.listdir(vdir):
        path = os.path.join(vdir, f)
        if f.endswith(".csv") and os.path.getmtime(path) > last:
            os.utime(path, (last - 1000, last - 1000))
    W.start_feed_watch(spark, hdir, vdir, out, ck, available_now=True).awaitTermination()
    assert sorted(W.read_output(spark, out, "inventory").collect()) == sorted(
        W.read_output(spark, out, "inventory", 2).collect())
    assert W.read_history(spark, out, "ledger").count() == 4


def _page(spark, *orders):
    import json

    from ledgerline.streaming import order_ingest as OI
    return spark.createDataFrame([(1, json.dumps({"results": list(orders)}))], OI.PAGE_SCHEMA)


ITEM = {"part_number": "p", "line_reference": "1", "quantity": 2}


def _orders(numbers, status, n_items=1):
    return [{"id": k, "status": status, "items": [ITEM] * n_items} for k in numbers]


def _covers(buckets):
    """Every hash belongs to exactly one bucket of the directory."""
    deepest = max(b["depth"] for b in buckets)
    seen = [0] * (1 << deepest)
    for b in buckets:
        for code in range(b["code"], 1 << deepest, 1 << b["depth"]):
            seen[code] += 1
    return set(seen) == {1}


def test_order_tables_double_and_keep_their_buckets_small(spark, tmp_path):
    from ledgerline.sinks import buckets as B
    from ledgerline.sinks import commitlog as CL
    from ledgerline.streaming import order_ingest as OI
    out, limit = str(tmp_path), 40
    handle = OI.make_order_handler(out, bucket_rows=limit)
    n = [0, 50, 100, 200, 400, 800]
    for batch, (a, b) in enumerate(zip(n, n[1:])):  # the table doubles with each batch
        handle(_page(spark, *_orders(range(a, b), "new", 2)), batch)
        state = CL.head(spark, out)[1]
        for table, rows in (("orders", b - (a == 0 and batch == 0)), ("order_items", 2 * (b - 1))):
            buckets = state["buckets"][table]
            assert _covers(buckets) and sum(x["rows"] for x in buckets) == (b - 1 if table == "orders" else 2 * (b - 1))
            assert max(x["rows"] for x in buckets) <= 2 * limit  # a random split is not even
            assert len(buckets) >= rows / limit / 2
    # an id of 0 is no order; all others are there with their items
    assert {int(r.order_id) for r in OI.read_orders(spark, out).collect()} == set(range(1, 800))
    before = {(b["depth"], b["code"]): b["folder"] for b in state["buckets"]["orders"]}

    # a batch of one order writes one bucket; all others keep their folders
    handle(_page(spark, {"id": 7, "status": "sent", "items": []}, {"id": 7, "tax": 1}), 9)
    state = CL.head(spark, out)[1]
    after = {(b["depth"], b["code"]): b["folder"] for b in state["buckets"]["orders"]}
    assert len(set(before.items()) ^ set(after.items())) == 2
    got = {r.order_id: r.status for r in OI.read_orders(spark, out).collect()}
    assert len(got) == 799 and got["7"] == "sent" and got["8"] == "new"
    items = OI.read_orders(spark, out, "order_items").groupBy("order_id").count().collect()
    assert len(items) == 798 and {r["count"] for r in items} == {2}

    # a replayed batch that was committed changes nothing
    handle(_page(spark, {"id": 7, "status": "again"}), 9)
    assert {r.order_id: r.status for r in OI.read_orders(spark, out).collect()}["7"] == "sent"

    # orders without items leave small buckets, which compaction joins
    handle(_page(spark, *[{"id": k, "items": []} for k in range(1, 760)]), 10)
    wide = CL.head(spark, out)[1]["buckets"]["order_items"]
    gone = B.compact(spark, out, "order_items", "order_id", limit * 8)
    joined = CL.head(spark, out)[1]["buckets"]["order_items"]
    assert gone == len(wide) - len(joined) > 0 and _covers(joined)
    assert {int(r.order_id) for r in OI.read_orders(spark, out, "order_items").collect()} == set(range(760, 800))
    # folders that no manifest holds can go
    assert CL.retire(spark, out, older_than_s=0) and OI.read_orders(spark, out).count() == 799


def test_a_key_with_many_rows_is_a_bucket_of_its_own(spark, tmp_path):
    from ledgerline.sinks import commitlog as CL
    from ledgerline.streaming import order_ingest as OI
    out = str(tmp_path)
    handle = OI.make_order_handler(out, bucket_rows=10)
    for batch in range(3):
        handle(_page(spark, *_orders([5], "new", 300), *_orders(range(100, 130), "new")), batch)
        buckets = CL.head(spark, out)[1]["buckets"]["order_items"]
        assert _covers(buckets) and len(buckets) <= 64
    assert OI.read_orders(spark, out, "order_items").count() == 330


def test_pages_of_the_look_back_are_merged_once(spark, tmp_path):
    import json

    from ledgerline.sinks import commitlog as CL
    from ledgerline.streaming import order_ingest as OI
    run = str(tmp_path)
    pages, out = os.path.join(run, "pages"), os.path.join(run, "out")
    payloads = [json.dumps({"results": _orders([k], "new")}) for k in range(1, 6)]

    def fetch(numbers, look_back, checkpoint):
        rows = [(k, payloads[k]) for k in numbers]
        spark.createDataFrame(rows, OI.PAGE_SCHEMA).coalesce(1).write.mode("append").json(pages)
        q = OI.start_order_ingest(spark, pages, out, os.path.join(run, checkpoint), available_now=True, look_back=look_back)
        q.awaitTermination()
        return [p for p in q.recentProgress if p["stateOperators"]]

    first = fetch([0, 1, 2, 0], "2 hours", "a")
    versions = CL.head(spark, out)[0]
    assert sum(p["stateOperators"][0]["numRowsUpdated"] for p in first) == 3
    again = fetch([0, 1, 2], "2 hours", "a")  # pages of the look-back only: nothing is merged
    assert CL.head(spark, out)[0] == versions and sum(p["stateOperators"][0]["numRowsUpdated"] for p in again) == 0
    fetch([2, 3, 4], "2 hours", "a")
    assert CL.head(spark, out)[0] == versions + 1 and OI.read_orders(spark, out).count() == 5

    # state is bounded: digests beyond the look-back go
    held = []
    for _ in range(4):
        held += [p["stateOperators"][0]["numRowsTotal"] for p in fetch([0, 1, 2, 3, 4], "1 second", "b")]
        time.sleep(1.2)
    assert max(held) <= 10 and OI.read_orders(spark, out).count() == 5


def test_feed_files_of_other_headers(spark, tmp_path):
    """Column orders, further columns, line breaks in cells, synonyms, a file
    without rows, one without a header, one without the columns."""
    hdir, vdir, out, ck = (str(tmp_path / d) for d in ("h", "v", "out", "ck"))
    os.makedirs(hdir), os.makedirs(vdir)

    def land(folder, name, text, at):
        path = os.path.join(folder, name)
        with open(path, "w", encoding="utf-8", newline="") as f:
            f.write(text)
        os.utime(path, (at, at))

    def run():
        W.start_feed_watch(spark, hdir, vdir, out, ck, available_now=True).awaitTermination()
        rows = W.read_output(spark, out, "reconcile")
        return None if rows is None else {r.sku: (r.hnau_qty, r.vs_qty, r.supplier_id, r.account) for r in rows.collect()}

    land(hdir, "a.csv", "\ufeffremark,online_salable_qty_quantity,sku_oms_details_sap_supplier_id,sku_oms_details_sku\n"
         "\"two\nlines\",3,S1,a\nx,4,S2,\" b\n\"\nx,9,S9,c,too,long\n", 1000)
    land(hdir, "b.csv", "sku_oms_details_sku,online_salable_qty_quantity,sku_oms_details_sap_supplier_id\nd,1e20,S3\nd,1,S3\ne,5\n", 1000)
    land(vdir, "a.csv", "supplier_sku,account,free_stock\na,ACC,7\n", 1000)
    assert run() == {"A": (3, 7, "S1", "ACC"), "B": (4, None, "S2", None), "E": (5, None, None, None)}
    assert [(r.sku, int(r.qty), r.n_rows) for r in W.read_output(spark, out, "hnau_rejected").collect()] == [("D", 10**20 + 1, 2)]
    # synonyms of the roles; a further file of the time taken last completes its delivery
    land(vdir, "b.csv", "Item Code,Vendor,On Hand\nz,ACC2,8\n", 1000)
    assert run()["Z"] == (None, 8, None, "ACC2") and run()["A"] == (3, 7, "S1", "ACC")
    # a file without a header or without the columns is refused, and the next one counts
    land(vdir, "c.csv", "\n", 4000)
    land(vdir, "d.csv", "colour,size\nred,1\n", 3000)
    land(vdir, "e.csv", "account,supplier_sku,free_stock\nACC,a,1\n", 2000)
    assert run()["A"] == (3, 1, "S1", "ACC")
    status = {os.path.basename(r.file_path): r.status for r in W.read_history(spark, out, "ledger").collect()}
    assert [status[f"{k}.csv"] for k in "abcde"] == ["seen", "seen", "refused", "refused", "seen"]
    # the newest file has a header and no rows: no stock
    land(vdir, "f.csv", "account,supplier_sku,free_stock\n", 5000)
    assert run() == {"A": (3, None, "S1", None), "B": (4, None, "S2", None), "E": (5, None, None, None)}
    # a new stream over the same outputs counts its batches anew and takes nothing older
    ck = str(tmp_path / "ck2")
    assert run()["A"] == (3, None, "S1", None)


def test_an_ingest_keeps_its_batch_on_disk(spark, tmp_path, monkeypatch):
    """Pages, parsed orders and bucket contents of a first fetch are as large as
    the table; they were kept in the executors' memory."""
    from pyspark.storagelevel import StorageLevel

    from ledgerline.streaming import order_ingest as OI
    levels = []
    kind = type(spark.range(1))
    persist = kind.persist
    monkeypatch.setattr(kind, "persist", lambda df, level=StorageLevel.MEMORY_AND_DISK_DESER: (levels.append(level), persist(df, level))[1])
    OI.make_order_handler(str(tmp_path / "out"))(_page(spark, *_orders(range(1, 9), "new", 2)), 0)
    assert len(levels) == 3 and not any(level.useMemory for level in levels)
    assert OI.read_orders(spark, str(tmp_path / "out"), "order_items").count() == 16


def test_an_ingest_keeps_keys_and_packed_files_only(spark, tmp_path, monkeypatch):
    """Parsed orders, which held the names of their page with each VARIANT, and
    the buckets' new content were kept as they were; that took more disk than pages."""
    from ledgerline.streaming import order_ingest as OI
    kept, staged = [], []
    kind, writer = type(spark.range(1)), type(spark.range(1).write)
    persist, parquet = kind.persist, writer.parquet
    monkeypatch.setattr(kind, "persist", lambda df, *level: (kept.append(set(df.columns)), persist(df, *level))[1])
    monkeypatch.setattr(writer, "parquet", lambda w, path, **k: (staged.append((path, k.get("compression"))), parquet(w, path, **k))[1])
    out = str(tmp_path / "out")
    handle = OI.make_order_handler(out, bucket_rows=40)
    for batch in range(2):
        handle(_page(spark, *_orders(range(1, 200), "new", 2)), batch)
    assert kept and all(c <= {"order_id", "n"} for c in kept)
    assert len(staged) == 6 and {codec for _, codec in staged} == {"zstd"}
    assert not os.listdir(os.path.join(out, OI.BATCHES))  # a batch that is merged leaves nothing
    assert OI.read_orders(spark, out, "order_items").count() == 398


def test_orders_land_in_packed_files(spark):
    """Pages landed as plain text, which is 15 times the tables that they are built from."""
    from ledgerline.plans import q_stream
    pages = os.path.join(os.path.dirname(q_stream.ingested(spark, SMALL).removeprefix("file:")), "pages")
    names = [n for n in os.listdir(pages) if n.startswith("part-")]
    assert names and all(n.endswith(".json.gz") for n in names)


def _placed(rows):
    return rows.withColumn("place", F.pmod(F.hash("order_id"), F.lit(3))).repartition("place")


def _batches(spark):
    """(first, later): scanned payloads in which orders come once, again, twice, and without items."""
    import json
    import random

    from ledgerline.operators import orders as O
    rng, out = random.Random(5), []
    for batch in (1, 2):
        rows = []
        for page in range(12):
            orders = []
            for pos in range(rng.randrange(9)):
                k = rng.randrange(1, 60)
                o = {"id": k, "retailer": f"R{batch}{page}", "total": pos}
                for name, value in (("status", rng.choice(["a", None])), ("order_date", rng.choice(["2024-01-02", "x"])),
                                    ("supplier", rng.choice([7, {"id": "8"}, "-"])), ("items", [ITEM | {"name": f"{batch} {page} {n}"} for n in range(rng.randrange(3))]),
                                    ("shipping_address", {"city": f"C{page}"})):
                    if rng.random() < 0.7:
                        o[name] = value
                orders.append(o)
            rows.append((batch * 100 + page, json.dumps({"results": orders})))
        out.append(O.scan_pages(spark.createDataFrame(rows, "page_no long, payload string")))
    return out


def test_items_replaced_in_place_are_those_of_the_plain_step(spark):
    from ledgerline.operators import orders as O
    first, later = _batches(spark)
    rows = O.order_rows(first)
    stored = O.replace_items(rows, place=_placed)
    assert stored.columns[0] == "place" and stored._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    stored = stored.drop("place").localCheckpoint()
    want = O.replace_items(first)
    key = repr
    assert stored.columns == want.columns and stored.count() and sorted(stored.collect(), key=key) == sorted(want.collect(), key=key)
    rows = O.order_rows(later)
    both = O.replace_items(rows, stored, place=_placed).drop("place")
    want = sorted(O.replace_items(later, stored).collect(), key=key)
    assert sorted(both.collect(), key=key) == want
    counts = {}
    for r in want:
        counts[r.order_id] = counts.get(r.order_id, 0) + 1
    assert {r.order_id: r.n for r in O.items_after(rows, stored).collect()} == counts
    # a table stored with fewer columns, and with one more
    odd = stored.drop("tax").withColumn("note", F.lit("n"))
    got = O.replace_items(rows, odd, place=_placed).drop("place")
    want = O.replace_items(later, odd)
    assert sorted(got.select(sorted(got.columns)).collect(), key=key) == sorted(want.select(sorted(want.columns)).collect(), key=key)


def test_orders_merged_in_place_are_those_of_the_plain_step(spark):
    """One shuffle deals payloads and stored orders out to where they are merged and written; there were four."""
    from ledgerline.operators import orders as O
    first, later = _batches(spark)
    stored = O.merge_orders(O.order_rows(first), place=_placed)
    assert stored.columns[0] == "place" and stored._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    stored = stored.drop("place").localCheckpoint()
    want = O.merge_orders(first)
    assert stored.columns == want.columns and sorted(stored.collect(), key=repr) == sorted(want.collect(), key=repr)
    rows = O.order_rows(later)
    both = O.merge_orders(rows, stored, place=_placed)
    assert both._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    want = O.merge_orders(later, stored).collect()
    assert len(want) > 40 and sorted(both.drop("place").collect(), key=repr) == sorted(want, key=repr)
    assert {(r.order_id, r.n) for r in O.orders_after(rows, stored).collect()} == {(r.order_id, 1) for r in want}
    assert sorted(O.merge_orders(O.order_rows(first)).collect(), key=repr) == sorted(O.merge_orders(first).collect(), key=repr)


def test_the_look_back_moves_digests_and_reads_pages_from_their_files(spark, tmp_path):
    """Whole pages were shuffled to find those that came before."""
    import json

    from ledgerline.streaming import order_ingest as OI
    pages, out, checkpoint = (str(tmp_path / d) for d in ("pages 1", "out", "ck"))
    os.makedirs(pages)

    def fetch(name, *rows):
        with open(os.path.join(pages, name), "w", encoding="utf-8") as f:
            f.write("\n".join(r if isinstance(r, str) else json.dumps({"page_no": r[0], "payload": json.dumps({"results": list(r[1:])})}) for r in rows))
        OI.start_order_ingest(spark, pages, out, checkpoint, available_now=True).awaitTermination()
        items = {r.order_id: r["count"] for r in OI.read_orders(spark, out, "order_items").groupBy("order_id").count().collect()}
        return {r.order_id: (r.status, items.get(r.order_id, 0)) for r in OI.read_orders(spark, out).collect()}

    assert OI.once_within(spark.readStream.schema(OI.PAGE_SCHEMA).json(pages)).columns == ["file", "digest"]
    old, later = {"id": 2, "status": "old", "items": [ITEM]}, {"id": 2, "status": "later", "items": [ITEM] * 2}
    assert fetch("a [1] {b,c} 50%20d?*.json", (1, {"id": 1, "status": "x", "items": [ITEM]}), (2, old)) == {"1": ("x", 1), "2": ("old", 1)}
    assert fetch("b.json", (3, later), "no page", (4,)) == {"1": ("x", 1), "2": ("later", 2)}
    # a page that came before, beside one that stands twice, and a page without text
    third = (5, {"id": 3, "status": "new", "items": [ITEM] * 3})
    assert fetch("c.json", (2, old), third, third, '{"page_no": 9}') == {"1": ("x", 1), "2": ("later", 2), "3": ("new", 3)}
    assert fetch("d.json", (2, old), third) == {"1": ("x", 1), "2": ("later", 2), "3": ("new", 3)}
