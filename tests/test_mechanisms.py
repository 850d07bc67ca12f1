"""Digest tree, ordered diff, pages by rank, approximate join, comment remover,
options of attributes: against plain statements of their rules."""

import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from ledgerline.functions import text as T
from ledgerline.operators import catalog as C
from ledgerline.operators import digest as D
from ledgerline.operators import fuzzy as FZ
from ledgerline.operators import orderdiff as OD
from ledgerline.operators import paging as P
from ledgerline.operators import reconcile as R

STOCK = "Account string, SupplierSKU string, FreeStock int"

# --- digest tree


def stock(spark, rows):
    return spark.createDataFrame([("A", k, q) for k, q in rows.items()], STOCK)


def test_one_changed_sku_reads_one_leaf(spark, tmp_path):
    old = {f"sku{k}": k % 50 if k % 9 else None for k in range(4000)}
    new = old | {"sku77": 1000}
    paths = [D.write_snapshot(stock(spark, rows), str(tmp_path / name), leaf_rows=20) for name, rows in (("new", new), ("old", old))]
    assert os.listdir(f"{paths[0]}/rows") and len([x for x in os.listdir(f"{paths[0]}/rows") if x.startswith("_leaf=")]) == 256
    depth, nodes = D.changed_nodes(spark, *paths)
    assert depth == 8 and len(nodes) == 1
    leaf = D.read_nodes(spark, paths[0], depth, nodes)
    assert leaf.count() < 60 and {f.split("/_leaf=")[1].split("/")[0] for f in leaf.inputFiles()} == {str(nodes[0])}
    assert [tuple(r) for r in D.changed_since(spark, *paths).collect()] == [("sku77", "A", 1000, 27)]
    assert D.changed_nodes(spark, paths[0], paths[0]) == (0, [])  # equal roots: no further level is read
    assert D.read_snapshot(spark, paths[0]).count() == 4000


@pytest.mark.parametrize("sizes", [(100, 100), (100, 10**6), (400, 20)])
def test_digest_changes_equal_f3(spark, tmp_path, sizes, monkeypatch):
    rng = random.Random(sizes[0])
    old = {f"k{k}": rng.choice([None, 0, 1, 2]) for k in range(900)}
    new = {k: (rng.choice([None, 0, 5]) if rng.random() < 0.02 else q) for k, q in old.items() if rng.random() < 0.99}
    new |= {f"n{k}": k for k in range(5)}
    monkeypatch.setattr(D, "LISTED", 3)
    paths = [D.write_snapshot(stock(spark, rows), str(tmp_path / name), leaf_rows=n) for name, rows, n in (("new", new, sizes[0]), ("old", old, sizes[1]))]
    for zero in (False, True):
        want = R.changed_skus(stock(spark, new), stock(spark, old), null_as_zero=zero)
        assert sorted(D.changed_since(spark, *paths, null_as_zero=zero).collect(), key=repr) == sorted(want.collect(), key=repr)


def test_digest_of_empty_snapshots(spark, tmp_path):
    none, some = stock(spark, {}), stock(spark, {"a": 1})
    a, b = D.write_snapshot(none, str(tmp_path / "a")), D.write_snapshot(some, str(tmp_path / "b"))
    assert D.changed_since(spark, a, b).collect() == [] and D.changed_since(spark, a, a).collect() == []
    assert [tuple(r) for r in D.changed_since(spark, b, a).collect()] == [("a", "A", 1, None)]


# --- ordered diff


def longest(pairs):
    """Length of the longest ascending run, by trying all ends."""
    best = []
    for n, (_, j) in enumerate(pairs):
        best.append(1 + max((best[m] for m in range(n) if pairs[m][1] < j), default=0))
    return max(best, default=0)


def changed(rng, lines):
    out = [x + "!" if rng.random() < 0.1 else x for x in lines if rng.random() > 0.15]
    if out and rng.random() < 0.5:
        out.insert(rng.randrange(len(out)), out.pop(rng.randrange(len(out))))
    return out


def test_ordered_diff(spark):
    rng = random.Random(8)
    docs = []
    for k in range(60):
        lines = [rng.choice(["", "", "{", "}", f"line {n}", f"line {n % 5}"]) for n in range(rng.randint(0, 60))]
        docs.append((k, lines, changed(rng, lines)))
    docs += [(100, ["a"] * 30, ["a"] * 31), (101, [], ["x"]), (102, ["x"], []), (103, ["same"] * 9, ["same"] * 9)]
    a = spark.createDataFrame([(k, "\n".join(x) + "\n" if x else None) for k, x, _ in docs] + [(None, "z")], "doc_id int, text string")
    b = spark.createDataFrame([(k, "\n".join(y) + "\n" if y else "") for k, _, y in docs] + [(104, "only here")], "doc_id int, text string")
    a = a.unionByName(spark.createDataFrame([(104, None)], a.schema))
    whole = {}
    for r in OD.ordered_diff(a, b, context=10**6).collect():
        whole.setdefault(r.doc_id, []).append(r)
    part = {}
    for r in OD.ordered_diff(a, b).collect():
        part.setdefault(r.doc_id, []).append(r)
    for k, x, y in docs + [(104, [], ["only here"])]:
        rows = sorted(whole.get(k, []), key=lambda r: r.position)
        if x == y:
            assert not rows and k not in part
            continue
        # both versions can be read from the rows, with their line numbers
        assert [(r.before_line, r.line) for r in rows if r.op != "+"] == list(enumerate(x, 1))
        assert [(r.after_line, r.line) for r in rows if r.op != "-"] == list(enumerate(y, 1))
        assert {r.hunk for r in rows} == {1}
        # of the lines that occur once in both, as many are equal as can be
        once = [(x.index(s), y.index(s)) for s in x if x.count(s) == 1 == y.count(s)]
        assert sum(r.op == " " and x.count(r.line) == 1 == y.count(r.line) for r in rows) == longest(once)
        # hunks: the changes and three equal lines around them
        places = [n for n, r in enumerate(rows) if r.op != " "]
        near = [n for n in range(len(rows)) if any(sum(rows[m].op == " " for m in range(min(n, p), max(n, p) + 1)) <= 3
                                                   and (rows[n].op != " " or n != p) for p in places)]
        got = sorted(part[k], key=lambda r: r.position)
        assert [(r.op, r.line, r.before_line, r.after_line) for r in got] == [
            (rows[n].op, rows[n].line, rows[n].before_line, rows[n].after_line) for n in near]
        hunks, last = [], None
        for n in near:
            hunks.append(1 if last is None else hunks[-1] + (n != last + 1))
            last = n
        assert [r.hunk for r in got] == hunks
    heads = OD.hunk_headers(OD.ordered_diff(a, b)).where("doc_id = 100").first()
    assert (heads.before_lines, heads.after_lines) in ((3, 4), (0, 1))


def test_ascending_runs(spark):
    rng = random.Random(1)
    groups = {g: list(zip(range(40), rng.sample(range(60), 40))) for g in range(30)}
    df = spark.createDataFrame([(g, 0, i, j) for g, p in groups.items() for i, j in p], "key int, gap int, i int, j int")
    got = {}
    for r in OD.ascending(df).collect():
        got.setdefault(r.key, []).append((r.i, r.j))
    for g, p in groups.items():
        run = sorted(got[g])
        assert len(run) == longest(p) and set(run) <= set(p) and [j for _, j in run] == sorted(j for _, j in run)


# --- pages by rank


def test_a_page_reads_its_ranges_only(spark, tmp_path):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k"), F.lit("x").alias("odd name"))
    path = P.write_ordered(df, str(tmp_path / "t"), ["k"], range_rows=250)
    values = sorted(r.k for r in df.collect())
    ranges = len([x for x in os.listdir(f"{path}/rows") if x.startswith("_range=")])
    assert ranges >= 15
    for page_no, size in ((0, 100), (7, 100), (49, 100), (50, 100), (3, 999), (0, 10**6)):
        page = P.read_page(spark, path, ["k"], page_no, size)
        assert [r.k for r in page.collect()] == values[page_no * size:(page_no + 1) * size]
        assert page.columns == ["k", "odd name"]
        if size == 100 and page_no < 50:
            assert len({f.split("_range=")[1].split("/")[0] for f in page.inputFiles()}) <= 2


def test_pages_of_no_rows(spark, tmp_path):
    path = P.write_ordered(spark.range(0), str(tmp_path / "t"), ["id"])
    assert P.read_page(spark, path, ["id"], 0, 10).collect() == []


def test_pages_of_equal_rows(spark, tmp_path):
    df = spark.range(3000).select(F.when(F.col("id") % 3 > 0, F.lit(None).cast("long")).otherwise(F.col("id") % 2).alias("k"))
    path = P.write_ordered(df, str(tmp_path / "t"), ["k"], range_rows=200)
    sizes = [r.n for r in spark.read.parquet(f"{path}/directory").collect()]
    assert max(sizes) < 1000  # 2000 equal rows fill several ranges
    got = [r.k for n in range(30) for r in P.read_page(spark, path, ["k"], n, 100).collect()]
    assert got == [None] * 2000 + [0] * 500 + [1] * 500


# --- approximate join


def approx(value, target):
    v, t = (value or "").strip().lower(), (target or "").strip().lower()
    return bool(t) and (t in v or sum(x == y for x, y in zip(v, t)) >= max(len(t) - 1, 0))


def test_approx_join_is_the_pairwise_rule(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abA ") for _ in range(rng.randint(0, 9))) for _ in range(150)] + ["Überall", "überaxl", None, "", "naïve tea"]
    targets = ["".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(60)] + ["ÜBERALL ", None, "  ", "ï", "naive"]
    v = spark.createDataFrame([(n, w) for n, w in enumerate(words)], "n int, name string")
    t = spark.createDataFrame([(x,) for x in targets], "want string")
    got = sorted((r.n, r.target) for r in FZ.approx_matches(v, "name", t, "want").collect())
    plain = {x.strip().lower() for x in targets if x and x.strip()}
    assert got == sorted((n, x) for n, w in enumerate(words) for x in plain if approx(w, x)) and len(got) > 500
    assert FZ.approx_matches(v, "name", t.where("want is null"), "want").collect() == []


# --- comment remover


def strip_comments(s):
    """The rule, character by character."""
    out, i = [], 0
    while i < len(s):
        if s.startswith("<!--", i):
            end = s.find("-->", i + 4)
            i = len(s) if end < 0 else end + 3
        elif s[i] in "\"'":
            quote, start = s[i], i
            i += 1
            while i < len(s) and s[i] != quote:
                i += 2 if s[i] == "\\" else 1
            i = min(len(s), i + 1)
            out.append(s[start:i])
        else:
            out.append(s[i])
            i += 1
    return "".join(out)


def test_comments_outside_quotes_go(spark):
    rng = random.Random(4)
    pieces = ["<!--", "-->", "<!--->", '"', "'", "\\", "\\\"", "x", "\n", "-", "<", "é"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 14))) for _ in range(6000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.drop_html_comments("t").alias("got"))
    assert [(r.t, r.got) for r in df.collect() if r.got != strip_comments(r.t)] == []
    script = "<!-- a --><Script x>'<!-- b -->\" </SCRIPT ><!-- c -->' d <!-- e -->'<script>open <!-- f -->"
    got = spark.createDataFrame([(script,)], "t string").select(T.drop_html_comments("t", keep_scripts=True)).first()[0]
    assert got == "<Script x>'<!-- b -->\" </SCRIPT >' d <!-- e -->'<script>open <!-- f -->"


def test_comment_remover_time_follows_length(spark):
    for piece in ('"', "'\\", "<!--", "<!-- ' -->", '"a" <!-', "<script>", "\\'\""):
        took = []
        for n in (100_000, 400_000):
            df = spark.createDataFrame([(piece * (n // len(piece)),)], "t string")
            t = time.time()
            df.select(F.length(T.drop_html_comments("t", keep_scripts=True))).collect()
            took.append(time.time() - t)
        assert took[1] < 6 * took[0] + 1.5, piece


# --- options


def test_options_of_attributes(spark):
    eav = spark.createDataFrame([("p", "colour", None, 1), ("p", "name", "x", None), ("q", "colour", None, 9), ("r", "colour", None, 2)],
                                "k string, attribute_code string, value_text string, option_id long")
    options = spark.createDataFrame([(1, "red"), (2, "blue"), (2, "azure"), (3, None)], "option_id long, value string")
    got = C.pivot_attributes(eav, "k", {"colour": ("option_id", "string"), "name": ("value_text", "string")}, options)
    assert sorted(tuple(r) for r in got.collect()) == [("p", "red", "x"), ("q", None, None), ("r", "blue", None)]
    raw = C.pivot_attributes(eav, "k", {"colour": ("option_id", "bigint")})
    assert sorted(tuple(r) for r in raw.collect()) == [("p", 1), ("q", 9), ("r", 2)]


def test_no_comment_pattern_needs_a_deep_stack():
    assert not re.search(r"\)\*[^+]", T._QUOTED_RUN)


def test_order_pages_shuffle_no_json(spark):
    """Orders and items are dealt out by page number; the texts of orders were
    shuffled to put pages together, and lineitem was joined."""
    from conftest import SMALL

    from ledgerline.plans import q_orders
    plan = q_orders.order_payload_pages(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan


def test_ordered_diff_takes_lines_apart_once(spark):
    """Both versions were built and split anew for each of the three steps."""
    from ledgerline.operators import orderdiff as OD
    a = spark.createDataFrame([(1, "x\ny\nz")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "x\nz\nw")], "doc_id long, text string")
    diff = OD.ordered_diff(a, b)
    assert "posexplode" not in diff._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.op, r.line) for r in diff.orderBy("position").collect()] == [(" ", "x"), ("-", "y"), (" ", "z"), ("+", "w")]


def test_order_pages_move_plain_columns(spark):
    """Texts made from an item's columns (its time, name and numbers) were dealt
    out, sorted and copied; they are made where the page is put together."""
    from conftest import SMALL

    from ledgerline.plans import q_orders
    plan = q_orders.order_payload_pages(spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    below = plan[plan.index("Exchange "):]
    assert "date_format" not in below and "Part " not in below and "date_format" in plan


def test_an_order_is_read_in_one_pass_over_its_members(spark):
    """Each column of an order was looked up by its own path."""
    import json

    from ledgerline.operators import orders as O
    odd = [{"order_reference": "", "order_id": 0, "id": "0"}, {"order_reference": 0.0, "order_id": False, "id": "false"},
           {"order_reference": -0.0, "order_id": None, "id": -5}, {"order_reference": "-", "status": None},
           {"order_reference": "f", "status": {"a": 1}, "subtotal": " 2 ", "tax": True, "total": "x", "items": [1]},
           {"order_reference": {}, "retailer": 7}, {"order_reference": [], "currency_code": "EUR"}, {"id": 0}, {}, 3, None, [1]]
    pages = spark.createDataFrame([(1, json.dumps({"results": odd})), (2, '{"results": 5}'), (3, "no"), (4, None)],
                                  "page_no long, payload string")
    rows = {r.order_id: r for r in O.merge_orders(O.scan_pages(pages), items_col="items").collect()}
    assert set(rows) == {"0", "false", "-5", "-", "f", "{}", "[]"}
    assert (rows["f"].status, rows["f"].subtotal, rows["f"].tax, rows["f"].total, rows["f"].items) == ('{"a":1}', 2.0, 1.0, 0.0, "[1]")
    assert rows["{}"].retailer == "7" and rows["[]"].currency_code == "EUR" and rows["-"].status is None
    plan = O.merge_orders(O.scan_pages(pages, items=False))._jdf.queryExecution().optimizedPlan().toString()
    assert "$.status" not in plan and "$.retailer" not in plan and "items" not in plan


def test_merged_orders_copy_no_items(spark):
    """A whole order, its items too, was copied out of its page for the columns of orders."""
    from conftest import SMALL

    from ledgerline.plans import q_orders
    plan = q_orders.merged_orders(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "StructField(supplier,VariantType" in plan
    assert "ArrayType(VariantType" not in plan and "StructField(items,VariantType" not in plan


def test_merged_orders_hold_the_payload_place_once_per_group_of_columns(spark):
    """Each of 11 columns had its own aggregate, and each of them its own copy of the payload's place."""
    from ledgerline.operators import orders as O
    pages = spark.createDataFrame([(1, '{"results": [{"id": 1, "retailer": "a", "total": 1}, {"id": 1, "retailer": "b", "tax": 2}]}')],
                                  "page_no long, payload string")
    merged = O.merge_orders(O.scan_pages(pages, items=False))
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    aggregate = next(line for line in plan.splitlines() if "Aggregate [" in line)
    assert aggregate.count("min_by(") == 1 and aggregate.count("max_by(") == 7 and "_src" not in plan
    row = merged.first()
    assert (row.order_id, row.retailer, row.subtotal, row.tax, row.total) == ("1", "a", 0.0, 2.0, 0.0)


def test_sorted_rows_are_numbered_where_they_are(spark):
    """Rows in order were dealt out and sorted once more to be numbered."""
    from ledgerline.plans.registry import in_order
    called, frame = [], type(spark.range(0))
    deal = frame.repartitionByRange
    frame.repartitionByRange = lambda self, *a: called.append(a) or deal(self, *a)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        ordered = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("k")).orderBy(F.col("k").desc())
        rows = in_order(ordered).collect()
        parts = ordered.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set(key, old)
        frame.repartitionByRange = deal
    ks = sorted((r.k for r in rows), reverse=True)
    assert sorted((r.position, r.k) for r in rows) == list(enumerate(ks, 1))
    assert parts > 1 and not called
    assert in_order(spark.range(0).orderBy("id")).collect() == []


def test_ordered_diff_moves_texts_and_not_their_lines(spark):
    """Each line was a row of a dozen shuffles and four checkpoints, with its document's key."""
    from conftest import SMALL

    from ledgerline.plans.registry import load_all
    a = spark.createDataFrame([(k, f"x\ny {k}\nz") for k in range(9)], "doc_id long, text string")
    b = spark.createDataFrame([(k, f"x\nz\ny {k % 5}") for k in range(1, 11)], "doc_id long, text string")
    plan = OD.ordered_diff(a, b)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 2 and plan.count("MapInArrow") == 1 and "Window" not in plan and "Generate" not in plan
    diff = load_all()["f9_ordered_diff"].build(spark, SMALL)
    assert diff.count() > 0
    plan = diff._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan and "Aggregate" not in plan


def test_ordered_diff_needs_no_package_on_workers():
    """A worker that can't import the package gets its functions by value."""
    import subprocess
    import sys

    from pyspark import cloudpickle
    code = "import pickle, sys; print(pickle.loads(sys.stdin.buffer.read())([b'a', b'b', b'a'], [b'b', b'a', b'c'], 1))"
    got = subprocess.run([sys.executable, "-I", "-c", code], input=cloudpickle.dumps(OD.hunk_rows), cwd="/", capture_output=True, check=True)
    assert got.stdout.decode().strip() == str([(1, "-", 1, None, b"a"), (1, " ", 2, 1, b"b"), (1, " ", 3, 2, b"a"), (1, "+", None, 3, b"c")])


def test_hunks_of_large_documents_keep_their_positions(spark):
    """Rows leave in parts of a bounded number; a document's positions go on over them."""
    n = 3 * OD.ROWS_OUT + 7
    a = spark.createDataFrame([(1, "a\n"), (2, None), (3, "b")], "doc_id long, text string")
    b = spark.sql(f"SELECT CAST(id AS bigint) AS doc_id, array_join(transform(sequence(1, {n}), x -> concat('l', x)), '\n') AS text FROM range(1, 3)")
    rows = OD.ordered_diff(a, b)
    assert sorted((r.doc_id, r.low, r.high, r.n, r.hunks) for r in rows.groupBy("doc_id").agg(
        F.min("position").alias("low"), F.max("position").alias("high"), F.count_distinct("position").alias("n"),
        F.count_distinct("hunk").alias("hunks")).collect()) == [(1, 1, n + 1, n + 1, 1), (2, 1, n, n, 1), (3, 1, 1, 1, 1)]
    assert rows.where("op = '+' AND line <> concat('l', after_line)").count() == 0
