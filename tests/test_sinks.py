"""Sinks and streaming helpers: round trips through files."""

import os
import tempfile

from pyspark.sql import functions as F

from conftest import SMALL
from ledgerline.plans import q_feed
from ledgerline.sinks import writers as W
from ledgerline.sources import readers as RD


def test_csv_round_trip(spark):
    d = tempfile.mkdtemp()
    df = spark.createDataFrame([("a", "1"), ("b,c", None)], "x string, y string")
    W.write_csv(df, os.path.join(d, "out"))
    back = RD.read_csv_strings(spark, os.path.join(d, "out"))
    assert sorted(tuple(r) for r in back.collect()) == [("a", "1"), ("b,c", "")]


def test_chunked_csv(spark):
    d = tempfile.mkdtemp()
    feed = q_feed.g3(spark, SMALL)
    W.write_chunked_csv(feed.drop("sku_rank", "row_rank"), os.path.join(d, "chunks"))
    dirs = sorted(x for x in os.listdir(os.path.join(d, "chunks")) if x.startswith("file_no="))
    assert len(dirs) == feed.select("file_no").distinct().count()


def test_versioned_table(spark):
    base = os.path.join(tempfile.mkdtemp(), "t")
    W.write_version(spark.range(3), base, 1)
    W.write_version(spark.range(5), base, 2)
    assert W.read_version(spark, base).count() == 5
    assert W.read_version(spark, base, 1).count() == 3


def test_export_all_collects_errors(spark):
    d = tempfile.mkdtemp()
    bad = spark.range(2).select(F.assert_true(F.col("id") < 0, "boom").alias("x"))  # fails while writing
    res = W.export_all(spark, {"good": spark.range(2), "bad": bad}, d).collect()
    by = {r.name: r for r in res}
    assert by["good"].ok and not by["bad"].ok and by["bad"].error


def test_json_lines_and_table_modes(spark):
    d = tempfile.mkdtemp()
    W.write_json_lines(spark.range(3), os.path.join(d, "j"))
    assert spark.read.json(os.path.join(d, "j")).count() == 3
    W.write_table(spark.range(2), os.path.join(d, "t"), "append")
    W.write_table(spark.range(2), os.path.join(d, "t"), "append")
    assert spark.read.parquet(os.path.join(d, "t")).count() == 4
    W.write_table(spark.range(2), os.path.join(d, "t"), "ignore")
    assert spark.read.parquet(os.path.join(d, "t")).count() == 4


def test_bom_and_ragged_csv(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "f.csv")
    with open(p, "w", encoding="utf-8-sig") as f:
        f.write("a,b,c\n1,2,3\n4,5\n6,7,8,9\n")
    rows = RD.read_feed_csv(spark, p).collect()
    assert [tuple(r) for r in rows] == [("1", "2", "3"), ("4", "5", None)]
    assert RD.read_csv_strings(spark, p).columns == ["a", "b", "c"]


def test_write_reports_from_one_result(spark):
    from ledgerline.operators import reconcile as R
    from ledgerline.plans import q_reconcile
    d = tempfile.mkdtemp()
    joined = q_reconcile.reconciled(spark, SMALL).persist()
    paths = W.write_reports({n: R.reconcile_subset(joined, n) for n in R.RECONCILE_SUBSETS},
                            os.path.join(d, "inv"), "20250101")
    assert len(paths) == 5
    back = RD.read_csv_strings(spark, paths[0])
    assert back.count() == R.reconcile_subset(joined, "mismatch").count()
    joined.unpersist()


def test_media_entries_from_files(spark):
    import base64
    from ledgerline.operators.catalog import media_entries
    d = tempfile.mkdtemp()
    for name, data in (("b.png", b"\x89PNG1"), ("a.jpg", b"\xff\xd8jpg")):
        with open(os.path.join(d, name), "wb") as f:
            f.write(data)
    files = RD.read_files(spark, d).withColumn("sku", F.lit("S1"))
    rows = sorted(media_entries(files).collect(), key=lambda r: r.position)
    assert [r.label for r in rows] == ["a.jpg", "b.png"]
    assert rows[0].types == ["image", "small_image", "thumbnail"] and rows[1].types == []
    assert rows[0].content.type == "image/jpeg" and rows[1].content.type == "image/png"
    assert rows[0].content.name == "S1-1.jpeg"
    assert base64.b64decode(rows[1].content.base64_encoded_data) == b"\x89PNG1"


def test_all_string_reader_long_rows(spark):
    d = tempfile.mkdtemp()
    p = os.path.join(d, "f.csv")
    with open(p, "w", encoding="utf-8") as f:
        f.write("a,b\n1,2\n3\n4,5,6\n")
    cut = sorted(tuple(r) for r in RD.read_csv_strings(spark, p, cut_long_rows=True).collect())
    skipped = sorted(tuple(r) for r in RD.read_csv_strings(spark, p).collect())
    assert cut == [("1", "2"), ("3", ""), ("4", "5")]
    assert skipped == [("1", "2"), ("3", "")]


CELLS = ["plain", "  pad ", 'say "hi", ok', 'A "big" one, x', "two\nlines", '"', '""', ",", " ", "back\\slash\\", 'x\\"y', "é漢", "'q'"]


def test_csv_as_the_standard_module_writes_it(spark, tmp_path):
    import csv
    rows = [(str(k), c, CELLS[-1 - k]) for k, c in enumerate(CELLS)]
    with open(tmp_path / "in.csv", "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(["k", "a", "b"])
        w.writerows(rows)
    path = str(tmp_path / "in.csv")
    for df in (RD.read_csv_strings(spark, path, multi_line=True), RD.read_csv_raw(spark, path, multi_line=True),
               RD.read_csv_inferred(spark, path, text_cols=("k",), multi_line=True)):
        assert sorted(tuple(r) for r in df.collect()) == sorted(rows)
    valid, rejected = RD.read_sku_qty_csv(spark, path, "a", "k")
    assert {r.sku for r in valid.collect()} == {c.strip() for c in CELLS if c.strip()}
    assert [r.reason for r in rejected.collect()] == ["empty sku"]


def test_csv_as_the_standard_module_reads_it(spark, tmp_path):
    import csv
    rows = [(str(k), c, CELLS[-1 - k]) for k, c in enumerate(CELLS)]
    path = str(tmp_path / "out")
    W.write_csv(spark.createDataFrame(rows, "k string, a string, b string"), path)
    got = []
    for name in os.listdir(path):
        if name.endswith(".csv"):
            with open(os.path.join(path, name), newline="", encoding="utf-8") as f:
                got += [tuple(r) for r in csv.reader(f)][1:]
    assert sorted(got) == sorted(rows)


def test_export_keeps_the_whole_error(spark, tmp_path):
    long = "n" * 900
    bad = spark.range(1).select(F.col("id").alias(long), F.col("id").alias(long))  # a name twice can't be written
    told = {r.name: r for r in W.export_all(spark, {"bad": bad, "good": spark.range(2)}, str(tmp_path), fmt="parquet").collect()}
    assert told["good"].ok and not told["bad"].ok and long in told["bad"].error
