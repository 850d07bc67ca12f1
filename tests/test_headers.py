"""CSV files of other headers read together, and column types from their cells."""

import random

import pytest

from ledgerline.sources import headers as H
from ledgerline.sources import infer as I
from ledgerline.sources import readers as RD


def land(folder, **files):
    for name, text in files.items():
        (folder / f"{name}.csv").write_bytes(text.encode("utf-8") if isinstance(text, str) else text)
    return str(folder)


def test_columns_go_by_each_files_header(spark, tmp_path):
    path = land(tmp_path, a="a,b\n1,2\n", b="﻿b,a\r\n3,4\r\n", c='b,"x,\ny",a\n5,"6\n7",8\n9\n1,2,3,4\n', d="\n\n", e="")
    rows = RD.read_csv_strings(spark, path, multi_line=True).collect()
    assert sorted((r["a"], r["b"], r["x,\ny"]) for r in rows) == [("", "9", ""), ("1", "2", ""), ("4", "3", ""), ("8", "5", "6\n7")]
    cut = RD.read_csv_strings(spark, path, multi_line=True, cut_long_rows=True).collect()
    assert sorted((r["a"], r["b"], r["x,\ny"]) for r in cut)[2] == ("3", "1", "2")
    feed = RD.read_feed_csv(spark, path, multi_line=True, with_file=True)
    assert feed.columns == ["a", "b", "file_path", "file_mtime", "x,\ny"] and feed.where("a is null").count() == 1
    assert RD.csv_header(spark, path, multi_line=True) == ["a", "b", "x,\ny"]
    with pytest.raises(ValueError, match="header"):
        RD.read_csv_raw(spark, str(tmp_path / "d.csv"))


def test_file_names_with_blanks_and_signs(spark, tmp_path):
    path = land(tmp_path, **{"a b": "x,y\n1,2\n", "c%20d é+": "y,x\n4,3\n"})
    assert sorted(tuple(r) for r in RD.read_csv_strings(spark, path).select("x", "y").collect()) == [("1", "2"), ("3", "4")]


def test_header_names_that_repeat_or_are_empty(spark, tmp_path):
    path = land(tmp_path, a="k,,K,a.b,a`b\n1,2,3,4,5\n")
    rows = RD.read_csv_strings(spark, path)
    assert rows.columns == ["k0", "_c1", "K2", "a.b", "a`b"] and tuple(rows.first()) == ("1", "2", "3", "4", "5")


def test_compressed_files_have_headers_too(spark, tmp_path):
    import gzip
    (tmp_path / "a.csv.gz").write_bytes(gzip.compress(b"b;a\n1;2\n"))
    assert RD.read_csv_strings(spark, str(tmp_path), sep=";").first().asDict() == {"b": "1", "a": "2"}


CELLS = {
    "key": (["007", "12"], "string"), "point": (["00.5"], "string"), "whole": (["1", "-22", "+3", "", None], "bigint"),
    "big": (["1", "12345678901234567890"], "decimal(20,0)"), "huge": (["1" * 39], "string"), "price": (["1.5", ".25", "3", "0.5"], "double"),
    "exact": (["1234567890123456.75", "1"], "decimal(18,2)"), "yes": (["true", "False", "TRUE"], "boolean"),
    "yes_no": (["true", "1"], "string"), "power": (["1e5", "2"], "double"), "powers": (["1e500"], "string"), "digits": (["1.2345678901234567e3"], "string"),
    "day": (["2024-02-29", "2024-01-01 10:00", "2024-01-01T10:00:01.5"], "timestamp_ntz"),
    "no_day": (["2023-02-29"], "string"), "days": (["2024-02-29", "5"], "string"), "none": ([None, "", " "], "string"), "blanks": ([" 7 "], "bigint"),
}


def test_types(spark):
    for name, (cells, expected) in CELLS.items():
        df = spark.createDataFrame([(c,) for c in cells], "x string")
        assert I.inferred_types(df) == {"x": expected}, name
        kept = I.typed(df, {"x": expected}).collect()
        assert [r.x is None for r in kept] == [c is None or expected != "string" and not c.strip() for c in cells]


def test_summaries_of_parts_join(spark):
    """Any cut of a column into parts gives the same type as the whole."""
    rng = random.Random(2)
    pool = [c for cells, _ in CELLS.values() for c in cells]
    columns = {f"c{k}": [rng.choice(pool[a:a + 5]) for _ in range(30)] for k, a in enumerate(range(0, len(pool) - 5, 2))}
    rows = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} string" for c in columns))
    whole = I.inferred_types(rows)
    parts = [spark.createDataFrame(list(zip(*columns.values()))[a:a + 10], rows.schema) for a in (0, 10, 20)]
    assert I.inferred_types(parts[0], known=[I.summaries(p) for p in parts[1:]]) == whole


def test_inference_is_one_aggregation(spark, tmp_path):
    path = land(tmp_path, a="key,n,t\n007,1,x\n008,2,NA\n", b="t,n,key\ny,3.5,009\n")
    df = RD.read_csv_inferred(spark, path)
    assert dict(df.dtypes) == {"key": "string", "n": "double", "t": "string"}
    assert sorted(tuple(r) for r in df.collect()) == [("007", 1.0, "x"), ("008", 2.0, None), ("009", 3.5, "y")]
    assert dict(RD.read_csv_inferred(spark, path, text_cols=("n",)).dtypes)["n"] == "string"
    assert H.safe_names(["a", "A", ""]) == ["a0", "A1", "_c2"]
