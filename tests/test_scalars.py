"""Golden cases worked by hand from the reference semantics (FIXTURES.md)."""

from pyspark.sql import functions as F

from ledgerline.functions import jsonfn as J
from ledgerline.functions import scalars as S
from ledgerline.sources import shaping as SH


def _one(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_parse_qty_goldens(spark):
    cases = {"1,234": 1234, "(5)": -5, "(-5)": 5, "2.5": 3, "-2.5": -3, "1e3": 1000, "": 0, "NULL": 0,
             "nan": 0, "abc": 0, None: 0, "  7 ": 7, "( 3 )": -3, "()": 0, "(5": 0}
    got = _one(spark, list(cases), S.parse_qty)
    assert got == list(cases.values())


def test_clean_sku(spark):
    assert _one(spark, [" ab-1 ", "", "   ", None, " x "], S.clean_sku) == ["AB-1", None, None, None, "X"]


def test_header_snake_case():
    names = [SH.snake_header(h) for h in ["SKU", "sku ", "2nd Price", ""]]
    assert SH.dedupe_names(names) == ["sku", "sku_2", "col_2nd_price", "col"]
    # the reference's collision (a, a, a_2 -> a_2 twice) does not happen
    out = SH.dedupe_names(["a", "a", "a_2"])
    assert len(set(out)) == 3


def test_supplier_id(spark):
    df = spark.createDataFrame([('"/api/suppliers/42/"',), ('{"id":"7"}',), ('"sup-19x"',), ('"abc"',), ("5",),
                                ('{"supplier_id": 3}',), ("null",)], "t string")
    got = [r[0] for r in df.select(J.supplier_id(F.parse_json("t"))).collect()]
    assert got == [42, 7, 19, None, 5, 3, None]


def test_iso_timestamps(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05Z",), ("20240102T030405",), ("2024-01-02",), ("bad",), ("",)],
                               "s string")
    got = [r[0] for r in df.select(F.date_format(J.parse_iso_ts("s"), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:05", "2024-01-02 00:00:00", None, None]


def test_lenient_parsers(spark):
    assert _one(spark, ["1", "TRUE", " yes ", "no", None], S.lenient_bool) == [True, True, True, False, False]
    assert _one(spark, ["2.7", "-2.7", "x", "inf", None], S.lenient_int) == [2, -2, None, None, None]
    assert _one(spark, ["2.7", " 3 ", "x"], lambda c: S.strict_int(c, 0)) == [0, 3, 0]


def test_role_guess():
    assert SH.guess_column(["Item Code", "Free Stock", "Vendor"], "sku") == "Item Code"
    assert SH.guess_column(["a", "b"], "qty") == "a"
    assert SH.guess_column(["x_supplier_x"], "account") == "x_supplier_x"


def test_mapping_errors():
    from ledgerline.operators.quality import mapping_errors
    cols = ["sku", "acc", "q"]
    assert mapping_errors(cols, "W", "sku", None, "") == ["W:unpicked:account", "W:unpicked:quantity"]
    assert mapping_errors(cols, "W", "sku", "sku", "q") == ["W:shared:sku"]
    assert mapping_errors(cols, "W", "sku", "acc", "qty") == ["W:unknown:qty"]
    assert mapping_errors(cols, "W", "sku", "acc", "q") == []


def test_newest_path_raises_when_nothing_matches(spark, tmp_path):
    import pytest
    from ledgerline.sources.readers import newest_path
    (tmp_path / "a.csv").write_text("x\n1\n")
    assert newest_path(spark, str(tmp_path), "*.csv").endswith("a.csv")
    with pytest.raises(FileNotFoundError):
        newest_path(spark, str(tmp_path), "*.json")


def test_python_whitespace_strip(spark):
    # \x1c-\x1f count as white space for str.strip(); ​ does not
    vals = ["\x1cab\x1f", " x ", "​y"]
    assert _one(spark, vals, S.clean_sku) == [v.strip().upper() or None for v in vals]


def test_python_whitespace_set_is_complete():
    assert S.PY_WS_CHARS == "".join(c for c in map(chr, range(0x110000)) if c.isspace())


def test_iso_wall_clock_kept_for_offsets(spark):
    df = spark.createDataFrame([("2024-01-02T03:04:05+02:00",), ("2024-01-02T03:04:05Z",)], "s string")
    got = [r[0] for r in df.select(F.date_format(J.parse_iso_ts("s"), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == ["2024-01-02 03:04:05", "2024-01-02 03:04:05"]


def test_key_guesses():
    assert SH.guess_key(["Account", "SupplierSKU", "FreeStock"]) == "SupplierSKU"
    assert SH.guess_key(["Account", "SupplierSKU"], SH.ACCOUNT_KEY_CANDIDATES) == "Account"
    assert SH.guess_key(["x", "y"]) is None


def test_strict_int_like_python(spark):
    vals = ["1_000", "1__0", "_1", "1_", " +12 ", "-3", "007", "1.0", ""]
    def py(v):
        try:
            return int(v)
        except ValueError:
            return None
    assert _one(spark, vals, S.strict_int) == [py(v) for v in vals]


def test_supplier_id_keeps_every_digit(spark):
    df = spark.createDataFrame([("9007199254740993",), ('{"id": 9007199254740993}',), ('{"id": 2.9}',)], "t string")
    assert [r[0] for r in df.select(J.supplier_id(F.parse_json("t"))).collect()] == [9007199254740993, 9007199254740993, 2]


def test_iso_times_exact_forms(spark):
    good = {"20240102": "2024-01-02 00:00:00", "2024-01-02": "2024-01-02 00:00:00", "2024-01-02T03:04": "2024-01-02 03:04:00",
            "20240102T030405": "2024-01-02 03:04:05", "2024-01-02T03:04:05.123Z": "2024-01-02 03:04:05",
            "2024-01-02 03:04:05+02:00": "2024-01-02 03:04:05"}
    bad = ["2024", "2024-01", "2024-1-2", "2024-13-01", "n/a", "", "2024-01-02T", "2024-01-02T25:00"]
    df = spark.createDataFrame([(t,) for t in [*good, *bad]], "s string")
    got = [r[0] for r in df.select(F.date_format(J.parse_iso_ts("s"), "yyyy-MM-dd HH:mm:ss")).collect()]
    assert got == [*good.values(), *[None] * len(bad)]


def test_order_key_takes_texts_that_look_falsy(spark):
    from ledgerline.operators.orders import order_key
    rows = [('{"order_reference":"0","id":5}', "0"), ('{"order_reference":"false","id":5}', "false"),
            ('{"order_reference":"","order_id":0,"id":5}', "5"), ('{"order_reference":null,"order_id":false,"id":"x"}', "x"),
            ('{"order_reference":0.0,"id":7}', "7"), ('{"id":0}', None)]
    df = spark.createDataFrame(rows, "j string, e string")
    assert [r[0] for r in df.select(order_key(F.parse_json("j"))).collect()] == [e for _, e in rows]


def test_a_time_is_read_by_one_regex(spark):
    """The nine matches of each time stood in the plan, the time's text with them."""
    texts = ["2024-01-02T03:04:05.1234567Z", "20240102 0304", "2024-01-02\n", "2024-01-02 03,5+01:00 ", "2024-0102", "2024-01-02T3", "=20240102||", ""]
    df = spark.createDataFrame([(t,) for t in texts], "s string").select(J.parse_iso_ts("s").cast("string").alias("t"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert sum(plan.count(f) for f in ("regexp_extract", "RLIKE", "regexp_replace")) == 1
    assert [r.t for r in df.collect()] == ["2024-01-02 03:04:05.123456", "2024-01-02 03:04:00", "2024-01-02 00:00:00",
                                           "2024-01-02 03:00:00.5", None, None, None, None]
