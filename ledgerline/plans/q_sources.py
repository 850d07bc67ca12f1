"""Registered queries: sources and ingest shaping (A1-A4, A7-A11, B1, B4,
B6, B7, B9, D1, I14). CSV / JSON inputs are written by Spark from the given
tables into the shared checkpoint folder and read back."""

from __future__ import annotations

import os
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from ledgerline.plans.fixtures import fixture, with_fixtures
from ledgerline.plans.q_catalog import entity_payloads
from ledgerline.plans.registry import register
from ledgerline.operators import fuzzy as FZ
from ledgerline.operators.catalog import route_entities
from ledgerline.session import scratch_path, table
from ledgerline.sinks import writers as WR
from ledgerline.sources import readers as RD
from ledgerline.sources import shaping as SH


def _path(spark, sf, name):
    """A fresh folder per call, so no call overwrites files another reads."""
    return scratch_path(spark, f"inputs/{os.path.basename(sf.rstrip('/'))}/{name}/{uuid.uuid4().hex}")


def _q(c):
    """One CSV field: quoted, inner quotes doubled, null -> empty."""
    return F.concat(F.lit('"'), F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit('"'), F.lit('""')),
                    F.lit('"'))


def _write_lines(df, key, variants, path: str):
    """Write rows as text files that each begin with a header line, as exports
    in several files do; returns the glob to read. ``variants`` are pairs
    (header, line column); a row's file, and with it the variant, follows from
    the row's number ``key``: variant ``key % len(variants)``. There are as many
    files as the session has shuffle partitions, for each variant."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) * len(variants)
    heads, lines = (F.array(*x) for x in ([F.lit(h) for h, _ in variants], [c for _, c in variants]))
    part = F.pmod(key, F.lit(n)).cast("int")
    at = (F.col("part") % len(variants)) + 1
    head = df.sparkSession.range(n).select(F.col("id").cast("int").alias("part")).select(
        F.element_at(heads, at).alias("line"), "part", F.lit(0).alias("_o"))
    rows = df.select(part.alias("part"), lines.alias("_l")).select(F.element_at("_l", at).alias("line"), "part", F.lit(1).alias("_o"))
    (head.unionByName(rows).repartition(n, "part").sortWithinPartitions("part", "_o").select("part", "line")
     .write.partitionBy("part").text(path))
    return f"{path}/*"


def _both_orders(df, key, path: str, columns=None, extra=None):
    """Rows of even keys in files with the columns in order, those of odd keys
    with the columns backwards and one more of them, ``extra``."""
    columns = columns or df.columns
    back = columns[::-1]
    forth = (",".join(columns), F.concat_ws(",", *[_q(F.col(c)) for c in columns]))
    if extra is None:
        return _write_lines(df, key, [forth, (",".join(back), F.concat_ws(",", *[_q(F.col(c)) for c in back]))], path)
    return _write_lines(df, key, [forth, (",".join([*back, extra]), F.concat_ws(",", *[_q(F.col(c)) for c in back], F.lit('"n/a, really"')))], path)


def _messy(c, k):
    """Text with padding, quotes, commas and line breaks, by a number's remainder."""
    return (F.when(k % 5 == 0, F.concat(F.lit("  "), c, F.lit(" "))).when(k % 5 == 1, F.concat(c, F.lit(' "big", one')))
            .when(k % 5 == 2, F.concat(c, F.lit('\n"line"'))).otherwise(c))


def _messy_sql(c, k):
    return (f"CASE {k} % 5 WHEN 0 THEN '  ' || {c} || ' ' WHEN 1 THEN {c} || ' \"big\", one' "
            f"WHEN 2 THEN {c} || chr(10) || '\"line\"' ELSE {c} END")


# ---- A1 / A4 ------------------------------------------------------------------


_PART_TEXT = f"""
SELECT CAST(p_partkey AS VARCHAR) AS p_partkey, coalesce({_messy_sql("p_name", "p_partkey")}, '') AS p_name,
       coalesce(p_brand, '') AS p_brand, coalesce(p_type, '') AS p_type, coalesce(CAST(p_size AS VARCHAR), '') AS p_size,
       coalesce(CAST(p_retailprice AS VARCHAR), '') AS p_retailprice FROM part"""


def messy_parts(spark, sf):
    return table(spark, sf, "part").withColumn("p_name", _messy(F.col("p_name"), F.col("p_partkey")))


def _cells(*columns):
    return F.concat_ws(",", *[_q(F.col(c)) for c in columns])


@register("a1_csv_all_strings", "A1", _PART_TEXT)
def a1(spark, sf):
    p = messy_parts(spark, sf)
    p = p.withColumn("_beyond", F.explode(F.array(F.lit(False), F.lit(True))))  # each row again, with a cell too many
    cols = [c for c in p.columns if c != "_beyond"]
    beyond = F.when(F.col("_beyond"), F.lit(',"beyond"')).otherwise(F.lit(""))
    path = _write_lines(p, F.col("p_partkey"), [(",".join(c), F.concat(_cells(*c), beyond)) for c in (cols, cols[::-1])],
                        _path(spark, sf, "part_csv"))
    return RD.read_csv_strings(spark, path, multi_line=True).select(*cols)


register("a4_table_scan", "A4", "SELECT * FROM lineitem")(
    lambda spark, sf: RD.read_table(spark, os.path.join(sf, "lineitem.parquet")))


# ---- A2: typed feed with over-long and short rows -------------------------------


_FEED_H = ["row_id", "sku_oms_details_sku", "online_salable_qty_quantity", "sku_oms_details_sap_supplier_id"]


def feed_h_files(spark, sf, name, beyond=True):
    """The feed in files of two column orders, row_id first in both; some rows
    have a cell too many (unless not ``beyond``), some only the first two."""
    h = fixture(spark, sf, "feed_h")
    h = h.withColumn("sku_oms_details_sku", _messy(F.col("sku_oms_details_sku"), F.col("row_id")))
    long, short = F.col("row_id") % 13 == 0, F.col("row_id") % 17 == 0
    if not beyond:
        h = h.where(~long)
    variants = []
    for c in (_FEED_H, [_FEED_H[0], *_FEED_H[:0:-1]]):
        variants.append((",".join(c), F.when(long, F.concat(_cells(*c), F.lit(',"extra"'))).when(short, _cells(*c[:2])).otherwise(_cells(*c))))
    return _write_lines(h, F.col("row_id"), variants, _path(spark, sf, name))


# the missing-value texts, written out for the oracle
_NA = ("'', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN', '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', "
       "'NA', 'NULL', 'NaN', 'None', 'n/a', 'nan', 'null'")
_H_SKU = _messy_sql("sku_oms_details_sku", "row_id")


def _na(c):
    return f"CASE WHEN {c} IN ({_NA}) THEN NULL ELSE {c} END"


def _h_cell(c, value, missing):
    """A feed cell for the oracle: short rows of even numbers hold the SKU, of odd ones the supplier."""
    kept = {"sku_oms_details_sku": "row_id % 2 = 1", "sku_oms_details_sap_supplier_id": "row_id % 2 = 0"}.get(c, "true")
    return f"CASE WHEN row_id % 17 = 0 AND {kept} THEN {missing} ELSE {value} END AS {c}"


_H_RAW = {"sku_oms_details_sku": f"coalesce({_H_SKU}, '')", "online_salable_qty_quantity": "online_salable_qty_quantity",
          "sku_oms_details_sap_supplier_id": "sku_oms_details_sap_supplier_id"}


@register("a2_feed_csv", "A2", with_fixtures(f"""
SELECT CAST(row_id AS VARCHAR) AS row_id, {", ".join(_h_cell(c, _na(v), "NULL") for c, v in _H_RAW.items())}
FROM feed_h WHERE row_id % 13 <> 0""", "feed_h"))
def a2(spark, sf):
    return RD.read_feed_csv(spark, feed_h_files(spark, sf, "feed_h_csv"), multi_line=True).select(*_FEED_H)


# ---- A3: inferred types, key kept as text ------------------------------------------


@register("a3_csv_inferred", "A3", f"""
SELECT lpad(CAST(p_partkey AS VARCHAR), 6, '0') AS code, {_na(_messy_sql("p_name", "p_partkey"))} AS p_name,
       CAST(p_size AS BIGINT) AS p_size, p_retailprice, p_size > 25 AS large, p_size % 2 = 1 AS odd,
       CAST(p_partkey AS VARCHAR) || CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE '' END AS mixed,
       TIMESTAMP '2024-01-31 10:00:00' + to_days(CAST(p_size AS INTEGER)) AS checked,
       CAST(p_partkey AS DECIMAL(38, 0)) * 1000000000000000000 AS wide, CAST(NULL AS VARCHAR) AS nothing
FROM part""")
def a3(spark, sf):
    k = F.col("p_partkey")
    p = messy_parts(spark, sf).select(
        F.lpad(k.cast("string"), 6, "0").alias("code"), "p_name", "p_size", "p_retailprice", (F.col("p_size") > 25).alias("large"),
        F.initcap((F.col("p_size") % 2 == 1).cast("string")).alias("odd"),
        F.concat(k.cast("string"), F.when(k % 3 == 0, F.lit("x")).otherwise(F.lit(""))).alias("mixed"),
        F.expr("timestamp_ntz'2024-01-31 10:00:00' + make_dt_interval(p_size)").alias("checked"),
        F.concat(k.cast("string"), F.lit("0" * 18)).alias("wide"), F.lit("").alias("nothing"), "p_partkey")
    path = _both_orders(p, k, _path(spark, sf, "codes_csv"), p.columns[:-1])
    out = RD.read_csv_inferred(spark, path, multi_line=True)  # no column is named: 000007 stays text by itself
    return out.select(*[F.col(c).cast("decimal(38,0)") if c == "wide" else F.col(c) for c in p.columns[:-1]])


# ---- A9: product CSV ---------------------------------------------------------------

_A9_OUT = ", ".join(
    {"sku": "sku", "name": "coalesce(" + _messy_sql("name", "attribute_set_id") + ", '') AS name", "brand": "coalesce(brand, '') AS brand",
     "price": "coalesce(price, '') AS price", "status": "CAST(status AS VARCHAR) AS status",
     "visibility": "coalesce(CAST(visibility AS VARCHAR), '') AS visibility",
     "type_id": "coalesce(type_id, '') AS type_id", "weight": "coalesce(CAST(weight AS VARCHAR), '') AS weight",
     "attribute_set_id": "CAST(attribute_set_id AS VARCHAR) AS attribute_set_id",
     "custom_attributes": "custom_attributes", "extension_attributes": "extension_attributes",
     "image_urls": "image_urls"}.get(c, f"CAST(NULL AS VARCHAR) AS {c}") for c in RD.PRODUCT_COLUMNS)
_A9_COLS = ["sku", "name", "brand", "price", "status", "visibility", "type_id", "weight", "attribute_set_id",
            "custom_attributes", "extension_attributes", "image_urls"]


@register("a9_product_csv", "A9", with_fixtures(
    f"SELECT {_A9_OUT} FROM (SELECT * REPLACE (CASE WHEN attribute_set_id = 3 AND status THEN '  ' ELSE sku END "
    f"AS sku) FROM products_m2) WHERE trim(sku) <> ''", "products", "products_m2"))
def a9(spark, sf):
    m2 = fixture(spark, sf, "products_m2").withColumn("_key", F.substring("sku", 2, 30).cast("bigint")).withColumn(
        "sku", F.when((F.col("attribute_set_id") == 3) & F.col("status"), F.lit("  ")).otherwise(F.col("sku")))
    m2 = m2.withColumn("name", _messy(F.col("name"), F.col("attribute_set_id")))
    return RD.read_product_csv(spark, _both_orders(m2, F.col("_key"), _path(spark, sf, "products_csv"), _A9_COLS, extra="colour"))


# ---- A10 / I14: SKU + quantity CSV with rejects --------------------------------------


def _a10(spark, sf):
    v = fixture(spark, sf, "feed_v")
    v = v.withColumn("sku", F.when(F.col("row_id") % 23 == 0, F.lit("  ")).otherwise(_messy(F.col("supplier_sku"), F.col("row_id"))))
    v = v.withColumn("qty", F.when(F.col("row_id") % 19 == 0, F.lit(" ")).otherwise(F.col("free_stock")))
    no_qty = F.col("row_id") % 29 == 0
    variants = [("sku,qty", F.when(no_qty, _cells("sku")).otherwise(_cells("sku", "qty"))),
                ("place,sku,qty", F.when(no_qty, F.concat(F.lit("x,"), _cells("sku"))).otherwise(F.concat(F.lit("x,"), _cells("sku", "qty"))))]
    return RD.read_sku_qty_csv(spark, _write_lines(v, F.col("row_id"), variants, _path(spark, sf, "sku_qty_csv")), "sku", "qty")


_A10_BASE = """
SELECT coalesce(trim(CASE WHEN row_id % 23 = 0 THEN '  ' ELSE """ + _messy_sql("supplier_sku", "row_id") + """ END), '') AS sku,
       CASE WHEN row_id % 29 = 0 THEN NULL WHEN row_id % 19 = 0 THEN ' ' ELSE free_stock END AS q FROM feed_v"""


@register("a10_sku_qty_valid", "A10", with_fixtures("""
SELECT sku, CASE WHEN trim(q) = '' THEN 0 ELSE CAST(trim(q) AS BIGINT) END AS qty FROM base
WHERE sku <> '' AND q IS NOT NULL AND (trim(q) = '' OR regexp_matches(trim(q), '^[+-]?[0-9]+$'))""",
    "feed_v", extra={"base": _A10_BASE}))
def a10(spark, sf):
    return _a10(spark, sf)[0]


@register("a10_sku_qty_rejected", "A10/I14", with_fixtures("""
SELECT CASE WHEN sku = '' THEN 'empty sku' ELSE 'bad quantity' END AS reason, CAST(count(*) AS BIGINT) AS n
FROM base WHERE NOT (sku <> '' AND q IS NOT NULL AND (trim(q) = '' OR regexp_matches(trim(q), '^[+-]?[0-9]+$')))
GROUP BY 1""", "feed_v", extra={"base": _A10_BASE}))
def a10r(spark, sf):
    return _a10(spark, sf)[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# ---- A11: JSON documents ----------------------------------------------------------------


@register("a11_json_documents", "A11/G12", with_fixtures("""
SELECT 'product' AS kind, sku AS entity_key FROM products_m2
UNION ALL SELECT 'category', CAST(category_id AS VARCHAR) FROM category_nodes
UNION ALL SELECT 'attribute_set', CAST(p_size AS VARCHAR) FROM (SELECT DISTINCT p_size FROM part)
UNION ALL SELECT 'error:unknown_shape', NULL FROM events
UNION ALL SELECT 'error:invalid_json', NULL FROM pages
""", "products", "products_m2", "category_nodes"))
def a11(spark, sf):
    path = _path(spark, sf, "entity_json")
    entity_payloads(spark, sf).write.mode("overwrite").text(path)
    ok, bad = RD.read_json_documents(spark, path, whole_file=False)
    routed = route_entities(ok.select(F.col("raw").alias("payload")))
    rejected = bad.select(F.lit("error:invalid_json").alias("kind"), F.lit(None).cast("string").alias("entity_key"))
    return routed.select("kind", "entity_key").unionByName(rejected)


# ---- B1 / B4 / B6 / B7 / B9 / D1 ------------------------------------------------------


@register("b1_snake_headers", "B1/B2", """
SELECT p_partkey AS p_partkey, p_name AS col_2nd_name, p_brand AS brand, p_type AS brand_2, p_size AS col,
       p_retailprice AS retail_price FROM part""")
def b1(spark, sf):
    messy = table(spark, sf, "part").toDF(" P PartKey ", "2nd Name", "Brand", "brand ", "", "Retail-Price")
    return SH.snake_headers(SH.trim_headers(messy))


register("b4_projection", "B4", "SELECT p_name, p_size FROM part")(
    lambda spark, sf: SH.project(table(spark, sf, "part"), ["p_name", "no_such_column", "p_size"]))


@register("b6_pad_cells", "B6", with_fixtures(f"""
SELECT CAST(row_id AS VARCHAR) AS row_id, {", ".join(_h_cell(c, f"nullif({v}, '')", "''") for c, v in _H_RAW.items())}
FROM feed_h WHERE row_id % 13 <> 0""", "feed_h"))
def b6(spark, sf):
    path = feed_h_files(spark, sf, "feed_h_raw_csv", beyond=False)
    return SH.pad_cells(RD.read_csv_raw(spark, path, multi_line=True), empty_as_null=True).select(*_FEED_H)


@register("b7_align_append", "B7", with_fixtures("""
SELECT Account, SupplierSKU, FreeStock, CAST(NULL AS VARCHAR) AS note FROM inventory
UNION ALL SELECT Account, SupplierSKU, FreeStock, concat('latest ', SupplierSKU) FROM inventory_latest""",
    "inventory", "inventory_latest"))
def b7(spark, sf):
    batch = fixture(spark, sf, "inventory_latest").withColumn("note", F.concat(F.lit("latest "), F.col("SupplierSKU")))
    return SH.align_append(fixture(spark, sf, "inventory"), batch)


B9_TARGET = "Red Widgex"


@register("b9_approx_match", "B9", f"""
SELECT * FROM part WHERE contains(lower(trim(coalesce(p_name, ''))), '{B9_TARGET.lower()}')
   OR list_sum(list_transform(range(1, least(length(lower(trim(coalesce(p_name, '')))), {len(B9_TARGET)}) + 1),
        lambda i: CASE WHEN substring(lower(trim(coalesce(p_name, ''))), i, 1) = substring('{B9_TARGET.lower()}', i, 1)
                       THEN 1 ELSE 0 END)) >= {len(B9_TARGET) - 1}""")
def b9(spark, sf):
    p = table(spark, sf, "part")
    return p.where(SH.approx_match("p_name", B9_TARGET))


_B9_TARGETS = ("SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN concat(' ', upper(substring(p_name, 1, 5)), '_', substring(p_name, 7, 50)) "
               "WHEN p_partkey % 3 = 1 THEN substring(p_name, 3, 1 + CAST(p_partkey % 7 AS INTEGER)) ELSE concat(p_name, 's') END AS target "
               "FROM {part} WHERE p_partkey % {every} = 0")
B9_EVERY = 40


@register("b9_many_targets", "B9", f"""
SELECT p.*, lower(trim(t.target)) AS target FROM part p, (SELECT DISTINCT lower(trim(target)) AS target FROM (
  {_B9_TARGETS.format(part="part", every=B9_EVERY)})) t
WHERE trim(t.target) <> '' AND (contains(lower(trim(coalesce(p_name, ''))), t.target)
   OR list_sum(list_transform(range(1, least(length(lower(trim(coalesce(p_name, '')))), length(t.target)) + 1),
        lambda i: CASE WHEN substring(lower(trim(coalesce(p_name, ''))), i, 1) = substring(t.target, i, 1) THEN 1 ELSE 0 END)) >= length(t.target) - 1)""")
def b9_many(spark, sf):
    """A table of targets: names with a changed place, parts of names, and
    names that are one character longer."""
    p = table(spark, sf, "part")
    return FZ.approx_matches(p, "p_name", spark.sql(_B9_TARGETS.format(part="{part}", every=B9_EVERY), part=p), "target")


@register("d1_any_column_filter", "D1", """
SELECT * FROM part WHERE contains(lower(CAST(p_partkey AS VARCHAR)), 'gizmo') OR contains(lower(coalesce(p_name, '')), 'gizmo')
   OR contains(lower(coalesce(p_brand, '')), 'gizmo') OR contains(lower(coalesce(p_type, '')), 'gizmo')
   OR contains(lower(coalesce(CAST(p_size AS VARCHAR), '')), 'gizmo')
   OR contains(lower(coalesce(CAST(p_retailprice AS VARCHAR), '')), 'gizmo')""")
def d1(spark, sf):
    p = table(spark, sf, "part")
    return p.where(SH.any_column_contains(p, "  GIZMO "))


# ---- B3: guessed columns -------------------------------------------------------


@register("b3_guessed_columns", "B3", with_fixtures("""
SELECT SupplierSKU AS sku, Account AS account, FreeStock AS qty, SupplierSKU AS key FROM inventory""", "inventory"))
def b3(spark, sf):
    inv = fixture(spark, sf, "inventory")
    roles = {role: SH.guess_column(inv.columns, role) for role in ("sku", "account", "qty")}
    return inv.select(*[F.col(c).alias(role) for role, c in roles.items()], F.col(SH.guess_key(inv.columns)).alias("key"))


# ---- M1-M6 / I3: write and read back -----------------------------------------------


@register("m1_csv_round_trip", "M1", _PART_TEXT)
def m1(spark, sf):
    path = _path(spark, sf, "part_m1")
    WR.write_csv(messy_parts(spark, sf), path)
    return RD.read_csv_strings(spark, path, multi_line=True)


@register("m2_report_files", "M2", f"""
SELECT CASE WHEN p_size <= 25 THEN 'small' ELSE 'large' END AS report, * FROM ({_PART_TEXT}) t
JOIN (SELECT CAST(p_partkey AS VARCHAR) AS k, p_size AS p_size FROM part) s ON t.p_partkey = s.k""".replace(
    "SELECT CASE WHEN p_size <= 25", "SELECT CASE WHEN s.p_size <= 25").replace("AS report, *", "AS report, t.*"))
def m2(spark, sf):
    p = messy_parts(spark, sf)
    reports = {"small": p.where("p_size <= 25"), "large": p.where("p_size > 25 or p_size is null")}
    paths = WR.write_reports(reports, _path(spark, sf, "reports"), "01_02_2024")
    out = None
    for name, path in zip(reports, paths):
        one = RD.read_csv_strings(spark, path, multi_line=True).withColumn("report", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@register("m3_chunk_files", "M3", f"""
SELECT CAST(s.p_size % 7 AS INTEGER) AS file_no, t.* FROM ({_PART_TEXT}) t
JOIN (SELECT CAST(p_partkey AS VARCHAR) AS k, p_size FROM part) s ON t.p_partkey = s.k""")
def m3(spark, sf):
    path = _path(spark, sf, "chunks")
    WR.write_chunked_csv(messy_parts(spark, sf).withColumn("file_no", (F.col("p_size") % 7).cast("int")), path)
    out = None
    for n in range(7):
        one = RD.read_csv_strings(spark, f"{path}/file_no={n}", multi_line=True).withColumn("file_no", F.lit(n))
        out = one if out is None else out.unionByName(one)
    return out


@register("m4_parquet_export", "M4", "SELECT * FROM orders")
def m4(spark, sf):
    path = _path(spark, sf, "orders_parquet")
    o = table(spark, sf, "orders")
    WR.write_parquet(o, path, partition_by=["o_orderstatus"])
    return spark.read.schema(o.schema).parquet(path).select(*o.columns)


@register("m5_json_lines", "M5", f"""
SELECT p_partkey, {_messy_sql("p_name", "p_partkey")} AS p_name, p_size FROM part""")
def m5(spark, sf):
    path = _path(spark, sf, "part_jsonl")
    p = messy_parts(spark, sf).select("p_partkey", "p_name", "p_size")
    WR.write_json_lines(p, path)
    ok, _ = RD.read_json_documents(spark, path, whole_file=False)
    return ok.select(*[F.try_variant_get("v", f"$.{f.name}", f.dataType.simpleString()).alias(f.name) for f in p.schema])


@register("m6_multi_export", "M6", """
SELECT 'broken' AS name, false AS ok, true AS told, CAST(0 AS BIGINT) AS n
UNION ALL SELECT 'part', true, false, count(*) FROM part UNION ALL SELECT 'supplier', true, false, count(*) FROM supplier""")
def m6(spark, sf):
    path = _path(spark, sf, "export")
    bad = table(spark, sf, "part").select(F.when(F.col("p_partkey") > 0, F.raise_error(F.lit("no such value " * 60))).alias("x"))
    frames = {"part": messy_parts(spark, sf), "broken": bad, "supplier": table(spark, sf, "supplier")}
    told = WR.export_all(spark, frames, path)
    counts = None
    for name in ("part", "supplier"):
        one = RD.read_csv_strings(spark, f"{path}/{name}", multi_line=True).agg(F.count(F.lit(1)).alias("n")).withColumn("_name", F.lit(name))
        counts = one if counts is None else counts.unionByName(one)
    return told.join(counts, F.col("name") == F.col("_name"), "left").select(
        "name", "ok", F.col("error").isNotNull().alias("told"), F.coalesce("n", F.lit(0)).alias("n")).na.fill(False)


@register("i3_write_modes", "I3", """
SELECT 'append' AS mode, 2 * count(*) AS n FROM supplier UNION ALL SELECT 'overwrite', count(*) FROM nation
UNION ALL SELECT 'ignore', count(*) FROM supplier UNION ALL SELECT 'error', count(*) FROM supplier""")
def i3(spark, sf):
    s, out = table(spark, sf, "supplier"), None
    for mode in ("append", "overwrite", "ignore", "error"):
        path = _path(spark, sf, f"mode_{mode}")
        WR.write_table(s, path, "error")
        again = table(spark, sf, "nation") if mode in ("overwrite", "ignore") else s
        try:
            WR.write_table(again, path, mode)
        except AnalysisException:
            if mode != "error":  # only this mode refuses an existing table
                raise
        one = spark.read.parquet(path).agg(F.count(F.lit(1)).alias("n")).select(F.lit(mode).alias("mode"), "n")
        out = one if out is None else out.unionByName(one)
    return out
