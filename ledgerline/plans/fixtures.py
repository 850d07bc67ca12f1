"""Derived fixtures over the driver tables (FIXTURES.md section B).

Each body runs unchanged in Spark SQL (ANSI on) and DuckDB. Table names are
written as ``{lineitem}`` placeholders (literal braces doubled): Spark binds them to DataFrames through
``spark.sql(text, lineitem=df)`` (no global temp views), the oracle renders
them as plain view names.
"""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession

from ledgerline.session import table

FIXTURE_SQL: dict[str, str] = {
    "feed_h": """
SELECT l_orderkey * 10 + l_linenumber AS row_id,
       CASE WHEN l_orderkey % 97 = 0 THEN NULL
            WHEN l_orderkey % 3 = 0 THEN concat(' sku-', cast(l_partkey AS string), ' ')
            ELSE concat('SKU-', cast(l_partkey AS string)) END AS sku_oms_details_sku,
       CASE WHEN l_orderkey % 11 = 0 THEN 'NULL'
            WHEN l_orderkey % 7 = 0 THEN concat('(', cast(cast(l_quantity AS int) AS string), ')')
            WHEN l_orderkey % 5 = 0 THEN concat('1,', cast(100 + cast(l_quantity AS int) AS string))
            ELSE concat(cast(cast(l_quantity AS int) AS string), '.5') END AS online_salable_qty_quantity,
       concat(' S', cast(l_suppkey AS string)) AS sku_oms_details_sap_supplier_id
FROM {lineitem} WHERE l_linestatus = 'O' AND l_returnflag = 'N' AND l_partkey % 5 <> 0
""",
    "feed_v": """
SELECT l_orderkey * 10 + l_linenumber AS row_id,
       concat(' ACC', cast(l_suppkey % 9 AS string)) AS account,
       concat('sku-', cast(l_partkey AS string)) AS supplier_sku,
       CASE WHEN l_orderkey % 13 = 0 THEN 'abc'
            WHEN l_orderkey % 4 = 0 THEN '0'
            ELSE cast(cast(l_quantity AS int) AS string) END AS free_stock
FROM {lineitem} WHERE l_linestatus = 'F' AND l_returnflag = 'R' AND l_partkey % 7 <> 0
""",
    "stock_wh": """
SELECT l_orderkey * 10 + l_linenumber AS row_id,
       concat(' p-', cast(l_partkey AS string)) AS sku,
       concat('s', cast(l_suppkey % 10 AS string)) AS account,
       l_quantity - 5 AS qty
FROM {lineitem} WHERE l_linestatus = 'O'
""",
    "stock_ecom": """
SELECT l_orderkey * 10 + l_linenumber AS row_id,
       concat('P-', cast(l_partkey AS string), ' ') AS sku,
       concat('S', cast(l_suppkey % 10 AS string)) AS account,
       CASE WHEN l_orderkey % 6 = 0 THEN NULL ELSE l_quantity - 5 END AS qty
FROM {lineitem} WHERE l_linestatus = 'F'
""",
    "inventory": """
SELECT p_brand AS Account, concat('SKU', cast(p_partkey AS string)) AS SupplierSKU,
       CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size END AS FreeStock
FROM {part} WHERE p_partkey % 10 <> 0
""",
    "inventory_latest": """
SELECT p_brand AS Account, concat('SKU', cast(p_partkey AS string)) AS SupplierSKU,
       CASE WHEN p_partkey % 19 = 0 THEN NULL
            WHEN p_partkey % 4 = 0 THEN 0
            WHEN p_partkey % 3 = 0 THEN p_size + 1
            ELSE p_size END AS FreeStock
FROM {part} WHERE p_partkey % 8 <> 1
""",
    "order_items": """
SELECT l_orderkey AS order_fk, l_linenumber AS line_reference,
       concat('P', cast(l_partkey AS string)) AS part_number,
       cast(l_quantity AS int) AS quantity,
       l_extendedprice AS subtotal, l_extendedprice * l_tax AS tax, l_tax AS tax_rate,
       l_shipdate AS promised_date
FROM {lineitem}
""",
    "products": """
SELECT concat('P', cast(p_partkey AS string)) AS part_number, p_name AS short_description,
       p_brand AS brand_name, p_type AS category_name,
       p_partkey % 100 AS vendor_id, p_retailprice AS msrp
FROM {part}
""",
    "prices": """
SELECT concat('P', cast(l_partkey AS string)) AS part_number,
       cast(l_shipdate AS date) AS effective_date,
       max(l_extendedprice / l_quantity) AS retail_price
FROM {lineitem} GROUP BY 1, 2
""",
    "product_media": """
SELECT l_orderkey * 10 + l_linenumber AS media_id,
       concat('P', cast(l_partkey AS string)) AS part_number,
       CASE WHEN l_linenumber % 3 = 0 THEN 'youtube' ELSE 'image' END AS media_type,
       concat('http://m/', cast(l_orderkey AS string), '/', cast(l_linenumber AS string)) AS url,
       cast(l_linenumber AS int) AS position
FROM {lineitem}
""",
    # Derived beyond FIXTURES.md: a product master with JSON text columns and
    # falsy values, built from `products` (runs unchanged on both engines).
    "products_m2": """
SELECT part_number AS sku,
       CASE WHEN vendor_id % 10 = 0 THEN NULL ELSE short_description END AS name,
       vendor_id % 5 AS attribute_set_id,
       concat('{{"rrp":', cast(msrp AS string), '}}') AS price,
       vendor_id % 2 = 0 AS status,
       CASE WHEN vendor_id % 3 = 0 THEN NULL ELSE 2 END AS visibility,
       CASE WHEN vendor_id % 4 = 0 THEN '' ELSE 'simple' END AS type_id,
       CASE WHEN vendor_id % 6 = 0 THEN NULL ELSE msrp / 1000 END AS weight,
       brand_name AS brand,
       concat('{{"brand":"', brand_name, '","category":"', category_name, '"}}') AS custom_attributes,
       '{{"website_ids":[1]}}' AS extension_attributes,
       concat('["http://img/', part_number, '/1.jpg","http://img/', part_number, '/2.jpg"]') AS image_urls
FROM {products}
""",
    # Documents with emoji, a Unicode dash, loose brackets, blank-line runs and
    # a Markdown rule spliced in (the raw corpus has none of these).
    "docs_spliced": """
SELECT doc_id,
       concat(text, ' 😀 — x', chr(10), '  (  spaced ) [ ]  ,  end ', chr(10), chr(10), chr(10), chr(10),
              '---', chr(10), 'a - b -c', chr(10)) AS text
FROM {documents}
""",
    "category_nodes": """
SELECT 0 AS category_id, 'Root' AS name, cast(NULL AS int) AS parent_id
UNION ALL SELECT 1 + r_regionkey, r_name, 0 FROM {region}
UNION ALL SELECT 100 + n_nationkey, n_name, 1 + n_regionkey FROM {nation}
""",
}

def base_tables(name: str) -> list[str]:
    """Placeholder names in a fixture body (literal braces are doubled)."""
    return sorted({f for _, f, _, _ in string.Formatter().parse(FIXTURE_SQL[name]) if f})


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Build fixture ``name`` as a Spark DataFrame over the tables in sf_dir
    (placeholders naming another fixture resolve to that fixture)."""
    text = FIXTURE_SQL[name]
    dfs = {t: fixture(spark, sf_dir, t) if t in FIXTURE_SQL else table(spark, sf_dir, t)
           for t in base_tables(name)}
    return spark.sql(text, **dfs)


def oracle_body(name: str) -> str:
    """Fixture body with plain view names (for the DuckDB oracle)."""
    return FIXTURE_SQL[name].format(**{t: t for t in base_tables(name)}).strip()


def with_fixtures(sql: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``sql`` with ``WITH name AS (...)`` for each fixture used, then
    any extra CTEs (in order)."""
    parts = [f"{n} AS (\n{oracle_body(n)}\n)" for n in names]
    for k, v in (extra or {}).items():
        parts.append(f"{k} AS (\n{v.strip()}\n)")
    if not parts:
        return sql.strip()
    return "WITH " + ",\n".join(parts) + "\n" + sql.strip()
