"""Registered queries: catalogue view, attribute mapping, payloads, routing,
typed attributes, category trees, search, sort and paging
(E7-E9, E11, G6-G9, G11-G14, K7, D2, D9, D10, H5, H6, J5-J7, J9, A6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerline.operators import catalog as C
from ledgerline.plans.fixtures import fixture, with_fixtures
from ledgerline.plans.registry import in_order, register
from ledgerline.session import table
from ledgerline.sources.readers import PRODUCT_COLUMNS, read_csv_raw

# ---------------------------------------------------------------------------
# E8 / E9 / G6


@register("e8_latest_price", "E8/H8", with_fixtures("""
SELECT part_number, effective_date, retail_price FROM (
  SELECT *, row_number() OVER (PARTITION BY part_number ORDER BY effective_date DESC) AS rn FROM prices)
WHERE rn = 1""", "prices"))
def e8(spark, sf):
    return C.latest_per_key(fixture(spark, sf, "prices"), "part_number", "effective_date")


_MEDIA_SQL = """
SELECT part_number,
       first(url ORDER BY position, media_id, url) FILTER (WHERE media_type = 'image') AS image_main_url,
       first(url ORDER BY position, media_id, url) FILTER (WHERE media_type = 'youtube') AS youtube_url
FROM product_media GROUP BY part_number"""


@register("e9_first_media", "E9/H8", with_fixtures(_MEDIA_SQL, "product_media"))
def e9(spark, sf):
    return C.first_media(fixture(spark, sf, "product_media"))


def vendors(spark, sf):
    """Vendor dimension: supplier with its nation name."""
    s = table(spark, sf, "supplier")
    n = table(spark, sf, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey, "left").select(
        F.col("s_suppkey").alias("vendor_id"), F.col("s_name").alias("vendor_name"),
        F.col("n_name").alias("vendor_country"))


@register("g6_catalog_view", "G6/E7", with_fixtures("""
SELECT p.part_number, p.short_description, p.brand_name, p.category_name, p.vendor_id, p.msrp,
       v.vendor_name, v.vendor_country, m.image_main_url, m.youtube_url, lp.effective_date, lp.retail_price
FROM products p
LEFT JOIN (SELECT s_suppkey AS vendor_id, s_name AS vendor_name, n_name AS vendor_country
           FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey) v ON p.vendor_id = v.vendor_id
LEFT JOIN media m ON p.part_number = m.part_number
LEFT JOIN (SELECT part_number, effective_date, retail_price FROM (
             SELECT *, row_number() OVER (PARTITION BY part_number ORDER BY effective_date DESC) AS rn
             FROM prices) WHERE rn = 1) lp ON p.part_number = lp.part_number
""", "products", "prices", "product_media", extra={"media": _MEDIA_SQL}))
def g6(spark, sf):
    v = vendors(spark, sf)
    out = C.catalog_view(fixture(spark, sf, "products"), v, fixture(spark, sf, "product_media"),
                         fixture(spark, sf, "prices"))
    return out.select("part_number", "short_description", "brand_name", "category_name", "vendor_id", "msrp",
                      "vendor_name", "vendor_country", "image_main_url", "youtube_url", "effective_date",
                      "retail_price")


# ---------------------------------------------------------------------------
# E11 / J9 label -> value

_BRAND_OPTIONS = """
SELECT DISTINCT p_brand AS label, concat('opt-', substr(p_brand, 7)) AS value FROM part
WHERE p_brand NOT LIKE 'Brand#1%'
UNION ALL
SELECT DISTINCT p_brand AS label, '' AS value FROM part WHERE p_brand LIKE 'Brand#2%'
"""


def brand_options(spark, sf):
    p = table(spark, sf, "part")
    good = p.where(~F.col("p_brand").like("Brand#1%")).select(
        F.col("p_brand").alias("label"), F.concat(F.lit("opt-"), F.substring("p_brand", 7, 1 << 20)).alias("value"))
    empty = p.where(F.col("p_brand").like("Brand#2%")).select(F.col("p_brand").alias("label"),
                                                              F.lit("").alias("value"))
    return good.distinct().unionByName(empty.distinct())


def _e11_sql(keep):
    mapped = "coalesce(o.value, p.brand_name)" if keep else "o.value"
    return with_fixtures(f"""
SELECT p.part_number, p.short_description, {mapped} AS brand_name, p.category_name, p.vendor_id, p.msrp
FROM products p LEFT JOIN (SELECT label, min(value) AS value FROM opts WHERE label <> '' AND value <> ''
                           GROUP BY label) o ON p.brand_name = o.label
""", "products", extra={"opts": _BRAND_OPTIONS})


@register("e11_map_single", "E11/J9", _e11_sql(True))
def e11(spark, sf):
    return C.map_single(fixture(spark, sf, "products"), "brand_name", brand_options(spark, sf))


@register("e11_map_single_drop_unmapped", "E11", _e11_sql(False))
def e11d(spark, sf):
    return C.map_single(fixture(spark, sf, "products"), "brand_name", brand_options(spark, sf),
                        keep_unmapped=False)


def color_options(spark, sf):
    """Options for the words of part names: words before 'm' map to upper case."""
    w = table(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("label")).distinct()
    return w.where(F.col("label") < "m").select("label", F.upper("label").alias("value"))


@register("e11_map_multi", "E11/J8", with_fixtures("""
SELECT part_number, array_to_string(list(coalesce(o.value, w.word) ORDER BY w.pos), '|') AS mapped
FROM (SELECT part_number, unnest(string_split(short_description, ' ')) AS word,
             generate_subscripts(string_split(short_description, ' '), 1) AS pos FROM products) w
LEFT JOIN (SELECT DISTINCT label, upper(label) AS value FROM
             (SELECT unnest(string_split(p_name, ' ')) AS label FROM part) WHERE label < 'm') o
  ON w.word = o.label
GROUP BY part_number
""", "products"))
def e11m(spark, sf):
    p = fixture(spark, sf, "products").select("part_number", F.split("short_description", " ").alias("words"))
    out = C.map_multi(p, "part_number", "words", color_options(spark, sf))
    return out.select("part_number", F.array_join("words", "|").alias("mapped"))


# ---------------------------------------------------------------------------
# G7 / G8 / H5 / H6 / D2 / G11 over the product master


@register("g7_product_import_payload", "G7/J8/C14/C15")
def g7(spark, sf):
    return C.product_import_payload(fixture(spark, sf, "products_m2"))


# Vendor feed column order (subset of the product master), fixed values.
FEED_COLUMNS = ["attribute_set_id", "brand", "custom_attributes", "extension_attributes", "image_urls",
                "name", "price", "sku", "status", "type_id", "visibility", "weight"]


@register("g8_vendor_feed", "G8/M1", with_fixtures("""
SELECT CAST(attribute_set_id AS VARCHAR) AS attribute_set_id, coalesce(brand, '') AS brand,
       coalesce(custom_attributes, '') AS custom_attributes, coalesce(extension_attributes, '') AS extension_attributes,
       coalesce(image_urls, '') AS image_urls, coalesce(name, '') AS name, coalesce(price, '') AS price, sku,
       CASE WHEN status THEN 'True' ELSE 'False' END AS status, coalesce(type_id, '') AS type_id,
       coalesce(CAST(visibility AS VARCHAR), '') AS visibility, coalesce(CAST(weight AS VARCHAR), '') AS weight
FROM products_m2""", "products", "products_m2"))
def g8(spark, sf):
    return C.vendor_feed(fixture(spark, sf, "products_m2"), FEED_COLUMNS, bool_cols=("status",))


@register("d2_search_products", "D2", with_fixtures("""
SELECT * FROM products_m2 WHERE lower(coalesce(sku, '')) LIKE '%blue%' OR lower(coalesce(name, '')) LIKE '%blue%'
   OR lower(coalesce(brand, '')) LIKE '%blue%'""", "products", "products_m2"))
def d2(spark, sf):
    return C.search_products(fixture(spark, sf, "products_m2"), "Blue")


@register("h5_sort_by_price", "H5", with_fixtures("""
SELECT sku, price, row_number() OVER (ORDER BY TRY_CAST(json_extract_string(price, '$.rrp') AS DOUBLE) DESC NULLS FIRST, sku) AS position
FROM products_m2""", "products", "products_m2"))
def h5(spark, sf):
    return in_order(C.sort_products(fixture(spark, sf, "products_m2"), "price", descending=True).select("sku", "price"))


PAGE_NO, PAGE_SIZE = 3, 100


@register("h6_page", "H6", with_fixtures(f"""
SELECT sku, name, price FROM (SELECT *, row_number() OVER (ORDER BY sku) AS rn FROM products_m2)
WHERE rn > {PAGE_NO * PAGE_SIZE} AND rn <= {(PAGE_NO + 1) * PAGE_SIZE}""", "products", "products_m2"))
def h6(spark, sf):
    m2 = fixture(spark, sf, "products_m2").select("sku", "name", "price")
    return C.page(m2, ["sku"], PAGE_NO, PAGE_SIZE)


@register("h6_page_count", "H6", with_fixtures(
    f"SELECT CAST(greatest(1, ceil(count(*) / {PAGE_SIZE})) AS BIGINT) AS pages FROM products_m2",
    "products", "products_m2"))
def h6c(spark, sf):
    return C.page_count(fixture(spark, sf, "products_m2"), PAGE_SIZE)


@register("g11_route_create_update", "G11", with_fixtures("""
SELECT m.*, CASE WHEN e.part_number IS NOT NULL THEN 'update' ELSE 'create' END AS action
FROM products_m2 m LEFT JOIN (SELECT DISTINCT part_number FROM products WHERE msrp > 1500) e
  ON m.sku = e.part_number""", "products", "products_m2"))
def g11(spark, sf):
    existing = fixture(spark, sf, "products").where(F.col("msrp") > 1500).select(F.col("part_number").alias("sku"))
    return C.route_create_update(fixture(spark, sf, "products_m2"), existing, "sku")


# ---------------------------------------------------------------------------
# G9 / G12 / G13 payloads


def product_form_rows(spark, sf):
    """Product form rows from the product master: price / quantity as text,
    website list with junk items, attributes with empty values, category ids
    with non-digit entries, a description on every other attribute set."""
    m2 = fixture(spark, sf, "products_m2")
    return m2.select(
        "sku", "name",
        F.get_json_object("price", "$.rrp").alias("price_text"),
        F.col("attribute_set_id").cast("string").alias("qty_text"),
        F.when(F.col("status"), F.lit(1)).otherwise(F.lit(2)).alias("status_code"),
        F.coalesce(F.col("visibility"), F.lit(4)).alias("visibility_code"),
        F.lit("simple").alias("type_id"),
        F.lit("1, 2,x,").alias("websites_text"),
        (F.col("attribute_set_id") + 1).alias("attribute_set_id"),
        F.when(F.col("attribute_set_id") % 2 == 0, F.concat(F.lit("About "), F.col("sku"))).alias("description"),
        F.array(F.struct(F.lit("brand").alias("attribute_code"), F.col("brand").alias("value")),
                F.struct(F.lit("label").alias("attribute_code"),
                         F.when(F.col("attribute_set_id") == 1, F.lit("")).otherwise(F.col("type_id")).alias("value")))
        .alias("custom_attributes"),
        F.array(F.substring("sku", 2, 3), F.lit("n/a")).alias("category_ids"))


def product_payloads(spark, sf):
    """Payloads of the product form rows."""
    return C.build_product_payload(product_form_rows(spark, sf)).select(
        F.col("sku").alias("payload_key"), "payload")


register("g9_product_payload", "G9")(product_payloads)


@register("g13_extract_draft", "G13/G9", with_fixtures("""
SELECT sku, coalesce(name, sku) AS name, TRY_CAST(json_extract_string(price, '$.rrp') AS DOUBLE) AS price,
       CASE WHEN status THEN 1 ELSE 2 END AS status, coalesce(visibility, 4) AS visibility, 'simple' AS type_id,
       CASE WHEN attribute_set_id % 2 = 0 THEN concat('About ', sku) END AS description
FROM products_m2""", "products", "products_m2"))
def g13(spark, sf):
    return C.extract_draft(product_payloads(spark, sf))


def entity_payloads(spark, sf):
    """Mixed JSON payloads: products, categories, attribute sets, texts of
    an unknown shape and broken JSON (from pages)."""
    m2 = fixture(spark, sf, "products_m2").select(
        F.to_json(F.struct(F.struct("sku", "name").alias("product"))).alias("payload"))
    cats = fixture(spark, sf, "category_nodes").select(
        F.to_json(F.struct(F.struct(F.col("category_id").alias("id"), "name").alias("category"))).alias("payload"))
    sets = table(spark, sf, "part").select(F.col("p_size").alias("attribute_set_id")).distinct().select(
        F.to_json(F.struct(F.struct("attribute_set_id").alias("attributeSet"))).alias("payload"))
    unknown = table(spark, sf, "events").select(F.col("props").alias("payload"))
    broken = table(spark, sf, "pages").select(F.concat(F.lit('{"product": '), F.col("url")).alias("payload"))
    return m2.unionByName(cats).unionByName(sets).unionByName(unknown).unionByName(broken)


@register("g12_route_entities", "G12/A11", with_fixtures("""
SELECT 'product' AS kind, sku AS entity_key FROM products_m2
UNION ALL SELECT 'category', CAST(category_id AS VARCHAR) FROM category_nodes
UNION ALL SELECT 'attribute_set', CAST(p_size AS VARCHAR) FROM (SELECT DISTINCT p_size FROM part)
UNION ALL SELECT 'error:unknown_shape', NULL FROM events
UNION ALL SELECT 'error:invalid_json', NULL FROM pages
""", "products", "products_m2", "category_nodes"))
def g12(spark, sf):
    return C.route_entities(entity_payloads(spark, sf)).select("kind", "entity_key")


# ---------------------------------------------------------------------------
# G14 / K7 / D10 typed attributes

_EAV = """
SELECT part_number, 'size' AS attribute_code, CAST(NULL AS VARCHAR) AS value_text, CAST(p_size AS BIGINT) AS value_int,
       CAST(NULL AS DOUBLE) AS value_decimal FROM products JOIN part ON part_number = concat('P', CAST(p_partkey AS VARCHAR))
UNION ALL
SELECT part_number, 'brand', CASE WHEN vendor_id % 13 = 0 THEN NULL ELSE brand_name END, NULL, NULL FROM products
UNION ALL
SELECT part_number, 'price', NULL, NULL, msrp FROM products WHERE vendor_id % 7 <> 0
UNION ALL
SELECT part_number, 'color', upper(split_part(short_description, ' ', 1)), NULL, NULL FROM products
"""


def eav(spark, sf):
    p = fixture(spark, sf, "products")
    part = table(spark, sf, "part")
    nul_s, nul_i, nul_d = F.lit(None).cast("string"), F.lit(None).cast("bigint"), F.lit(None).cast("double")
    size = p.join(part, p.part_number == F.concat(F.lit("P"), part.p_partkey.cast("string"))).select(
        "part_number", F.lit("size").alias("attribute_code"), nul_s.alias("value_text"),
        F.col("p_size").cast("bigint").alias("value_int"), nul_d.alias("value_decimal"))
    brand = p.select("part_number", F.lit("brand"),
                     F.when(F.col("vendor_id") % 13 == 0, nul_s).otherwise(F.col("brand_name")), nul_i, nul_d)
    price = p.where(F.col("vendor_id") % 7 != 0).select("part_number", F.lit("price"), nul_s, nul_i, F.col("msrp"))
    color = p.select("part_number", F.lit("color"), F.upper(F.split_part("short_description", F.lit(" "), F.lit(1))),
                     nul_i, nul_d)
    return size.union(brand).union(price).union(color)


ATTRS = {"size": ("value_int", "bigint"), "brand": ("value_text", "string"),
         "price": ("value_decimal", "double"), "color": ("value_text", "string")}


@register("g14_pivot_attributes", "G14", with_fixtures("""
SELECT part_number,
       max(CASE WHEN attribute_code = 'size' THEN value_int END) AS size,
       max(CASE WHEN attribute_code = 'brand' THEN value_text END) AS brand,
       max(CASE WHEN attribute_code = 'price' THEN value_decimal END) AS price,
       max(CASE WHEN attribute_code = 'color' THEN value_text END) AS color
FROM eav GROUP BY part_number""", "products", extra={"eav": _EAV}))
def g14(spark, sf):
    return C.pivot_attributes(eav(spark, sf), "part_number", ATTRS)


_EAV_OPTIONS = "SELECT *, CAST(NULL AS BIGINT) AS option_id FROM eav WHERE attribute_code <> 'brand' UNION ALL " \
    "SELECT part_number, 'brand', NULL, NULL, NULL, CAST(vendor_id % 12 AS BIGINT) FROM products"
_OPTIONS = "SELECT DISTINCT CAST(vendor_id % 12 AS BIGINT) AS option_id, concat('Option ', CAST(vendor_id % 12 AS VARCHAR)) AS value " \
    "FROM products WHERE vendor_id % 12 < 10"


@register("g14_pivot_options", "G14", with_fixtures("""
SELECT part_number, max(CASE WHEN attribute_code = 'size' THEN value_int END) AS size,
       max(CASE WHEN attribute_code = 'brand' THEN o.value END) AS brand,
       max(CASE WHEN attribute_code = 'price' THEN value_decimal END) AS price,
       max(CASE WHEN attribute_code = 'color' THEN value_text END) AS color
FROM eav_o LEFT JOIN options o ON o.option_id = eav_o.option_id GROUP BY part_number""", "products",
    extra={"eav": _EAV, "eav_o": _EAV_OPTIONS, "options": _OPTIONS}))
def g14_options(spark, sf):
    """Brands as option ids; two of the ids are in no option."""
    p = fixture(spark, sf, "products")
    number = (F.col("vendor_id") % 12).cast("bigint")
    rows = eav(spark, sf).where("attribute_code <> 'brand'").withColumn("option_id", F.lit(None).cast("bigint")).unionByName(
        p.select("part_number", F.lit("brand").alias("attribute_code"), number.alias("option_id")), allowMissingColumns=True)
    options = p.where(F.col("vendor_id") % 12 < 10).select(
        number.alias("option_id"), F.concat(F.lit("Option "), number.cast("string")).alias("value"))
    return C.pivot_attributes(rows, "part_number", ATTRS | {"brand": ("option_id", "string")}, options)


def required_attributes(spark, sf):
    """Required attributes per category: everything needs brand and price,
    brass types also need a color."""
    cats = fixture(spark, sf, "products").select("category_name").distinct()
    base = cats.select("category_name", F.explode(F.array(F.lit("brand"), F.lit("price"))).alias("attribute_code"))
    brass = cats.where(F.col("category_name").contains("BRASS")).select("category_name",
                                                                          F.lit("color").alias("attribute_code"))
    return base.unionByName(brass)


@register("k7_missing_required", "K7", with_fixtures("""
SELECT p.part_number, p.category_name, r.attribute_code FROM products p
JOIN (SELECT category_name, unnest(['brand', 'price']) AS attribute_code FROM (SELECT DISTINCT category_name FROM products)
      UNION ALL SELECT DISTINCT category_name, 'color' FROM products WHERE category_name LIKE '%BRASS%') r
  ON p.category_name = r.category_name
WHERE NOT EXISTS (SELECT 1 FROM eav e WHERE e.part_number = p.part_number AND e.attribute_code = r.attribute_code
                  AND coalesce(e.value_text, CAST(e.value_int AS VARCHAR), CAST(e.value_decimal AS VARCHAR)) IS NOT NULL)
""", "products", extra={"eav": _EAV}))
def k7(spark, sf):
    e = eav(spark, sf).select("part_number", "attribute_code",
                              F.coalesce("value_text", F.col("value_int").cast("string"),
                                         F.col("value_decimal").cast("string")).alias("value"))
    return C.missing_required(fixture(spark, sf, "products"), required_attributes(spark, sf), e)


_CORE = ", ".join(f"('{c}')" for c in C.CORE_ATTRIBUTES)


def attribute_catalog(spark, sf):
    """Attribute definitions: the words of part types (user defined when the
    word length is even) plus the core attributes (system)."""
    words = table(spark, sf, "part").select(F.explode(F.split(F.lower("p_type"), " ")).alias("attribute_code"))
    words = words.distinct().select("attribute_code", (F.length("attribute_code") % 2 == 0).alias("is_user_defined"))
    core = words.sparkSession.createDataFrame([(c,) for c in C.CORE_ATTRIBUTES], "attribute_code string") \
        .select("attribute_code", F.lit(True).alias("is_user_defined"))
    return words.unionByName(core)


@register("d10_user_attributes", "D10", f"""
SELECT attribute_code, is_user_defined FROM (
  SELECT DISTINCT unnest(string_split(lower(p_type), ' ')) AS attribute_code,
         length(unnest(string_split(lower(p_type), ' '))) % 2 = 0 AS is_user_defined FROM part
  UNION ALL SELECT code, true FROM (VALUES {_CORE}) v(code))
WHERE is_user_defined AND attribute_code NOT IN (SELECT code FROM (VALUES {_CORE}) v(code))""")
def d10(spark, sf):
    return C.user_attributes(attribute_catalog(spark, sf))


# ---------------------------------------------------------------------------
# J5-J7 / D9 / A6 category trees


def tree(spark, sf):
    return C.flatten_tree_rows(spark, fixture(spark, sf, "category_nodes"))


_TREE = """
WITH RECURSIVE t(category_id, name, parent_id, depth, path, ancestors) AS (
  SELECT category_id, name, parent_id, 0, name, [category_id] FROM category_nodes WHERE parent_id IS NULL
  UNION ALL
  SELECT c.category_id, c.name, c.parent_id, t.depth + 1, concat(t.path, '/', c.name),
         list_append(t.ancestors, c.category_id)
  FROM category_nodes c JOIN t ON c.parent_id = t.category_id)
SELECT * FROM t"""


def _tree_sql(select: str, *extra_names, extra=None) -> str:
    body = with_fixtures("SELECT 1", "category_nodes").removesuffix("SELECT 1")
    inner = _TREE.replace("WITH RECURSIVE ", "")
    ctes = ",\n".join(f"{k} AS ({v})" for k, v in (extra or {}).items())
    return body.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + inner.replace("SELECT * FROM t", "").rstrip() \
        + ("\n," + ctes if ctes else "") + "\n" + select


@register("j5_category_tree", "J5", _tree_sql(
    "SELECT category_id, name, parent_id, depth, path, array_to_string(ancestors, '/') AS ancestors FROM t"))
def j5(spark, sf):
    return tree(spark, sf).select("category_id", "name", "parent_id", "depth", "path",
                                  F.array_join("ancestors", "/").alias("ancestors"))


def category_json_trees(spark, sf):
    """The category rows nested into one ``children_data`` JSON tree (built
    bottom-up: nations under regions under the root)."""
    nodes = fixture(spark, sf, "category_nodes")
    nations = nodes.where(F.col("category_id") >= 100).groupBy(F.col("parent_id").alias("_p")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("category_id").alias("id"), "name",
                                             F.array().cast("array<string>").alias("children_data"))))
        .alias("kids"))
    regions = nodes.where((F.col("category_id") > 0) & (F.col("category_id") < 100)) \
        .join(nations, F.col("category_id") == F.col("_p"), "left") \
        .select(F.struct(F.col("category_id").alias("id"), "name",
                         F.coalesce("kids", F.array()).alias("children_data")).alias("r"))
    root = regions.agg(F.array_sort(F.collect_list("r")).alias("kids")).select(
        F.lit(1).alias("tree_id"),
        F.to_json(F.struct(F.lit(0).alias("id"), F.lit("Root").alias("name"),
                           F.col("kids").alias("children_data"))).alias("tree"))
    return root


@register("a6_category_tree_json", "A6/J5", _tree_sql(
    "SELECT CAST(category_id AS VARCHAR) AS id, name, CAST(parent_id AS VARCHAR) AS parent_id, depth, path FROM t"))
def a6(spark, sf):
    flat = C.flatten_tree_json(category_json_trees(spark, sf))
    return flat.select("id", "name", "parent_id", "depth", "path")


D9_QUERY = "tion_1"


@register("d9_category_filter", "D9", _tree_sql(f"""
SELECT category_id, name, parent_id, depth, path FROM t
WHERE category_id IN (SELECT unnest(ancestors) FROM t WHERE lower(name) LIKE '%{D9_QUERY}%')"""))
def d9(spark, sf):
    return C.visible_with_ancestors(tree(spark, sf), D9_QUERY).select("category_id", "name", "parent_id", "depth",
                                                                      "path")


def selected_categories(spark, sf):
    n = fixture(spark, sf, "category_nodes")
    return n.where(((F.col("category_id") >= 100) & (F.col("category_id") % 3 == 0))
                   | ((F.col("category_id") < 100) & (F.col("category_id") % 2 == 0)))


_SELECTED = ("SELECT category_id FROM category_nodes WHERE (category_id >= 100 AND category_id % 3 = 0) "
             "OR (category_id < 100 AND category_id % 2 = 0)")


@register("j6_selected_tree_order", "J6", _tree_sql(
    "SELECT row_number() OVER (ORDER BY ancestors) AS position, CAST(category_id AS BIGINT) AS category_id FROM t "
    "WHERE category_id IN (SELECT category_id FROM sel)", extra={"sel": _SELECTED}))
def j6(spark, sf):
    return C.selected_in_tree_order(tree(spark, sf), selected_categories(spark, sf))


TOGGLE_NODE = 3


@register("j7_toggle_subtree", "J7", _tree_sql(f"""
SELECT category_id, CASE WHEN list_contains(ancestors, {TOGGLE_NODE})
                         THEN {TOGGLE_NODE} NOT IN (SELECT category_id FROM sel)
                         ELSE category_id IN (SELECT category_id FROM sel) END AS selected FROM t""",
    extra={"sel": _SELECTED}))
def j7(spark, sf):
    return C.toggle_subtree(tree(spark, sf), selected_categories(spark, sf), TOGGLE_NODE)


# ---------------------------------------------------------------------------
# C18 / H7 / I7 / G10


@register("c18_line_amount", "C18", with_fixtures(
    "SELECT order_fk, line_reference, quantity, subtotal / quantity AS unit_price, "
    "quantity * (subtotal / quantity) AS line_amount FROM order_items", "order_items"))
def c18(spark, sf):
    from ledgerline.functions.scalars import line_amount
    it = fixture(spark, sf, "order_items").select("order_fk", "line_reference", "quantity",
                                                  (F.col("subtotal") / F.col("quantity")).alias("unit_price"))
    return it.withColumn("line_amount", line_amount("quantity", "unit_price"))


PREVIEW_ROWS = 20


@register("h7_preview", "H7", with_fixtures(
    f"SELECT * FROM stock_wh ORDER BY row_id, sku, account, qty LIMIT {PREVIEW_ROWS}", "stock_wh"))
def h7(spark, sf):
    return fixture(spark, sf, "stock_wh").orderBy("row_id", "sku", "account", "qty").limit(PREVIEW_ROWS)


def product_update_rows(spark, sf):
    """Product CSV rows (all text) derived from the product master: lenient
    booleans, numbers as float text, a bad weight, 'null' JSON, and a second
    (later) row for every fifth product that must win."""
    m2 = fixture(spark, sf, "products_m2")
    first = m2.select(
        F.lit(1).alias("row_no"), "sku", "name",
        F.when(F.col("status"), F.lit(" Yes")).otherwise(F.lit("0")).alias("status"),
        F.when(F.col("attribute_set_id") == 1, F.lit("n/a")).otherwise(F.col("weight").cast("string")).alias("weight"),
        F.concat(F.coalesce(F.col("visibility"), F.lit(4)).cast("string"), F.lit(".0")).alias("visibility"),
        F.when(F.col("attribute_set_id") == 2, F.lit("null")).otherwise(F.col("price")).alias("price"),
        "custom_attributes",
        F.when(F.col("attribute_set_id") == 3, F.lit("TRUE")).otherwise(F.lit("false")).alias("in_stock"))
    second = first.where(F.col("sku").endswith("5")).select(
        F.lit(2).alias("row_no"), "sku", F.concat(F.lit("NEW "), F.coalesce("name", F.lit(""))).alias("name"),
        "status", "weight", "visibility", "price", "custom_attributes", "in_stock")
    return first.unionByName(second)


_I7_ROWS = """
SELECT 1 AS row_no, sku, coalesce(name, '') AS name, status AS st, CASE WHEN attribute_set_id = 1 THEN NULL ELSE weight END AS weight,
       coalesce(visibility, 4) AS visibility, CASE WHEN attribute_set_id = 2 THEN 'null' ELSE price END AS price,
       CAST(json(custom_attributes) AS VARCHAR) AS custom_attributes, attribute_set_id = 3 AS in_stock FROM products_m2
UNION ALL
SELECT 2, sku, concat('NEW ', coalesce(name, '')), status, CASE WHEN attribute_set_id = 1 THEN NULL ELSE weight END,
       coalesce(visibility, 4), CASE WHEN attribute_set_id = 2 THEN 'null' ELSE price END,
       CAST(json(custom_attributes) AS VARCHAR), attribute_set_id = 3 FROM products_m2 WHERE sku LIKE '%5'
"""


_I7_OUT = ["sku", "name", "status", "weight", "visibility", "price", "custom_attributes", "in_stock", "brand",
           "review_count", "bulk_discounts"]


@register("i7_product_upsert", "I7/C8/C9/C10", with_fixtures("""
SELECT sku, name, st AS status, weight, CAST(visibility AS BIGINT) AS visibility, price, custom_attributes, in_stock, '' AS brand,
       CAST(NULL AS BIGINT) AS review_count, '' AS bulk_discounts FROM (
  SELECT *, row_number() OVER (PARTITION BY sku ORDER BY row_no DESC) AS rn FROM rows WHERE sku NOT LIKE '%7') WHERE rn = 1
UNION ALL
SELECT sku, 'stored', true, 1.5, CAST(2 AS BIGINT), '', '', false, 'old', CAST(9 AS BIGINT), '' FROM products_m2
WHERE sku LIKE '%7'""", "products", "products_m2", extra={"rows": _I7_ROWS}))
def i7(spark, sf):
    """Files of update rows with a line number, into a table that holds every
    second product already; products ending in 7 get no update."""
    lines = product_update_rows(spark, sf).where(~F.col("sku").endswith("7")).withColumnRenamed("row_no", "line_no")
    from ledgerline.plans.q_sources import _both_orders, _path
    glob = _both_orders(lines, F.xxhash64("sku", "line_no"), _path(spark, sf, "product_updates"))
    raw = read_csv_raw(spark, glob, multi_line=True).withColumn("line_no", F.col("line_no").cast("int"))
    stored = C.type_product_rows(fixture(spark, sf, "products_m2").where(
        F.col("sku").endswith("7") | F.col("sku").endswith("1") | F.col("sku").endswith("5")).select(
        "sku", F.lit("stored").alias("name"), F.lit("true").alias("status"), F.lit("1.5").alias("weight"), F.lit("2").alias("visibility"),
        F.lit("old").alias("brand"), F.lit("9").alias("review_count")), PRODUCT_COLUMNS)
    return C.upsert_products(stored, raw, PRODUCT_COLUMNS, "line_no").select(*_I7_OUT)


@register("g7_payload_fields", "G7/C14/C15/J8", with_fixtures("""
SELECT sku, CAST(CASE WHEN attribute_set_id = 0 THEN 4 ELSE attribute_set_id END AS BIGINT) AS attribute_set_id,
       TRY_CAST(json_extract_string(price, '$.rrp') AS DOUBLE) AS price,
       CAST(CASE WHEN status THEN 1 ELSE 2 END AS BIGINT) AS status,
       CAST(coalesce(visibility, 4) AS BIGINT) AS visibility,
       CASE WHEN type_id = '' THEN 'simple' ELSE type_id END AS type_id,
       coalesce(weight, 0.0) AS weight, coalesce(name, sku) AS first_label,
       CAST(2 AS BIGINT) AS n_media, 'brand,category' AS attribute_codes
FROM products_m2""", "products", "products_m2"))
def g7f(spark, sf):
    """G7 read back: the JSON lines parsed and compared field by field."""
    v = F.parse_json(F.col("json"))
    media = F.try_variant_get(v, "$.product.media_gallery_entries", "array<variant>")
    attrs = F.try_variant_get(v, "$.product.custom_attributes", "array<variant>")
    return g7(spark, sf).select(
        F.try_variant_get(v, "$.product.sku", "string").alias("sku"),
        F.try_variant_get(v, "$.product.attribute_set_id", "bigint").alias("attribute_set_id"),
        F.try_variant_get(v, "$.product.price", "double").alias("price"),
        F.try_variant_get(v, "$.product.status", "bigint").alias("status"),
        F.try_variant_get(v, "$.product.visibility", "bigint").alias("visibility"),
        F.try_variant_get(v, "$.product.type_id", "string").alias("type_id"),
        F.try_variant_get(v, "$.product.weight", "double").alias("weight"),
        F.try_variant_get(F.element_at(media, 1), "$.label", "string").alias("first_label"),
        F.size(media).cast("bigint").alias("n_media"),
        F.array_join(F.transform(attrs, lambda a: F.try_variant_get(a, "$.attribute_code", "string")), ",")
        .alias("attribute_codes"))
