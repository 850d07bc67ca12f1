"""Sources.

File readers return DataFrames; readers that can reject rows return a
``(valid, rejected)`` pair instead of logging and skipping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerline.functions.scalars import strict_int, strip_ws
from ledgerline.sources.headers import EXTRA, header_groups, named, put_together, read_group
from ledgerline.sources.infer import inferred_types, typed

# Cell texts read as missing by the typed feed reader, fixed values.
NA_TOKENS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
             "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def csv_header(spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "UTF-8",
               multi_line: bool = False) -> list[str]:
    """Column names of all files' headers, in the order in which they come up."""
    groups = header_groups(spark, path, sep, encoding, multi_line)
    return list(dict.fromkeys(n for names, _ in groups for n in names))


def _text_rows(spark: SparkSession, path: str | list[str], sep: str, encoding: str, multi_line: bool,
               with_file: bool = False) -> DataFrame:
    """All-text rows of all files, by column name, and ``_extra``, which only
    rows with more cells than their file's header fill. Empty cells stay empty,
    missing ones (also of columns that a file lacks) are null."""
    groups = header_groups(spark, path, sep, encoding, multi_line)
    if not groups:
        raise ValueError(f"no file with a header row in {path}")
    parts = []
    for names, files in groups:
        rows = read_group(spark, names, files, sep, encoding, multi_line)
        if with_file:
            rows = rows.select("*", F.col("_metadata.file_path").alias("file_path"),
                               F.col("_metadata.file_modification_time").alias("file_mtime"))
        parts.append(rows)
    return put_together(parts)


def read_csv_strings(spark: SparkSession, path: str | list[str], sep: str = ",", encoding: str = "UTF-8",
                     cut_long_rows: bool = False, multi_line: bool = False) -> DataFrame:
    """A1: all-string CSV scan with header rows; a BOM is tolerated, short
    rows are padded, over-long rows are skipped (or cut with
    ``cut_long_rows``), and null cells become empty text. Files may have other
    column orders or columns: cells go by their file's header."""
    rows = _text_rows(spark, path, sep, encoding, multi_line)
    if not cut_long_rows:
        rows = rows.where(F.col(EXTRA).isNull())
    return rows.drop(EXTRA).na.fill("")


def read_csv_raw(spark: SparkSession, path: str | list[str], sep: str = ",", multi_line: bool = False) -> DataFrame:
    """All-string CSV scan that keeps empty cells as empty text and marks
    missing cells of short rows as null (input of B6); cells beyond the header
    are ignored."""
    return _text_rows(spark, path, sep, "UTF-8", multi_line).drop(EXTRA)


def read_feed_csv(spark: SparkSession, path: str | list[str], sep: str = ",", with_file: bool = False,
                  multi_line: bool = False) -> DataFrame:
    """A2: every column as text; rows with more cells than their file's header
    are skipped (short rows are kept, padded with null); NA tokens -> null.
    ``with_file`` adds the source path and modification time."""
    rows = _text_rows(spark, path, sep, "UTF-8", multi_line, with_file)
    rows = rows.where(F.col(EXTRA).isNull()).drop(EXTRA)
    return rows.select(*[named(n) if with_file and n in ("file_path", "file_mtime") else not_available(named(n)).alias(n)
                         for n in rows.columns])


def not_available(cell: Column) -> Column:
    """The cell, null for a text that means a missing value."""
    return F.when(cell.isin(*NA_TOKENS), F.lit(None)).otherwise(cell)


def read_csv_inferred(spark: SparkSession, path: str | list[str], text_cols=(), sep: str = ",",
                      multi_line: bool = False) -> DataFrame:
    """A3: every column in the narrowest type that holds all its cells (see
    ``sources.infer``), found in one scan of the files; ``text_cols`` stay text
    in any case. Cells that mean a missing value are null."""
    rows = read_feed_csv(spark, path, sep, multi_line=multi_line)
    return typed(rows, inferred_types(rows, keep_text=text_cols))


def read_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A4: whole-table scan (column pruning and filters push into the scan)."""
    return spark.read.format(fmt).load(path)


def read_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Files with their content (path, modificationTime, length, content)."""
    r = spark.read.format("binaryFile")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path)


def newest_file(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """The newest file matching ``glob`` by modification time (one row;
    an empty result means no file matched). Content is not read."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
             .select("path", "modificationTime", "length"))
    return files.agg(F.max_by("path", F.struct("modificationTime", "path")).alias("path"),
                     F.max("modificationTime").alias("modificationTime"),
                     F.count(F.lit(1)).alias("matched")).where(F.col("matched") > 0)


def newest_path(spark: SparkSession, path: str, glob: str) -> str:
    """Path of the newest matching file; raises when none matches
    (collects the single aggregated row only)."""
    row = newest_file(spark, path, glob).first()
    if row is None:
        raise FileNotFoundError(f"no file matches {glob} in {path}")
    return row["path"]


# Product CSV columns in export order, fixed values.
PRODUCT_COLUMNS = ["attribute_set_id", "average_rating", "brand", "bulk_discounts", "categories", "created_at",
                   "custom_attributes", "description", "dimensions", "extension_attributes",
                   "fulfillment_centers", "image_urls", "in_stock", "inventory", "name", "price",
                   "related_products", "review_count", "shipping_zones", "sku", "status", "tax_class", "type_id",
                   "updated_at", "vendor", "vendor_promotion", "visibility", "weight"]


def read_product_csv(spark: SparkSession, path: str) -> DataFrame:
    """Product CSV: the named columns (absent ones null), rows with a
    blank SKU skipped, SKU stripped. Cells may hold line breaks; cells beyond
    the header are ignored."""
    raw = read_csv_strings(spark, path, cut_long_rows=True, multi_line=True)
    have = set(raw.columns)
    cols = [F.col(c) if c in have else F.lit(None).cast("string").alias(c) for c in PRODUCT_COLUMNS]
    out = raw.select(*cols).withColumn("sku", strip_ws("sku"))
    return out.where(F.col("sku") != "")


def read_sku_qty_csv(spark: SparkSession, path: str, sku_col: str, qty_col: str,
                     multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected). SKU stripped and required; quantity must
    be an integer text; a blank quantity is 0, a missing cell is rejected."""
    raw = read_csv_raw(spark, path, multi_line=multi_line)
    sku = strip_ws(F.coalesce(F.col(sku_col), F.lit("")))
    q = F.col(qty_col)
    qty = F.when(q.isNull(), F.lit(None)).when(strip_ws(q) == "", F.lit(0).cast("bigint")).otherwise(strict_int(q))
    checked = raw.select(sku.alias("_sku"), qty.alias("_qty"), *[named(c) for c in raw.columns])
    ok = (F.col("_sku") != "") & F.col("_qty").isNotNull()
    valid = checked.where(ok).select(F.col("_sku").alias("sku"), F.col("_qty").alias("qty"))
    rejected = checked.where(~ok).select(*[named(c) for c in raw.columns], F.when(F.col("_sku") == "", F.lit("empty sku"))
                                         .otherwise(F.lit("bad quantity")).alias("reason"))
    return valid, rejected


def read_json_documents(spark: SparkSession, path: str, whole_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """JSON documents (one per file, or one per line) as VARIANT;
    returns (parsed with ``v``, rejected with the raw text)."""
    raw = spark.read.text(path, wholetext=whole_file).select(
        F.col("value").alias("raw"), F.col("_metadata.file_path").alias("file_path"))
    parsed = raw.select("*", F.try_parse_json("raw").alias("v"))
    return parsed.where(F.col("v").isNotNull()), parsed.where(F.col("v").isNull()).drop("v")
