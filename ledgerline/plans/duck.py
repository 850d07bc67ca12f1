"""Helpers that write DuckDB oracle SQL fragments.

The oracle is an independent statement of each operator's semantics in plain
SQL; these helpers only keep repeated fragments (white-space strip, lenient
quantity) spelled the same way across oracles.
"""

from __future__ import annotations


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def clean_sku(x: str) -> str:
    return f"nullif(upper({strip(x)}), '')"


def parse_qty_stripped(s: str) -> str:
    """Lenient quantity of an already stripped text expression ``s``."""
    body = "trim(replace({inner}, ',', ''))"
    pos = body.format(inner=s)
    neg = body.format(inner=f"substring({s}, 2, length({s}) - 2)")
    return (
        f"CASE WHEN {s} IS NULL OR {s} = '' OR upper({s}) IN ('NULL', 'NAN') THEN CAST(0 AS BIGINT) "
        f"WHEN {s} LIKE '(%)' THEN coalesce(-CAST(round(TRY_CAST({neg} AS DECIMAL(38,10)), 0) AS BIGINT), 0) "
        f"ELSE coalesce(CAST(round(TRY_CAST({pos} AS DECIMAL(38,10)), 0) AS BIGINT), 0) END"
    )


def normalised_feed_ctes(src: str, prefix: str, sku: str, qty: str, attr: str,
                         attr_name: str) -> dict[str, str]:
    """CTEs for F0 over fixture ``src``: ``{prefix}_0`` (row level) and
    ``{prefix}_norm`` (one row per SKU)."""
    return {
        f"{prefix}_0": (
            f"SELECT {clean_sku(sku)} AS sku, {strip(qty)} AS q0, "
            f"{strip(f'CAST({attr} AS VARCHAR)')} AS {attr_name} FROM {src}"
        ),
        f"{prefix}_norm": (
            f"SELECT sku, CAST(sum({parse_qty_stripped('q0')}) AS BIGINT) AS qty, "
            f"min({attr_name}) AS {attr_name} FROM {prefix}_0 WHERE sku IS NOT NULL GROUP BY sku"
        ),
    }


def hnau_ctes() -> dict[str, str]:
    return normalised_feed_ctes("feed_h", "h", "sku_oms_details_sku",
                                "online_salable_qty_quantity",
                                "sku_oms_details_sap_supplier_id", "supplier_id")


def vs_ctes() -> dict[str, str]:
    return normalised_feed_ctes("feed_v", "v", "supplier_sku", "free_stock", "account", "account")


# Unicode white space as a RE2 class (RE2's \s is ASCII only).
WS = r"[\s\x0b\x1c-\x1f\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def splitlines(x: str) -> str:
    """Python ``str.splitlines()`` as a DuckDB list expression."""
    parts = f"regexp_split_to_array({x}, '{LINE_BREAKS}')"
    return (f"(CASE WHEN {x} = '' THEN CAST([] AS VARCHAR[]) "
            f"WHEN regexp_matches({x}, '({LINE_BREAKS})$') THEN {parts}[1:len({parts}) - 1] "
            f"ELSE {parts} END)")


def blank(x: str) -> str:
    return f"(regexp_replace({x}, '{WS}+', '', 'g') = '')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+$', '')"
