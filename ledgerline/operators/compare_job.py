"""The two-sided stock comparison as one job: mapping check
(K1) -> key / quantity normalisation (C3-C5) -> comparison (F2) -> KPIs,
account roll-up, chart counts and subsets (F2k, F2r, F2p, D4, D6) -> optional
CSV / parquet export (M1, M4).

The comparison is computed once; when exported, the outputs are derived from
its written copy instead of recomputing it for every output.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from ledgerline.operators import reconcile as R
from ledgerline.operators.quality import mapping_errors, validate_mapping
from ledgerline.sources.shaping import guess_column


def guess_roles(df: DataFrame) -> tuple:
    """(sku, account, qty) column names guessed from the header."""
    return tuple(guess_column(df.columns, role) for role in ("sku", "account", "qty"))


def run_comparison(spark: SparkSession, wh: DataFrame, ecom: DataFrame, wh_roles: tuple | None = None,
                   ecom_roles: tuple | None = None, *,
                   aggfunc: str = "sum", upper_keys: bool = True, strip_keys: bool = True,
                   clamp_negative: bool = False, order_cols: list[str] | None = None,
                   out_dir: str | None = None, fmt: str = "parquet") -> dict[str, DataFrame]:
    """``*_roles`` are (sku, account, qty) column names of each side (guessed
    from the headers when not given). Raises ``ValueError`` with the mapping
    errors before reading data."""
    wh_roles = wh_roles or guess_roles(wh)
    ecom_roles = ecom_roles or guess_roles(ecom)
    errors = (mapping_errors(wh.columns, "Warehouse", *wh_roles)
              + mapping_errors(ecom.columns, "E-Commerce", *ecom_roles))
    if errors:
        raise ValueError("; ".join(errors))
    opts = dict(upper_keys=upper_keys, strip_keys=strip_keys, clamp=clamp_negative, order_cols=order_cols)
    a = R.normalise_stock(wh, *wh_roles, **opts)
    b = R.normalise_stock(ecom, *ecom_roles, **opts)
    merged = R.compare_sides(a, b, aggfunc)
    if out_dir:
        path = os.path.join(out_dir, "comparison")
        merged.write.mode("overwrite").parquet(path)
        merged = spark.read.parquet(path)
    outputs = {
        "comparison": merged,
        "kpis": R.compare_kpis(merged),
        "by_account": R.rollup_by_account(merged),
        "status_counts": R.value_counts(merged, "status"),
        "presence_counts": R.value_counts(merged, "source_status"),
        "mismatches": R.comparison_subset(merged, "mismatch"),
        "instock_wh_oos_ecom": R.comparison_subset(merged, "instock_wh_oos_ecom"),
        "instock_ecom_oos_wh": R.comparison_subset(merged, "instock_ecom_oos_wh"),
        "warnings_wh": validate_mapping(wh, *wh_roles, upper_keys=upper_keys, strip_keys=strip_keys),
        "warnings_ecom": validate_mapping(ecom, *ecom_roles, upper_keys=upper_keys, strip_keys=strip_keys),
    }
    if out_dir:
        for name, df in outputs.items():
            if name == "comparison":
                continue
            w = df.write.mode("overwrite")
            (w.option("header", True).csv if fmt == "csv" else w.parquet)(os.path.join(out_dir, name))
    return outputs
