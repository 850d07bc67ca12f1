"""Data-quality checks.

Each audit is a distributed aggregation or anti/semi join that returns the
violations (or their counts) as a DataFrame; nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.scalars import normalise_key


def _flag(cond: Column) -> Column:
    return F.when(cond, 1).otherwise(0)


def validate_mapping(df: DataFrame, sku: str, account: str, qty: str, *,
                     upper_keys: bool = True, strip_keys: bool = True) -> DataFrame:
    """K1: one row of counts for a side of a comparison.

    Counted in two aggregation levels (per normalised key group, then
    overall), so duplicate key groups need no second scan: empty keys, duplicate
    key groups, non-numeric quantities and negative quantities."""
    k_sku = normalise_key(sku, strip_keys, upper_keys)
    k_acc = normalise_key(account, strip_keys, upper_keys)
    q = F.col(qty).try_cast("double")
    per_group = (
        df.select(F.coalesce(k_sku, F.lit("")).alias("_s"), F.coalesce(k_acc, F.lit("")).alias("_a"),
                  _flag(F.col(sku).isNull()).alias("_ns"), _flag(F.col(account).isNull()).alias("_na"),
                  _flag(q.isNull()).alias("_bq"), _flag(q < 0).alias("_nq"))
        .groupBy("_s", "_a")
        .agg(F.count(F.lit(1)).alias("_n"), F.sum("_ns").alias("_ns"), F.sum("_na").alias("_na"),
             F.sum("_bq").alias("_bq"), F.sum("_nq").alias("_nq"))
    )
    return per_group.agg(
        F.coalesce(F.sum("_ns"), F.lit(0)).cast("bigint").alias("null_sku"),
        F.coalesce(F.sum("_na"), F.lit(0)).cast("bigint").alias("null_account"),
        F.coalesce(F.sum("_bq"), F.lit(0)).cast("bigint").alias("bad_qty"),
        F.coalesce(F.sum("_nq"), F.lit(0)).cast("bigint").alias("negative_qty"),
        F.sum(_flag(F.col("_n") > 1)).cast("bigint").alias("dup_key_groups"),
    )


def _unpivot_counts(agg_row: DataFrame, names: list[str], label: str, value: str) -> DataFrame:
    rows = [F.struct(F.lit(n).alias(label), F.col(f"_c{i}").cast("bigint").alias(value))
            for i, n in enumerate(names)]
    return agg_row.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


def not_null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """K2: null count per NOT NULL column, one pass, as (column_name, nulls)."""
    agg = df.agg(*[F.sum(_flag(F.col(c).isNull())).alias(f"_c{i}") for i, c in enumerate(columns)])
    return _unpivot_counts(agg, columns, "column_name", "nulls")


def unique_violations(df: DataFrame, keys: list[str], primary_key: bool = False) -> DataFrame:
    """K3: key values held by more than one row. UNIQUE exempts keys with a
    null part (they never collide); a primary key does not."""
    src = df if primary_key else df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return src.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def check_violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """K4: violations per CHECK rule (a SQL boolean expression); a rule that
    evaluates to null passes, as in SQL."""
    agg = df.agg(*[F.sum(_flag(~F.coalesce(F.expr(r), F.lit(True)))).alias(f"_c{i}")
                   for i, r in enumerate(rules.values())])
    return _unpivot_counts(agg, list(rules), "rule", "violations")


def exactly_one_violations(df: DataFrame, value_cols: list[str]) -> DataFrame:
    """K5: rows where the number of non-null value columns is not exactly one."""
    n = reduce(lambda a, b: a + b, [_flag(F.col(c).isNotNull()) for c in value_cols])
    return df.where(n != 1)


def orphan_rows(child: DataFrame, parent: DataFrame, fk: str, pk: str) -> DataFrame:
    """K6: child rows whose non-null foreign key has no parent."""
    return child.where(F.col(fk).isNotNull()).join(
        parent.select(F.col(pk).alias("_pk")).distinct(), F.col(fk) == F.col("_pk"), "left_anti")


def unseen_runs(incoming: DataFrame, ledger: DataFrame, cols: list[str]) -> DataFrame:
    """K8: incoming run keys (source, files, mtimes) not yet in the ledger;
    nulls are folded (text -> '', numbers -> 0) so they compare equal."""
    def fold(df):
        return df.select(*[F.coalesce(F.col(c), F.lit("") if isinstance(df.schema[c].dataType, T.StringType)
                                      else F.lit(0)).alias(f"_k_{c}") for c in cols], *df.columns)
    keys = [f"_k_{c}" for c in cols]
    seen = fold(ledger).select(*keys).distinct()
    return fold(incoming).join(seen, keys, "left_anti").select(*incoming.columns).distinct()


def mapping_errors(columns: list[str], side: str, sku: str | None, account: str | None,
                   qty: str | None) -> list[str]:
    """K1 (errors part): codes for the chosen column names, before any data is
    read: ``<side>:unpicked:<role>`` for each role without a column; if there
    is none, ``<side>:shared:<column>`` for a column of several roles and
    ``<side>:unknown:<column>`` for one that the frame lacks."""
    picks = (("sku", sku), ("account", account), ("quantity", qty))
    missing = [f"{side}:unpicked:{role}" for role, column in picks if not column]
    chosen = [column for _, column in picks]
    return missing or ([f"{side}:shared:{c}" for c in dict.fromkeys(chosen) if chosen.count(c) > 1]
                       + [f"{side}:unknown:{c}" for c in dict.fromkeys(chosen) if c not in columns])
