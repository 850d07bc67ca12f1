"""Table writes as pure functions ``(target, changes) -> new target``
(SURVEY I2-I4, I8-I13).

Core Spark has no MERGE for plain parquet, so each write computes the new
table version as a DataFrame; ``sinks.writers.write_version`` then writes it
to a new version directory (never over the path being read). With a table
format that supports MERGE the same contract maps onto ``MERGE INTO``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _any_null(cols: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols])


def insert_or_replace(target: DataFrame, batch: DataFrame, unique_cols: list[str] | None,
                      batch_order: list[str] | None = None) -> DataFrame:
    """Insert-or-replace on ``unique_cols``.

    A batch row replaces the whole target row with the same key (columns it
    lacks become null); within the batch the last row in ``batch_order`` wins;
    rows with a null key part never collide. Without unique columns it is a
    plain insert. Batch columns the target lacks are added (schema evolution,
    B7)."""
    batch_order = list(batch_order or [])
    cols = list(target.columns) + [c for c in batch.columns if c not in target.columns and c not in batch_order]
    t = target.select(*[F.col(c) if c in target.columns else F.lit(None).alias(c) for c in cols],
                      F.lit(0).alias("_src"),
                      *[F.lit(None).cast(batch.schema[c].dataType).alias(f"_o_{c}") for c in batch_order])
    b = batch.select(*[F.col(c) if c in batch.columns else F.lit(None).alias(c) for c in cols],
                     F.lit(1).alias("_src"), *[F.col(c).alias(f"_o_{c}") for c in batch_order])
    if not unique_cols:
        return t.unionByName(b).select(*cols)
    # A batch row replaces the whole stored row, so stored rows of touched keys
    # never win: the target only passes an anti join against the winners' keys.
    order = F.struct(*[F.col(f"_o_{c}") for c in batch_order]) if batch_order else F.lit(0)
    rows = F.struct(*[F.col(c) for c in cols if c not in unique_cols])
    winners = (b.where(~_any_null(unique_cols)).groupBy(*unique_cols).agg(F.max_by(rows, order).alias("_w"))
               .select(*[F.col(c) if c in unique_cols else F.col("_w")[c].alias(c) for c in cols]))
    untouched = t.select(*cols).join(winners.select(*unique_cols), unique_cols, "left_anti").select(*cols)
    return untouched.unionByName(winners).unionByName(b.where(_any_null(unique_cols)).select(*cols))


def refresh_latest_from_norm(vs_norm: DataFrame) -> DataFrame:
    """I4: full refresh of ``inventory_latest`` from the normalised feed
    (null account -> empty text)."""
    return vs_norm.select(F.coalesce(F.col("account"), F.lit("")).alias("Account"),
                          F.col("sku").alias("SupplierSKU"),
                          F.col("qty").cast("bigint").alias("FreeStock"))


def delete_by_ids(df: DataFrame, ids: DataFrame, key: str, id_col: str | None = None) -> DataFrame:
    """Rows whose key is not among ``ids`` (anti join)."""
    id_col = id_col or key
    return df.join(ids.select(F.col(id_col).alias("_id")).distinct(), F.col(key) == F.col("_id"), "left_anti")


def bulk_update(df: DataFrame, ids: DataFrame, key: str, values: dict, id_col: str | None = None) -> DataFrame:
    """Set ``values`` on the rows whose key is among ``ids``."""
    id_col = id_col or key
    marks = ids.select(F.col(id_col).alias("_id")).distinct().withColumn("_sel", F.lit(True))
    j = df.join(marks, F.col(key) == F.col("_id"), "left")
    sel = F.col("_sel").isNotNull()
    out = []
    for c in df.columns:
        if c in values:
            v = values[c] if isinstance(values[c], Column) else F.lit(values[c])
            out.append(F.when(sel, v.cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(c))
    return j.select(*out)


def fk_set_null(children: DataFrame, deleted_parents: DataFrame, fk: str, parent_key: str) -> DataFrame:
    """I11 set-null: children of deleted parents keep their row, fk -> null."""
    marks = deleted_parents.select(F.col(parent_key).alias("_pk")).distinct().withColumn("_del", F.lit(True))
    j = children.join(marks, F.col(fk) == F.col("_pk"), "left")
    return j.select(*[F.when(F.col("_del").isNotNull(), F.lit(None).cast(children.schema[c].dataType))
                      .otherwise(F.col(c)).alias(c) if c == fk else F.col(c) for c in children.columns])


def fk_restrict_rejected(deleted_parents: DataFrame, children: DataFrame, fk: str, parent_key: str) -> DataFrame:
    """I11 restrict: requested parent deletes rejected because children exist."""
    return deleted_parents.join(children.select(F.col(fk).alias("_fk")).distinct(),
                                F.col(parent_key) == F.col("_fk"), "left_semi")


def stamp_changes(new: DataFrame, old: DataFrame, keys: list[str], value_cols: list[str],
                  as_of: str, created: str = "created_at", updated: str = "updated_at") -> DataFrame:
    """``updated_at`` = ``as_of`` on inserted or changed rows only,
    ``created_at`` = ``as_of`` on inserts; other rows keep their stamps.
    ``old`` is reduced to its first row per key so copies never pair up."""
    from ledgerline.operators.diff import first_per_key
    ts = F.lit(as_of).cast("timestamp")
    old = first_per_key(old.select(*keys, *value_cols, created, updated), keys)
    o = old.select(*[F.col(k).alias(f"_ok_{k}") for k in keys],
                   *[F.col(c).alias(f"_o_{c}") for c in value_cols],
                   F.col(created).alias("_o_created"), F.col(updated).alias("_o_updated"),
                   F.lit(True).alias("_in_old"))
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_ok_{k}")) for k in keys])
    j = new.join(o, cond, "left")
    inserted = F.col("_in_old").isNull()
    changed = reduce(lambda a, b: a | b, [~F.col(c).eqNullSafe(F.col(f"_o_{c}")) for c in value_cols])
    return j.select(*new.columns,
                    F.when(inserted, ts).otherwise(F.col("_o_created")).alias(created),
                    F.when(inserted | changed, ts).otherwise(F.col("_o_updated")).alias(updated))


def run_log_row(summary: DataFrame, action: str, total_col: str, changes_col: str,
                seconds: float, at: str) -> DataFrame:
    """A run-log row (timestamp, total_skus, changes_detected,
    execution_time, action) from a one-row summary of the run."""
    return summary.select(
        F.lit(at).alias("timestamp"),
        F.col(total_col).cast("bigint").alias("total_skus"),
        F.col(changes_col).cast("bigint").alias("changes_detected"),
        F.lit(f"{seconds:.2f} seconds").alias("execution_time"),
        F.lit(action).alias("action"),
    )
