"""Keyed snapshot diff, duplicate detection and sync.

First-row-per-key is an aggregation (``min`` of a struct that starts with the
row order), not a window: the aggregate is combined map-side, so a key that
holds a third of all rows is reduced before the shuffle instead of being
sorted inside one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.functions.scalars import in_stock, join_key


def _keys_eq(left: list[str], right: list[str]) -> Column:
    return reduce(lambda a, b: a & b,
                  [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(left, right)])


def _filler(dt: T.DataType) -> Column | None:
    if isinstance(dt, T.StringType):
        return F.lit("")
    if isinstance(dt, T.NumericType):
        return F.lit(0).cast(dt)
    if isinstance(dt, T.BooleanType):
        return F.lit(False)
    if isinstance(dt, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.lit(0).cast("timestamp").cast(dt)
    return None


def null_safe_key_columns(df: DataFrame, keys: list[str], prefix: str) -> tuple[list[Column], list[str]] | None:
    """Key columns as (is_null, value-or-filler) pairs: grouping and equi-joining
    on them equals null-safe equality on the keys, and -- unlike a null-safe
    join condition -- the join can reuse the aggregation's hash partitioning.
    None when a key type has no filler (then ``eqNullSafe`` is used)."""
    cols, names = [], []
    for i, k in enumerate(keys):
        fill = _filler(df.schema[k].dataType)
        if fill is None:
            return None
        cols += [F.col(k).isNull().alias(f"{prefix}n{i}"), F.coalesce(F.col(k), fill).alias(f"{prefix}v{i}")]
        names += [f"{prefix}n{i}", f"{prefix}v{i}"]
    return cols, names


def first_per_key(df: DataFrame, keys: list[str], order_cols: list[str] | None = None,
                  count_as: str | None = None) -> DataFrame:
    """H1: first row per key in row order (``order_cols`` then every other
    column as tie-break). Null keys form one group, like a pandas index.

    ``count_as`` also returns the number of rows of the key."""
    order_cols = list(order_cols or [])
    rest = [c for c in df.columns if c not in order_cols and c not in keys]
    row = F.struct(*[F.col(c) for c in order_cols + rest])
    aggs = [F.min(row).alias("_first")]
    if count_as:
        aggs.append(F.count(F.lit(1)).alias(count_as))
    g = df.groupBy(*keys).agg(*aggs)
    out = [F.col(k) for k in keys] + [F.col("_first")[c].alias(c) for c in order_cols + rest]
    if count_as:
        out.append(F.col(count_as))
    # restore the input column order
    sel = g.select(*out)
    return sel.select(*df.columns, *([count_as] if count_as else []))


def _dedup_side(df: DataFrame, keys: list[str], cols: list[str], order, tag: str, pair) -> DataFrame:
    """First row per key of one side, keys as null-safe (flag, value) pairs
    named ``_kn<i>`` / ``_kv<i>`` (or raw ``_<tag>k<i>`` when no pair exists)."""
    if pair is not None:
        key_cols, key_names = pair
        base = df.select(*key_cols, *[F.col(c) for c in df.columns])
        d = first_per_key(base.drop(*keys), key_names, order, count_as="_n")
        return d.select(*key_names, *[F.col(c).alias(f"_{tag}_{c}") for c in cols],
                        F.col("_n").alias(f"_n{tag}"), F.lit(True).alias(f"_in_{tag}"))
    d = first_per_key(df, keys, order, count_as="_n")
    return d.select(*[F.col(k).alias(f"_{tag}k{i}") for i, k in enumerate(keys)],
                    *[F.col(c).alias(f"_{tag}_{c}") for c in cols],
                    F.col("_n").alias(f"_n{tag}"), F.lit(True).alias(f"_in_{tag}"))


def _diff_join(src: DataFrame, tgt: DataFrame, src_keys: list[str], tgt_keys: list[str],
               compare_cols: list[str], src_order=None, tgt_order=None) -> tuple[DataFrame, list[str]]:
    """Deduplicated null-safe full outer join of source and target on the
    keys, with per-column ``_mod_<c>`` flags and row presence.

    Keys are grouped and joined as (is_null, value) pairs, so the join needs
    no exchange beyond the two deduplicating aggregations."""
    cols = [c for c in compare_cols if c in src.columns and c in tgt.columns]
    nk = len(src_keys)
    sp = null_safe_key_columns(src, src_keys, "_k")
    tp = null_safe_key_columns(tgt, tgt_keys, "_k")
    if sp is not None and tp is not None and \
            [src.schema[a].dataType for a in src_keys] == [tgt.schema[b].dataType for b in tgt_keys]:
        s = _dedup_side(src, src_keys, cols, src_order, "s", sp)
        t = _dedup_side(tgt, tgt_keys, cols, tgt_order, "t", tp)
        j = s.join(t, sp[1], "full")
        keys = [F.when(F.col(f"_kn{i}"), F.lit(None)).otherwise(F.col(f"_kv{i}")).alias(f"_k{i}")
                for i in range(nk)]
    else:
        s = _dedup_side(src, src_keys, cols, src_order, "s", None)
        t = _dedup_side(tgt, tgt_keys, cols, tgt_order, "t", None)
        j = s.join(t, _keys_eq([f"_sk{i}" for i in range(nk)], [f"_tk{i}" for i in range(nk)]), "full")
        in_s0 = F.col("_in_s").isNotNull()
        keys = [F.when(in_s0, F.col(f"_sk{i}")).otherwise(F.col(f"_tk{i}")).alias(f"_k{i}") for i in range(nk)]
    in_s = F.col("_in_s").isNotNull()
    in_t = F.col("_in_t").isNotNull()
    mods = [(in_s & in_t & ~F.col(f"_s_{c}").eqNullSafe(F.col(f"_t_{c}"))).alias(f"_mod_{c}")
            for c in cols]
    j = j.select(*keys, in_s.alias("in_src"), in_t.alias("in_tgt"),
                 *[F.col(f"_s_{c}") for c in cols], *[F.col(f"_t_{c}") for c in cols],
                 *mods, F.coalesce("_ns", F.lit(0)).alias("_ns"), F.coalesce("_nt", F.lit(0)).alias("_nt"))
    any_mod = reduce(lambda a, b: a | b, [F.col(f"_mod_{c}") for c in cols], F.lit(False))
    change = (F.when(~F.col("in_tgt"), F.lit("added"))
              .when(~F.col("in_src"), F.lit("removed"))
              .when(any_mod, F.lit("modified"))
              .otherwise(F.lit("same")))
    return j.withColumn("change", change), cols


def keyed_diff(src: DataFrame, tgt: DataFrame, src_keys: list[str], tgt_keys: list[str],
               compare_cols: list[str], src_order=None, tgt_order=None) -> DataFrame:
    """added / removed / modified rows (unchanged omitted) with
    ``<c>_src`` and ``<c>_tgt`` per compare column; ``key`` joins the key parts
    with `` | `` (null part -> empty)."""
    j, cols = _diff_join(src, tgt, src_keys, tgt_keys, compare_cols, src_order, tgt_order)
    nk = len(src_keys)
    out = [join_key(*[F.col(f"_k{i}") for i in range(nk)]).alias("key"), F.col("change")]
    for c in cols:
        out += [F.col(f"_s_{c}").alias(f"{c}_src"), F.col(f"_t_{c}").alias(f"{c}_tgt")]
    return j.where(F.col("change") != "same").select(*out)


def _cnt(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def _diff_aggs(j: DataFrame, cols: list[str]) -> DataFrame:
    ch = F.col("change")
    aggs = [
        F.sum("_ns").cast("bigint").alias("total_src"),
        F.sum("_nt").cast("bigint").alias("total_tgt"),
        _cnt(ch == "added").alias("added"),
        _cnt(ch == "removed").alias("removed"),
        _cnt(ch == "modified").alias("modified"),
        _cnt(ch == "same").alias("same"),
    ]
    both = F.col("in_src") & F.col("in_tgt")
    for i, c in enumerate(cols):
        s_in, t_in = in_stock(F.col(f"_s_{c}")), in_stock(F.col(f"_t_{c}"))
        aggs += [
            _cnt(F.col(f"_mod_{c}")).alias(f"m{i}"),
            _cnt(both & s_in & ~t_in).alias(f"a{i}"),
            _cnt(both & ~s_in & t_in).alias(f"b{i}"),
        ]
    return j.agg(*aggs)


def diff_stats(src, tgt, src_keys, tgt_keys, compare_cols, src_order=None, tgt_order=None) -> DataFrame:
    """F5s: totals before dedupe and counts by class, one row."""
    j, cols = _diff_join(src, tgt, src_keys, tgt_keys, compare_cols, src_order, tgt_order)
    return _diff_aggs(j, cols).select("total_src", "total_tgt", "added", "removed", "modified", "same")


def _per_column(src, tgt, src_keys, tgt_keys, compare_cols, src_order, tgt_order) -> DataFrame:
    j, cols = _diff_join(src, tgt, src_keys, tgt_keys, compare_cols, src_order, tgt_order)
    a = _diff_aggs(j, cols)
    rows = [F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("modified"),
                     F.col(f"a{i}").alias("src_in_tgt_out"), F.col(f"b{i}").alias("src_out_tgt_in"))
            for i, c in enumerate(cols)]
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*") if rows else \
        a.select(F.lit("").alias("column_name")).where(F.lit(False))


def diff_column_counts(src, tgt, src_keys, tgt_keys, compare_cols, src_order=None,
                       tgt_order=None) -> DataFrame:
    """F5s (per column): modified count per compare column."""
    return _per_column(src, tgt, src_keys, tgt_keys, compare_cols, src_order, tgt_order) \
        .select("column_name", "modified")


def in_stock_flips(src, tgt, src_keys, tgt_keys, compare_cols, src_order=None,
                   tgt_order=None) -> DataFrame:
    """in-stock flips per compare column over the common keys."""
    return _per_column(src, tgt, src_keys, tgt_keys, compare_cols, src_order, tgt_order) \
        .select("column_name", "src_in_tgt_out", "src_out_tgt_in")


def diff_report(src, tgt, src_keys, tgt_keys, compare_cols, src_order=None, tgt_order=None) -> DataFrame:
    """the diff report as (section, metric, value) rows, from one pass."""
    j, cols = _diff_join(src, tgt, src_keys, tgt_keys, compare_cols, src_order, tgt_order)
    a = _diff_aggs(j, cols)
    told = [("totals", m, c) for m, c in (("source_rows", "total_src"), ("target_rows", "total_tgt"), ("added", "added"),
                                          ("removed", "removed"), ("modified", "modified"), ("same", "same"))]
    for i, c in enumerate(cols):
        told += [("modified_values", c, f"m{i}"), ("stock_to_none", c, f"a{i}"), ("none_to_stock", c, f"b{i}")]
    rows = [F.struct(F.lit(section).alias("section"), F.lit(metric).alias("metric"), F.col(value).alias("value"))
            for section, metric, value in told]
    return a.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


# Copies of a row that one task writes out at once.
REPEAT_BLOCK = 10_000


def duplicate_rows(df: DataFrame, keys: list[str], order_cols: list[str] | None = None,
                   spread_repeats: bool = False) -> DataFrame:
    """F8: second and later occurrences of each key in row order; a null key
    part counts as empty text.

    Distinct rows are counted per key first (map-side combine), the first
    row per key comes from an aggregate, and every row except one copy of the
    first is emitted with its multiplicity; ``spread_repeats`` deals the blocks
    of a row's copies to several tasks."""
    order_cols = list(order_cols or [])
    rest = [c for c in df.columns if c not in order_cols]
    kexprs = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"_k{i}") for i, k in enumerate(keys)]
    kn = [f"_k{i}" for i in range(len(keys))]
    counted = (df.select(*kexprs, F.struct(*[F.col(c) for c in order_cols + rest]).alias("_r"))
               .groupBy(*kn, "_r").agg(F.count(F.lit(1)).alias("_n")))
    firsts = counted.groupBy(*kn).agg(F.min("_r").alias("_first"))
    reps = F.when(F.col("_r") == F.col("_first"), F.col("_n") - 1).otherwise(F.col("_n"))
    j = counted.join(firsts, kn).select("_r", reps.alias("_reps")).where(F.col("_reps") > 0)
    # a row repeated very often is written out in blocks, never as one array
    j = j.select("_r", "_reps", F.explode(F.sequence(F.lit(0), F.floor((F.col("_reps") - 1) / REPEAT_BLOCK))).alias("_b"))
    j = j.repartition("_r", "_b") if spread_repeats else j
    here = F.least(F.lit(REPEAT_BLOCK), F.col("_reps") - F.col("_b") * REPEAT_BLOCK)
    return (j.select("_r", F.explode(F.sequence(F.lit(1).cast("bigint"), here.cast("bigint"))).alias("_i"))
            .select(*[F.col("_r")[c].alias(c) for c in df.columns]))


def sync_into(src: DataFrame, tgt: DataFrame, src_keys: list[str], tgt_keys: list[str],
              sync_cols: list[str], src_order=None, tgt_order=None) -> DataFrame:
    """New target after syncing ``src`` into ``tgt``.

    Both sides are de-duplicated (first row per key); common sync columns of
    matched keys take the source value (null included); source-only keys are
    appended with nulls in the other columns; target-only rows are kept. Keys
    match null-safely; as in the diff they are grouped and joined as
    (is_null, value) pairs, so the join reuses the aggregations' partitioning."""
    cols = [c for c in sync_cols if c in src.columns and c in tgt.columns and c not in tgt_keys]
    rest = [c for c in tgt.columns if c not in tgt_keys]
    sp = null_safe_key_columns(src, src_keys, "_k")
    tp = null_safe_key_columns(tgt, tgt_keys, "_k")
    same_types = [src.schema[a].dataType for a in src_keys] == [tgt.schema[b].dataType for b in tgt_keys]
    if sp is not None and tp is not None and same_types:
        s = first_per_key(src.select(*sp[0], *[F.col(c) for c in src.columns]).drop(*src_keys), sp[1], src_order)
        s = s.select(*sp[1], *[F.col(c).alias(f"_s_{c}") for c in cols], F.lit(True).alias("_in_s"))
        t = first_per_key(tgt.select(*tp[0], *[F.col(c) for c in tgt.columns]).drop(*tgt_keys), tp[1], tgt_order)
        t = t.select(*tp[1], *[F.col(c).alias(f"_t_{c}") for c in rest], F.lit(True).alias("_in_t"))
        j = t.join(s, tp[1], "full")
        key_out = {k: F.when(F.col(f"_kn{i}"), F.lit(None)).otherwise(F.col(f"_kv{i}")) for i, k in enumerate(tgt_keys)}
    else:
        s = first_per_key(src, src_keys, src_order).select(
            *[F.col(k).alias(f"_sk{i}") for i, k in enumerate(src_keys)],
            *[F.col(c).alias(f"_s_{c}") for c in cols], F.lit(True).alias("_in_s"))
        t = first_per_key(tgt, tgt_keys, tgt_order)
        t = t.select(*[F.col(k).alias(f"_tk{i}") for i, k in enumerate(tgt_keys)],
                     *[F.col(c).alias(f"_t_{c}") for c in rest], F.lit(True).alias("_in_t"))
        j = t.join(s, _keys_eq([f"_tk{i}" for i in range(len(tgt_keys))],
                               [f"_sk{i}" for i in range(len(src_keys))]), "full")
        in_t0 = F.col("_in_t").isNotNull()
        key_out = {k: F.when(in_t0, F.col(f"_tk{i}")).otherwise(F.col(f"_sk{i}")) for i, k in enumerate(tgt_keys)}
    in_s = F.col("_in_s").isNotNull()
    out = []
    for c in tgt.columns:
        if c in key_out:
            out.append(key_out[c].alias(c))
        elif c in cols:
            out.append(F.when(in_s, F.col(f"_s_{c}")).otherwise(F.col(f"_t_{c}")).alias(c))
        else:
            out.append(F.col(f"_t_{c}").alias(c))
    return j.select(*out)


def sync_touched(src: DataFrame, src_keys: list[str]) -> DataFrame:
    """I1 count: distinct source keys, i.e. updated + appended target rows."""
    return src.select(*src_keys).distinct().agg(F.count(F.lit(1)).alias("touched"))
