"""Column types of text columns by a mergeable lattice.

Each cell has a kind: missing, boolean, integer, decimal, float, timestamp or
text. A column's summary is the set of its cells' kinds (bits joined by or),
the most digits before and after the point, and whether a number has leading
zeros. Summaries of any two parts of a column join to that of both, so one
aggregation over one scan types all columns, in partial sums per task.

No cell changes its value: numbers with leading zeros (keys such as ``007``)
stay text; integers beyond a long become decimal, and text beyond 38 digits;
decimals become double where 15 digits hold them all, else decimal. Numbers
beside other kinds make text, as do booleans and timestamps beside any.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.scalars import strip_ws
from ledgerline.sources.headers import named

BOOLEAN, INTEGER, DECIMAL, FLOAT, TIMESTAMP, TEXT = (1 << k for k in range(6))

_INTEGER = r"^[+-]?[0-9]+$"
_DECIMAL = r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)$"
_FLOAT = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]+$"
_TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$"


def kind(cell: Column) -> Column:
    """The bit of a cell's kind, 0 for a missing cell."""
    s = strip_ws(cell)
    return (F.when(cell.isNull() | (s == ""), F.lit(0))
            .when(s.rlike(_INTEGER), F.lit(INTEGER)).when(s.rlike(_DECIMAL), F.lit(DECIMAL))
            .when(F.lower(s).isin("true", "false"), F.lit(BOOLEAN))
            .when(s.rlike(_FLOAT) & (F.abs(s.try_cast("double")) < float("inf")), F.lit(FLOAT))
            .when(s.rlike(_TIMESTAMP) & s.try_cast("timestamp_ntz").isNotNull(), F.lit(TIMESTAMP))
            .otherwise(F.lit(TEXT)))


def summary(cell: Column) -> list[Column]:
    """Aggregates (kinds, most digits before the point, after it, leading zeros)."""
    s = strip_ws(cell)
    number = s.rlike(_INTEGER) | s.rlike(_DECIMAL) | s.rlike(_FLOAT)
    before = F.length(F.regexp_extract(s, r"^[+-]?0*([0-9]*)", 1))
    after = F.length(F.regexp_extract(s, r"\.([0-9]*)", 1))
    return [F.coalesce(F.bit_or(kind(cell)), F.lit(0)), F.coalesce(F.max(F.when(number, before)), F.lit(0)),
            F.coalesce(F.max(F.when(number, after)), F.lit(0)),
            F.coalesce(F.bool_or(number & s.rlike(r"^[+-]?0[0-9]")), F.lit(False))]


def joined(a: tuple, b: tuple) -> tuple:
    """Summary of two parts of a column, e.g. of two scans."""
    return a[0] | b[0], max(a[1], b[1]), max(a[2], b[2]), a[3] or b[3]


def type_of(kinds: int, before: int, after: int, zeros: bool) -> str:
    """The narrowest type of a column with this summary."""
    if kinds == BOOLEAN:
        return "boolean"
    if kinds == TIMESTAMP:
        return "timestamp_ntz"
    if not kinds or kinds & ~(INTEGER | DECIMAL | FLOAT) or zeros:
        return "string"
    if kinds == INTEGER:
        return "bigint" if before <= 18 else f"decimal({before},0)" if before <= 38 else "string"
    if before + after <= 15:
        return "double"
    if kinds & FLOAT:
        return "string"
    return f"decimal({before + after},{after})" if before + after <= 38 else "string"


def summaries(rows: DataFrame) -> dict[str, tuple]:
    """Summary of every text column, by one aggregation."""
    columns = [n for n, t in rows.dtypes if t == "string"]
    if not columns:
        return {}
    found = rows.agg(*[F.struct(*[c.alias(f"f{i}") for i, c in enumerate(summary(named(n)))]).alias(f"s{k}")
                       for k, n in enumerate(columns)]).first()
    return {n: tuple(found[f"s{k}"]) for k, n in enumerate(columns)}


def inferred_types(rows: DataFrame, keep_text=(), known: list[dict[str, tuple]] = ()) -> dict[str, str]:
    """Column -> type. ``known`` are summaries of other parts of the same table."""
    own = summaries(rows)
    return {n: "string" if n in keep_text else type_of(*reduce(joined, [k[n] for k in known if n in k], s))
            for n, s in own.items()}


def typed(rows: DataFrame, types: dict[str, str]) -> DataFrame:
    """Columns cast to the given types; blank cells of typed columns are null."""
    def cell(n: str) -> Column:
        t = types.get(n, "string")
        return named(n) if t == "string" else F.nullif(strip_ws(named(n)), F.lit("")).cast(t).alias(n)
    return rows.select(*[cell(n) for n in rows.columns])
