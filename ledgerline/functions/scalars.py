"""Scalar column functions.

All return ``Column`` expressions made of built-in Spark functions, so they
stay inside whole-stage codegen. Lenient parsing uses ``try_cast`` because the
session runs with ANSI mode on.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _c(c: ColumnOrName) -> Column:
    return F.col(c) if isinstance(c, str) else c


# Python's white space (str.isspace): Unicode white space plus the four
# information separators \x1c-\x1f, as a Java regex class (with (?U)).
PY_WS = r"[\s\x1c-\x1f]"
# The characters Python's str.strip() removes (str.isspace), fixed values.
PY_WS_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004"
               "\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def _let(value: Column, use) -> Column:
    """use(value), with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def strip_ws(c: ColumnOrName) -> Column:
    """Strip Python white space at both ends (``trim`` only strips blanks);
    a character-set trim, no regex."""
    return F.btrim(_c(c), F.lit(PY_WS_CHARS))


def nullif_empty(c: ColumnOrName) -> Column:
    c = _c(c)
    return F.when(c == "", F.lit(None)).otherwise(c)


def clean_sku(c: ColumnOrName) -> Column:
    """Strip, upper-case, empty -> null."""
    return nullif_empty(F.upper(strip_ws(_c(c))))


# Null tokens that parse to 0 (compared upper-cased), fixed values.
QTY_NULL_TOKENS = ("NULL", "NAN")


# A decimal number as text, with or without an exponent.
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
# Such a number that is 0, or that its exponent rounds to 0, although no decimal is made of it.
_NOUGHT = r"^[+-]?([0.]+[eE].*|.*[eE]-0*[1-9][0-9]{9,})$"


def parse_qty(c: ColumnOrName) -> Column:
    """Lenient quantity to a whole number, decimal(38,0).

    null / blank / NULL / NAN -> 0; ``(x)`` negates; thousands commas dropped;
    decimal rounded half away from zero; anything unparsable -> 0. A number of
    more than 38 digits is null: no value changes silently."""
    s = strip_ws(_c(c).cast("string"))
    neg = s.startswith("(") & s.endswith(")")
    inner = F.when(neg, F.regexp_replace(s, r"^\(|\)$", "")).otherwise(s)
    core = strip_ws(F.regexp_replace(inner, ",", ""))
    whole = core.try_cast("decimal(38,0)")  # rounds half away from zero
    signed = F.when(neg, -whole).otherwise(whole)
    is_token = s.isNull() | (s == "") | F.upper(s).isin(*QTY_NULL_TOKENS)
    zero = F.lit(0).cast("decimal(38,0)")
    return (F.when(is_token, zero).when(whole.isNotNull(), signed)
            .when(core.rlike(_NUMBER) & ~core.rlike(_NOUGHT), F.lit(None)).otherwise(zero))


def parse_qty_long(c: ColumnOrName) -> Column:
    """C2 as bigint; null only for a quantity that no bigint holds."""
    return parse_qty(c).try_cast("bigint")


def to_double(c: ColumnOrName) -> Column:
    """Numeric coercion, bad -> null."""
    return _c(c).try_cast("double")


def clamp_negative(c: ColumnOrName) -> Column:
    """C4: negatives to 0, nulls kept."""
    c = _c(c)
    return F.when(c < 0, F.lit(0)).otherwise(c)


def normalise_key(c: ColumnOrName, strip: bool = True, upper: bool = True) -> Column:
    """Key to text, optional strip and upper-case."""
    out = _c(c).cast("string")
    if strip:
        out = strip_ws(out)
    if upper:
        out = F.upper(out)
    return out


def in_stock(c: ColumnOrName) -> Column:
    """Coerced value > 0, null or garbage -> false."""
    return F.coalesce(_c(c).try_cast("double"), F.lit(0.0)) > 0


def stock_status(qty: ColumnOrName) -> Column:
    """1 when quantity > 0 else 0 (null counts as 0)."""
    return F.when(F.coalesce(_c(qty), F.lit(0)) > 0, F.lit(1)).otherwise(F.lit(0))


# Text values read as true by the lenient boolean parser, fixed values.
TRUE_TOKENS = ("1", "true", "yes")


def lenient_bool(c: ColumnOrName) -> Column:
    """``1/true/yes`` (any case, trimmed) -> true, else false."""
    return F.coalesce(F.lower(strip_ws(_c(c).cast("string"))).isin(*TRUE_TOKENS), F.lit(False))


def lenient_int(c: ColumnOrName, default=None) -> Column:
    """Integer through float (truncation toward zero), bad -> default."""
    d = _c(c).cast("string").try_cast("double")
    finite = d.isNotNull() & ~F.isnan(d) & (F.abs(d) < F.lit(9.2e18))
    out = F.when(finite, d.cast("bigint"))
    return F.coalesce(out, F.lit(default).cast("bigint")) if default is not None else out


def lenient_float(c: ColumnOrName, default=None) -> Column:
    """Float, bad -> default."""
    d = _c(c).cast("string").try_cast("double")
    return F.coalesce(d, F.lit(default).cast("double")) if default is not None else d


# Integer text as Python's int() reads it: sign, digits, single underscores
# between digits, fixed value.
INT_TEXT = r"^[+-]?[0-9](?:_?[0-9])*$"


def strict_int(c: ColumnOrName, default=None) -> Column:
    """C9 (order version): integer text only (no float detour; white space
    around and ``_`` between digits allowed), bad -> default."""
    t = strip_ws(_c(c).cast("string"))
    out = F.when(t.rlike(INT_TEXT), F.replace(t, F.lit("_"), F.lit("")).try_cast("bigint"))
    return F.coalesce(out, F.lit(default).cast("bigint")) if default is not None else out


def first_truthy(*cols: ColumnOrName) -> Column:
    """First value that is neither null, empty text nor 0."""
    cleaned = []
    for c in cols:
        s = _c(c).cast("string")
        cleaned.append(F.when((s == "") | (s == "0"), F.lit(None)).otherwise(s))
    return F.coalesce(*cleaned)


def default_if_falsy(c: ColumnOrName, default) -> Column:
    """C14: replace null, 0, 0.0, empty text or false by ``default``."""
    c = _c(c)
    s = c.cast("string")
    falsy = c.isNull() | (s == "") | (s == "0") | (s == "0.0") | (s == "false")
    return F.when(falsy, default if isinstance(default, Column) else F.lit(default)).otherwise(c)


def status_code(enabled: ColumnOrName) -> Column:
    """Enabled boolean -> 1, else 2."""
    return F.when(_c(enabled), F.lit(1)).otherwise(F.lit(2))


def join_key(*cols: ColumnOrName, sep: str = " | ") -> Column:
    """Join key parts with `` | ``; null part -> empty text."""
    return F.concat_ws(sep, *[F.coalesce(_c(c).cast("string"), F.lit("")) for c in cols])


def line_amount(qty: ColumnOrName, unit_price: ColumnOrName) -> Column:
    """Generated column ``qty * unit_price``."""
    return _c(qty) * _c(unit_price)


def any_of(conds) -> Column:
    conds = list(conds)
    return reduce(lambda a, b: a | b, conds) if conds else F.lit(False)


def all_of(conds) -> Column:
    conds = list(conds)
    return reduce(lambda a, b: a & b, conds) if conds else F.lit(True)
