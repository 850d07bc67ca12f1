"""JSON / Variant scalar functions.

Open-shaped payloads are parsed once to ``VARIANT``; a missing path reads as
SQL NULL while an explicit JSON ``null`` is a variant null
(``is_variant_null``), which keeps "absent" and "null" apart.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.scalars import ColumnOrName, _c, _let, strict_int, strip_ws


def field(v: ColumnOrName, path: str) -> Column:
    """Sub-variant at ``path``; SQL NULL when the path is absent."""
    return F.try_variant_get(_c(v), path, "variant")


def present(v: ColumnOrName, path: str) -> Column:
    """The key exists (its value may be JSON null)."""
    return field(v, path).isNotNull()


def text(v: ColumnOrName, path: str) -> Column:
    """Value at ``path`` as text; absent or JSON null -> null."""
    return F.try_variant_get(_c(v), path, "string")


def canonical_json(c: ColumnOrName) -> Column:
    """Invalid, blank, ``null`` or ``none`` text -> empty text, else the
    compact JSON. (Spark writes object keys sorted.)"""
    s = strip_ws(_c(c).cast("string"))
    parsed = F.try_parse_json(s)
    bad = s.isNull() | (s == "") | F.lower(s).isin("null", "none") | parsed.isNull() | F.is_variant_null(parsed)
    return F.when(bad, F.lit("")).otherwise(F.to_json(parsed))


INTEGER_TYPES = ("BIGINT", "INT", "SMALLINT", "TINYINT")


def _int_of_variant(v: Column) -> Column:
    """Python ``int(x)`` on a JSON scalar: integers as they are, truncated
    decimals, digit text."""
    t = F.schema_of_variant(v)
    return (F.when(t.isin(*INTEGER_TYPES), F.try_variant_get(v, "$", "bigint"))
            .when(t.isin("DOUBLE", "FLOAT") | t.startswith("DECIMAL"), F.try_variant_get(v, "$", "double").try_cast("bigint"))
            .when(t == "STRING", strict_int(F.try_variant_get(v, "$", "string"))))


def supplier_id(v: ColumnOrName) -> Column:
    """C11: supplier id from an integer, an object (``id`` then
    ``supplier_id``) or a URL / text (last all-digit path segment, else the
    first digit run)."""
    def from_text(s: Column) -> Column:
        digit_segments = F.filter(F.split(s, "/"), lambda p: p.rlike("^[0-9]+$"))
        return F.coalesce(
            F.try_element_at(digit_segments, F.lit(-1)).try_cast("bigint"),
            F.nullif(F.regexp_extract(s, "([0-9]+)", 1), F.lit("")).try_cast("bigint"),
        )

    def of_type(v: Column, t: Column) -> Column:
        from_obj = F.coalesce(_int_of_variant(field(v, "$.id")), _int_of_variant(field(v, "$.supplier_id")))
        return (F.when(v.isNull() | F.is_variant_null(v), F.lit(None).cast("bigint"))
                .when(t.isin(*INTEGER_TYPES), F.try_variant_get(v, "$", "bigint"))
                .when(t.startswith("OBJECT"), from_obj)
                .when(t == "STRING", from_text(F.try_variant_get(v, "$", "string"))))
    return _let(_c(v), lambda v: _let(F.schema_of_variant(v), lambda t: of_type(v, t)))


# ISO forms: a calendar date, extended or basic, and perhaps a time of two-digit
# parts, extended or basic, with a fraction and a zone; fixed pattern.
ISO_TIME = (r"^(?:(\d{4})-(\d{2})-(\d{2})|(\d{8}))(?:[T ](?:(\d{2})(?::(\d{2})(?::(\d{2}))?)?|(\d{4}|\d{6}))"
            r"(?:[.,](\d{1,9}))?(?:Z|[+-]\d{2}(?::?\d{2})?)?)?(?:\r\n|[\n\r\x{85}\x{2028}\x{2029}])?\z")


def parse_iso_ts(c: ColumnOrName) -> Column:
    """ISO timestamp text (``Z`` / offsets, plain dates, basic forms) to
    TIMESTAMP_NTZ holding the written wall-clock time (a zone designator is
    dropped, as the stored value of the reference is); empty or bad -> null.
    Independent of the session time zone."""
    # "day digits|time digits|fraction"; a text of no such form stays as it is
    def written(parts: Column) -> Column:
        day, fraction = F.get(parts, 0), F.get(parts, 2)
        time = F.rpad(F.get(parts, 1), 6, "0")
        return F.concat(F.substring(day, 1, 4), F.lit("-"), F.substring(day, 5, 2), F.lit("-"), F.substring(day, 7, 2), F.lit(" "),
                        F.substring(time, 1, 2), F.lit(":"), F.substring(time, 3, 2), F.lit(":"), F.substring(time, 5, 2),
                        F.when(fraction != "", F.concat(F.lit("."), F.substring(fraction, 1, 6))).otherwise(F.lit("")))

    def of(s: Column) -> Column:
        found = F.regexp_replace(s, ISO_TIME, "$1$2$3$4|$5$6$7$8|$9")
        return _let(found, lambda f: F.when(f != s, _let(F.split(f, r"\|"), written).try_cast("timestamp_ntz")))
    return _let(_c(c).cast("string"), of)


def first_truthy_text(*values: Column) -> Column:
    """Text of the first VARIANT that is truthy: not absent or null, not
    empty text, not the number 0, not false. (The texts "0" and "false" are.)"""
    def truthy(v: Column, t: Column) -> Column:
        number = t.isin(*INTEGER_TYPES, "DOUBLE", "FLOAT") | t.startswith("DECIMAL")
        falsy = (F.when(t == "STRING", F.try_variant_get(v, "$", "string") == "")
                 .when(number, F.try_variant_get(v, "$", "double") == 0)
                 .when(t == "BOOLEAN", ~F.try_variant_get(v, "$", "boolean"))
                 .otherwise(v.isNull() | F.is_variant_null(v)))
        return F.when(~falsy, F.try_variant_get(v, "$", "string"))
    # a text is falsy only if empty or begun as "0", "-0.0" or "false" is; only then is the type looked up
    def of(v: Column) -> Column:
        s = F.try_variant_get(v, "$", "string")
        looked_up = _let(v, lambda x: _let(F.schema_of_variant(x), lambda t: truthy(x, t)))
        return F.when(F.substring(s, 1, 1).isin("", "0", "-", "f"), looked_up).otherwise(s)
    return F.coalesce(*[of(v) for v in values])


def to_float_default(v: Column, default: float = 0.0) -> Column:
    """``float(x)`` with a default (orders): numbers, booleans and numeric
    text (surrounding blanks allowed); anything else -> ``default``."""
    return F.coalesce(F.try_variant_get(v, "$", "double"), F.lit(default))
