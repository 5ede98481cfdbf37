"""Text scalars: locale numbers, ids and tokens taken from labels.

ANSI mode stays on: malformed input either becomes NULL (``try_cast``,
``get``) or raises, by explicit choice (``on_error``).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from comparo.functions.labels import REST_LABEL

__all__ = [
    "as_col", "parse_locale_decimal", "parse_locale_int", "parse_thousands",
    "store_id", "token", "period_label", "size_range", "slot_start",
    "clean_sentinels", "dash_to_null", "rest_label", "map_values", "unify",
    "format_locale_decimal",
]


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _cast(c: Column, dtype: str, on_error: str) -> Column:
    if on_error == "null":
        return c.try_cast(dtype)
    if on_error == "raise":
        return c.cast(dtype)
    raise ValueError(f"on_error must be 'null' or 'raise', got {on_error!r}")


def parse_locale_decimal(c, on_error: str = "null", dtype: str = "decimal(18,4)") -> Column:
    """'1.234,50' -> 1234.50: dots are thousands separators, comma is the
    decimal mark."""
    x = F.replace(F.replace(F.trim(as_col(c)), F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    return _cast(x, dtype, on_error)


def parse_locale_int(c, truncate: bool = True, on_error: str = "null") -> Column:
    """Locale integer. ``truncate`` drops the decimal part at the comma
    ('1.234,99' -> 1234); otherwise the value is parsed as a decimal."""
    if not truncate:
        return parse_locale_decimal(c, on_error=on_error)
    x = F.replace(F.substring_index(F.trim(as_col(c)), ",", 1), F.lit("."), F.lit(""))
    return _cast(x, "bigint", on_error)


def parse_thousands(c, on_error: str = "null") -> Column:
    """Ticket counts written with thousands dots only: '12.345' -> 12345."""
    return _cast(F.replace(F.trim(as_col(c)), F.lit("."), F.lit("")), "bigint", on_error)


def store_id(c, sep: str = "-") -> Column:
    """Numeric store id in front of a store label ('12-NAME', '12 NAME')."""
    return F.trim(F.substring_index(F.trim(as_col(c)), sep, 1)).try_cast("bigint")


def token(c, i: int, sep: str = " ", strip: bool = True) -> Column:
    """i-th token (0-based) of a label; NULL when there are fewer tokens."""
    x = as_col(c)
    if strip:
        x = F.trim(x)
    pattern = sep if sep != " " else " "
    return F.get(F.split(x, pattern), i)


def period_label(month, year) -> Column:
    """'MM-YY' label of a month (7, 2001 -> '07-01')."""
    return F.concat(F.lpad(as_col(month).cast("string"), 2, "0"), F.lit("-"),
                    F.substring(as_col(year).cast("string"), -2, 2))


def size_range(c) -> Column:
    """Text after the first '-', remaining '-' read as 'a':
    '1-200-500' -> '200a500'; no '-' -> NULL."""
    rest = F.get(F.split(as_col(c), "-", 2), 1)
    return F.replace(rest, F.lit("-"), F.lit("a"))


def slot_start(c) -> Column:
    """'Desde 07:30 Hasta 08:00' -> '07:30' (NULL when absent)."""
    return F.nullif(F.regexp_extract(as_col(c), r"Desde (\d{2}:\d{2})", 1), F.lit(""))


def clean_sentinels(c, sentinels=("-", "sd", "SD", ""), dtype: str = "bigint") -> Column:
    """Register cells: sentinel or NULL -> 0, else the number (bad -> NULL)."""
    x = F.trim(as_col(c).cast("string"))
    return (F.when(x.isNull() | x.isin(*sentinels), F.lit(0).cast(dtype))
            .otherwise(x.try_cast(dtype)))


def dash_to_null(c) -> Column:
    return F.nullif(as_col(c), F.lit("-"))


def rest_label(c) -> Column:
    """Missing / zero id -> 'RESTO', else the id as text (3.0 -> '3')."""
    as_int = as_col(c).try_cast("double").try_cast("bigint").cast("string")
    return F.coalesce(F.nullif(as_int, F.lit("0")), F.lit(REST_LABEL))


def map_values(c, mapping: dict, default=None, keep_unmapped: bool = False) -> Column:
    """Dictionary lookup as a CASE chain. Unmapped values become ``default``
    (NULL by default, like a dictionary ``map``) or are kept
    (``keep_unmapped``, like ``replace``)."""
    x = as_col(c)
    out = None
    for k, v in mapping.items():
        out = F.when(x == F.lit(k), F.lit(v)) if out is None else out.when(x == F.lit(k), F.lit(v))
    if out is None:
        return x if keep_unmapped else F.lit(default)
    if keep_unmapped:
        return out.otherwise(x)
    return out.otherwise(F.lit(default)) if default is not None else out


def unify(c, mapping: dict | None = None, case: str = "lower") -> Column:
    """Trim + case-normalise a label, then apply spelling merges
    (e.g. {'express': 'proximidad'} or {'NEUQUÉN': 'NEUQUEN'})."""
    x = F.trim(as_col(c))
    x = F.lower(x) if case == "lower" else F.upper(x) if case == "upper" else x
    return map_values(x, mapping or {}, keep_unmapped=True)


def format_locale_decimal(c, digits: int = 2) -> Column:
    """Number -> '1.234,50' (thousands dot, decimal comma)."""
    s = F.format_number(as_col(c), digits)  # '1,234.50'
    return F.translate(s, ",.", ".,")
