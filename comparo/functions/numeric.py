"""Numeric scalars: half-even rounding, growth, gap, business metrics.

Money is summed as DECIMAL (exact) and turned into DOUBLE only when a
ratio is computed, so sums are reproducible across engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from comparo.functions.labels import VARIABLE_COST_RATE, VAT_RATE
from comparo.functions.text import as_col

__all__ = [
    "to_bigint", "to_double", "growth", "contribution_of",
    "in_millions", "net_of_tax", "POS_INF", "NEG_INF",
    "variable_cost", "growth_sql",
]

def POS_INF() -> Column:
    return F.lit(float("inf"))


def NEG_INF() -> Column:
    return F.lit(float("-inf"))


def to_double(c) -> Column:
    return as_col(c).cast("double")


def to_bigint(c) -> Column:
    return as_col(c).try_cast("bigint")


def growth_sql(base: str, current: str, scale: float = 100, digits: int | None = 1,
               zero_base: str = "inf") -> str:
    """SQL text of :func:`growth` over two column names (one expression, one
    parse: cheap to build for wide tables)."""
    b, c = f"CAST(`{base}` AS DOUBLE)", f"CAST(`{current}` AS DOUBLE)"
    ratio = f"((try_divide({c}, {b}) - 1.0) * {float(scale)!r})"
    value = f"bround({ratio}, {digits})" if digits is not None else ratio
    if zero_base == "inf":
        at_zero = (f"CASE WHEN {c} > 0 THEN CAST('Infinity' AS DOUBLE) "
                   f"WHEN {c} < 0 THEN CAST('-Infinity' AS DOUBLE) ELSE CAST(NULL AS DOUBLE) END")
    elif zero_base == "null":
        at_zero = "CAST(NULL AS DOUBLE)"
    elif zero_base == "zero":
        at_zero = "0.0D"
    else:
        raise ValueError(f"zero_base must be inf, null or zero, got {zero_base!r}")
    return (f"CASE WHEN {b} IS NULL OR {c} IS NULL THEN CAST(NULL AS DOUBLE) "
            f"WHEN {b} = 0 THEN {at_zero} ELSE {value} END")


def growth(base, current, scale: float = 100, digits: int | None = 1,
           zero_base: str = "inf") -> Column:
    """(current / base - 1) * scale, half-even rounded to ``digits``.

    * NULL base or current -> NULL (a missing year).
    * base == 0: ``zero_base='inf'`` gives +inf / -inf by the sign of current
      (0/0 -> NULL); ``'null'`` gives NULL; ``'zero'`` gives 0 for every
      non-finite result (+inf, -inf and 0/0).
    """
    if isinstance(base, str) and isinstance(current, str):
        return F.expr(growth_sql(base, current, scale, digits, zero_base))
    b = as_col(base).cast("double")
    c = as_col(current).cast("double")
    ratio = (F.try_divide(c, b) - F.lit(1.0)) * F.lit(float(scale))
    value = F.bround(ratio, digits) if digits is not None else ratio
    if zero_base == "inf":
        at_zero = (F.when(c > 0, POS_INF()).when(c < 0, NEG_INF())
                   .otherwise(F.lit(None).cast("double")))
    elif zero_base == "null":
        at_zero = F.lit(None).cast("double")
    elif zero_base == "zero":
        at_zero = F.lit(0.0)
    else:
        raise ValueError(f"zero_base must be inf, null or zero, got {zero_base!r}")
    return (F.when(b.isNull() | c.isNull(), F.lit(None).cast("double"))
            .when(b == 0, at_zero)
            .otherwise(value))


def in_millions(c, digits: int = 2) -> Column:
    return F.bround(as_col(c).cast("double") / F.lit(1_000_000.0), digits)


def net_of_tax(c, rate: str = VAT_RATE) -> Column:
    return as_col(c) * (F.lit(1) - F.lit(rate).cast("decimal(6,4)"))


def variable_cost(net_sales, rate: str = VARIABLE_COST_RATE) -> Column:
    """Variable cost as a negative share of net sales."""
    return -as_col(net_sales) * F.lit(rate).cast("decimal(6,4)")


def contribution_of(gap: Column, total: Column) -> Column:
    """gap / total; a zero total gives ±inf by the sign of the gap, 0 / 0 and NULL give 0 (GRW-6)."""
    at_zero = F.when(gap > 0, POS_INF()).when(gap < 0, NEG_INF()).otherwise(F.lit(0.0))
    return F.when(gap.isNull() | total.isNull(), F.lit(0.0)).when(total == 0, at_zero).otherwise(gap / total)
