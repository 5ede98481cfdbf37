"""Row filters. All are plain predicates so Catalyst pushes them into the
Parquet scan or through joins where possible."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comparo.functions import labels as L
from comparo.functions.dates import last_closed_month as _last_closed
from comparo.functions.dates import lit_date


def drop_null_keys(df: DataFrame, keys) -> DataFrame:
    """Rows with a NULL grouping key are dropped before grouping (FLT-1)."""
    keys = list(keys)
    return df.na.drop(how="any", subset=keys) if keys else df


def is_packaging(family: str = "family", families=None, contains: str | None = None) -> Column:
    """True for a packaging family (exact list or substring); NULL family -> False."""
    fam = F.col(family)
    if contains is not None:
        return F.coalesce(fam.contains(contains), F.lit(False))
    return F.coalesce(fam.isin(*(families or L.PACKAGING_FAMILIES)), F.lit(False))


def exclude_packaging(df: DataFrame, family: str = "family", measure: str | None = None,
                      families=None, contains: str | None = None) -> DataFrame:
    """Drop packaging families (FLT-3a exact list / FLT-3b substring).
    A NULL family is kept. With ``measure`` given, only rows of that measure
    are subject to the filter (units lose packaging, sales keep it)."""
    is_pack = is_packaging(family, families, contains)
    if measure is not None:
        is_pack = is_pack & (F.col("measure") == F.lit(measure))
    return df.filter(~is_pack)


def comparable_predicate(flag: str | Column, case_sensitive: bool = False,
                         value: str = "SC") -> Column:
    c = F.col(flag) if isinstance(flag, str) else flag
    if not case_sensitive:
        c = F.upper(c)
    return c == F.lit(value)


def comparable(df: DataFrame, flag: str, case_sensitive: bool = False) -> DataFrame:
    """Keep like-for-like rows: the month's flag equals 'SC' (FLT-4)."""
    return df.filter(comparable_predicate(flag, case_sensitive))


def physical_formats(df: DataFrame, col: str, allowed=None, lower: bool = True) -> DataFrame:
    c = F.lower(F.col(col)) if lower else F.col(col)
    return df.filter(c.isin(*(allowed or L.REGISTER_FORMATS)))


def ytd(df: DataFrame, month_limit: int, month: str = "month") -> DataFrame:
    """Year to date: month number <= limit (FLT-6)."""
    return df.filter(F.col(month) <= F.lit(month_limit))


def drop_totals(df: DataFrame, cols, total: str = "Total") -> DataFrame:
    """Drop sub-header / total rows: any of ``cols`` equal to 'Total' or NULL."""
    cond = reduce(lambda a, b: a & b,
                  [F.coalesce(F.col(c) != F.lit(total), F.lit(False)) for c in cols])
    return df.filter(cond)


def nonzero(df: DataFrame, col: str) -> DataFrame:
    """Measure non-NULL and non-zero (FLT-10)."""
    return df.filter(F.col(col).isNotNull() & (F.col(col) != 0))


def on_weekday(df: DataFrame, date_col: str, weekday: str = "Sunday") -> DataFrame:
    """Keep one weekday (FLT-11); 'Sunday' is dayofweek 1."""
    idx = (L.WEEKDAYS_EN.index(weekday) + 1) % 7 + 1
    return df.filter(F.dayofweek(F.col(date_col)) == F.lit(idx))


def outside_hours(df: DataFrame, start: str = "slot_start", open_: str = "open_min",
                  close: str = "close_min") -> DataFrame:
    """Slots starting before opening or at/after closing (FLT-12)."""
    return df.filter((F.col(start) < F.col(open_)) | (F.col(start) >= F.col(close)))


def comparison_series(df: DataFrame, stores, measure: str, store_col: str = "store",
                      total_label: str = "Total Formato", measure_col: str = "measure") -> DataFrame:
    """Chosen stores plus the total line, one measure (FLT-13)."""
    keep = list(stores) + [total_label]
    return df.filter(F.col(store_col).isin(*keep) & (F.col(measure_col) == F.lit(measure)))


def drop_null_columns(df: DataFrame) -> DataFrame:
    """Drop every column holding at least one NULL (FLT-2). One aggregation
    pass; only a single row of NULL counts reaches the driver."""
    counts = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    keep = [c for c in df.columns if counts[c] == 0]
    return df.select(*keep)
