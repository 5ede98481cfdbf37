"""Date and time-of-day scalars. Every clock reading is an explicit
``as_of`` argument; nothing calls ``current_date``."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from comparo.functions import labels as L
from comparo.functions.text import as_col, map_values

__all__ = [
    "lit_date", "month_start", "date_of", "parse_date", "format_date",
    "weekday_name", "month_name", "weekday_es", "month_from_name",
    "days_between", "closure_bucket", "store_state", "time_minutes",
    "opening_hours", "period_month", "last_closed_month", "period_cutoff",
    "period_split",
]


def lit_date(d) -> Column:
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


def date_of(year, month, day) -> Column:
    """Date from parts; impossible parts give NULL."""
    return F.try_to_date(F.concat_ws("-", as_col(year).cast("string"),
                                     as_col(month).cast("string"),
                                     as_col(day).cast("string")), "yyyy-M-d")


def month_start(year, month) -> Column:
    return date_of(year, month, F.lit(1))


def parse_date(c, fmt: str = "MM/dd/yyyy") -> Column:
    """Text -> date with a pattern; anything else -> NULL."""
    return F.try_to_date(as_col(c).cast("string"), fmt)


def format_date(c, fmt: str = "dd/MM/yyyy") -> Column:
    return F.date_format(as_col(c), fmt)


def weekday_name(c) -> Column:
    return map_values(F.dayofweek(as_col(c)),
                      {i + 1: n for i, n in enumerate([L.WEEKDAYS_EN[6]] + L.WEEKDAYS_EN[:6])})


def month_name(c) -> Column:
    return F.get(F.array(*[F.lit(m) for m in L.MONTHS_EN]), F.month(as_col(c)) - 1)


def weekday_es(c) -> Column:
    return map_values(weekday_name(c), dict(zip(L.WEEKDAYS_EN, L.WEEKDAYS_ES)))


def month_from_name(c) -> Column:
    """'Julio' (any case) -> 7, unknown -> NULL."""
    return map_values(F.initcap(F.trim(as_col(c))),
                      {m: i + 1 for i, m in enumerate(L.MONTHS_ES)})


def days_between(as_of, c) -> Column:
    return F.datediff(lit_date(as_of) if not isinstance(as_of, Column) else as_of, as_col(c))


def closure_bucket(close_date, as_of) -> Column:
    """Closure-age label of a store; an open store (NULL date) or a store
    missing from the register is 'open'; a future closing date counts as
    closed for less than a year."""
    days = days_between(as_of, close_date)
    return (F.when(as_col(close_date).isNull(), F.lit(L.OPEN_STORE))
            .when(days > 1095, F.lit(L.CLOSED_OVER_3Y))
            .when(days > 730, F.lit(L.CLOSED_OVER_2Y))
            .when(days > 365, F.lit(L.CLOSED_OVER_1Y))
            .otherwise(F.lit(L.CLOSED_UNDER_1Y)))


def store_state(c) -> Column:
    """'-' in the closing-date cell means the store is active."""
    return F.when(as_col(c) == F.lit("-"), F.lit(L.ACTIVE)).otherwise(F.lit(L.CLOSED))


def time_minutes(c) -> Column:
    """'HH:MM' -> minutes since midnight (NULL if malformed)."""
    parts = F.split(F.trim(as_col(c)), ":")
    h = F.get(parts, 0).try_cast("int")
    m = F.get(parts, 1).try_cast("int")
    return h * 60 + m


def opening_hours(c, sep: str = " ") -> tuple[Column, Column]:
    """'08:00 a 21:00' -> (480, 1260): tokens 0 and 2."""
    parts = F.split(F.trim(as_col(c)), sep)
    return time_minutes(F.get(parts, 0)), time_minutes(F.get(parts, 2))


def period_month(c) -> Column:
    """'202504' -> 4."""
    return F.substring(as_col(c).cast("string"), 5, 2).try_cast("int")


def last_closed_month(as_of) -> Column:
    """First day of the month of (as_of - 28 days)."""
    d = lit_date(as_of) if not isinstance(as_of, Column) else as_of
    return F.trunc(F.date_sub(d, 28), "MM")


def period_cutoff(as_of, days: float = 182.5) -> Column:
    """as_of minus a (possibly fractional) number of days, as a timestamp."""
    d = lit_date(as_of) if not isinstance(as_of, Column) else as_of
    secs = int(round(days * 86400))
    return F.to_timestamp_ntz(F.date_format(d, "yyyy-MM-dd")) - F.make_dt_interval(
        F.lit(0), F.lit(0), F.lit(0), F.lit(secs))


def period_split(month_start_col, as_of, days: float = 182.5,
                 new: str = "new", old: str = "old") -> Column:
    """'new' when the month starts after the cutoff, else 'old' (NULL -> old)."""
    ts = F.to_timestamp_ntz(F.date_format(as_col(month_start_col), "yyyy-MM-dd"))
    return F.when(ts > period_cutoff(as_of, days), F.lit(new)).otherwise(F.lit(old))
