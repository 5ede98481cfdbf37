"""Pivots as conditional aggregation and unpivots.

A pivot is written as ``sum(CASE WHEN key = v THEN x END)`` with the value
list passed in: no distinct-values job, one shuffle, partial aggregation
map-side. Unpivots are ``df.unpivot`` (a narrow Expand, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from comparo.operators.filters import drop_null_keys


def _name(v) -> str:
    return str(v).replace(" ", "_")


def pivot_values(df: DataFrame, dims, pivot_col: str, values, value: str = "value",
                 agg: str = "sum", names=None, drop_null: bool = True,
                 fill=None) -> DataFrame:
    """Long -> wide on ``pivot_col`` for the given ``values`` (PIV-1/4/5/6/7).
    ``agg`` is 'sum', 'max', 'avg' or 'count'."""
    dims = list(dims)
    fn = {"sum": F.sum, "max": F.max, "avg": F.avg, "count": F.count}[agg]
    names = names or [_name(v) for v in values]
    src = drop_null_keys(df, dims) if drop_null else df
    aggs = [fn(F.when(F.col(pivot_col) == F.lit(v), F.col(value))).alias(n)
            for v, n in zip(values, names)]
    out = src.groupBy(*dims).agg(*aggs)
    if fill is not None:
        out = out.na.fill(fill, subset=names)
    return out


def pivot_years(df: DataFrame, dims, years, value: str = "value", year: str = "year",
                names=None, as_double: bool = True) -> DataFrame:
    """Years -> columns ``y<year>`` (PIV-1); a missing year stays NULL."""
    names = names or [f"y{y}" for y in years]
    out = pivot_values(df.filter(F.col(year).isin(*years)), dims, year, years, value,
                       names=names)
    if as_double:
        out = out.select(*dims, *[F.col(n).cast("double").alias(n) for n in names])
    return out


def unpivot(df: DataFrame, ids, values, var: str, value: str,
            drop_nulls: bool = False) -> DataFrame:
    """Wide -> long (UNP-1..4). ``unpivot`` keeps NULL cells; ``drop_nulls``
    removes them: a row's cells are filtered before they become rows, so a sheet of a thousand mostly
    empty columns is not copied a thousand times. ``values`` may also be the name of one map column that
    holds a row's cells by their header (a sheet with more columns than a plan can carry); a header
    that is not in the map is an empty cell, so such a sheet is unpivoted with ``drop_nulls`` alone."""
    if isinstance(values, str):
        if not drop_nulls:
            raise ValueError("a sheet of cells has no empty cells to keep: drop_nulls=True")
        long = df.select(*[F.col(f"`{i}`") for i in ids], F.explode(F.col(f"`{values}`")).alias(var, value))
        return long.filter(F.col(value).isNotNull())
    if not drop_nulls:
        return df.unpivot(list(ids), list(values), var, value)
    cells = F.array(*[F.struct(F.lit(v).alias(var), F.col(f"`{v}`").alias(value)) for v in values])
    return df.select(*[F.col(f"`{i}`") for i in ids], F.inline(F.filter(cells, lambda c: c[value].isNotNull())))


def stack_measures(df: DataFrame, keys, measures: dict) -> DataFrame:
    """One wide row -> one row per measure (UNP-5): ``{label: column}``."""
    pairs = [F.struct(F.lit(k).alias("measure"), (F.col(c) if isinstance(c, str) else c)
                      .alias("value")) for k, c in measures.items()]
    return (df.select(*keys, F.inline(F.array(*pairs))))
