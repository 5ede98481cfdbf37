"""Aggregations: grouped sums, grouping sets, partition totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.operators.filters import drop_null_keys
from comparo.operators.joins import attach


def cube_sum(df: DataFrame, dims, value: str = "value", out: str | None = None,
             drop_null: bool = True) -> DataFrame:
    """Grouped sum at a grain (AGG-1); NULL keys dropped first."""
    dims = list(dims)
    src = drop_null_keys(df, dims) if drop_null else df
    return src.groupBy(*dims).agg(F.sum(value).alias(out or value))


def grouping_sets_sum(df: DataFrame, grains: dict, always=("year", "measure"),
                      value: str = "value", exclude: dict | None = None,
                      grain_col: str = "grain", extra: dict | None = None) -> DataFrame:
    """All report grains in one aggregation (AGG-2 as GROUPING SETS).

    ``grains`` maps a grain name to its key columns; ``always`` keys are in
    every set. Rows whose own keys are NULL are dropped per set (a group key
    that is NULL in the data never forms a group). ``exclude`` maps a grain
    name to measure values that do not belong to it (tickets are not
    additive over products). ``extra`` adds named aggregate columns.
    """
    always = list(always)
    all_keys = list(dict.fromkeys(k for ks in grains.values() for k in ks))
    sets = [[*ks, *always] for ks in grains.values()]
    gid_cols = all_keys + always
    agg = (df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in gid_cols])
             .agg(F.sum(value).alias(value),
                  *[c.alias(n) for n, c in (extra or {}).items()],
                  F.grouping_id().alias("_gid")))
    n = len(gid_cols)
    branches = None
    keep = None
    for name, ks in grains.items():
        members = set(ks) | set(always)
        gid = sum(1 << (n - 1 - i) for i, c in enumerate(gid_cols) if c not in members)
        is_set = F.col("_gid") == F.lit(gid)
        ok = is_set
        for k in ks:
            ok = ok & F.col(k).isNotNull()
        if exclude and name in exclude:
            ok = ok & ~F.col("measure").isin(*exclude[name])
        branches = (F.when(is_set, F.lit(name)) if branches is None
                    else branches.when(is_set, F.lit(name)))
        keep = ok if keep is None else keep | ok
    return (agg.filter(keep)
               .withColumn(grain_col, branches)
               .drop("_gid"))


def partition_total(df: DataFrame, value: str, by, out: str = "total",
                    broadcast: str = "auto") -> DataFrame:
    """Attach Σ value over the ``by`` partition to every row (AGG-5/WIN-1).

    A grouped sum joined back instead of a window: the sum aggregates
    map-side, so a partition holding a third of all rows never lands in one
    task. ``broadcast='bounded'`` when ``by`` has a fixed small domain."""
    by = [by] if isinstance(by, str) else list(by)
    totals = df.groupBy(*by).agg(F.sum(value).alias(out))
    return attach(df, totals, on=by, how="left", broadcast=broadcast)


def count_distinct_by(df: DataFrame, col: str, by, out: str = "n") -> DataFrame:
    """Distinct count per group (AGG-3)."""
    by = [by] if isinstance(by, str) else list(by)
    return df.groupBy(*by).agg(F.countDistinct(col).alias(out))
