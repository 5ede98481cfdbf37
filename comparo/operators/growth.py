"""Growth tables: the year pivot, the measure pivot and the growth
columns in one conditional aggregation.

NULL policy switches (each report picks its own, see the plans):

* ``resum``  – years absent from a group count as 0 before the growth
  (a base of 0 gives +inf, a current of 0 gives -100 %); otherwise an
  absent year leaves base/current and growth NULL.
* ``wide``   – None: long output (one row per measure); 'mean': measures as
  column triples, NULLs kept; 'sum': as 'mean' but, for a (group, measure)
  pair that has rows, NULL base/current/growth read as 0.
* ``fill``   – finally replace every NULL metric by this value.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.functions.numeric import contribution_of, growth, growth_sql
from comparo.operators.filters import drop_null_keys

METRICS = ("base", "current", "growth")


def growth_table(df: DataFrame, dims, years, *, measures=("VCT", "VOL", "DEB"),
                 value: str = "value", year: str = "year", measure: str = "measure",
                 resum: bool = False, wide: str | None = None, scale: float = 100,
                 digits: int | None = 1, zero_base: str = "inf", fill=None,
                 require=()) -> DataFrame:
    """Base/current sums per group and measure plus growth; ``require``
    lists extra columns that must be non-NULL (keys of a finer grain the
    table was built from)."""
    base_y, cur_y = years
    dims = list(dims)
    src = df.filter(F.col(year).isin(base_y, cur_y))
    src = src.filter(F.col(measure).isin(*measures))
    src = drop_null_keys(src, list(dict.fromkeys(dims + [measure] + list(require))))
    lit = (lambda v: f"'{v}'") if isinstance(base_y, str) else str
    dsel = [f"`{d}`" for d in dims]

    def g(b, c):
        return growth_sql(b, c, scale=scale, digits=digits, zero_base=zero_base)

    def sums(cond, alias):
        return f"sum(CASE WHEN {cond} THEN `{value}` END) AS `{alias}`"

    if wide is None:
        agg = src.groupBy(*dims, measure).agg(
            F.expr(sums(f"`{year}` = {lit(base_y)}", "_b")),
            F.expr(sums(f"`{year}` = {lit(cur_y)}", "_c")))
        if resum:
            b, c = "coalesce(CAST(`_b` AS DOUBLE), 0.0D)", "coalesce(CAST(`_c` AS DOUBLE), 0.0D)"
        else:
            b, c = "CAST(`_b` AS DOUBLE)", "CAST(`_c` AS DOUBLE)"
        out = agg.selectExpr(*dsel, f"`{measure}`", f"{b} AS base", f"{c} AS current")
        out = out.withColumn("growth", F.expr(g("base", "current")))
        if fill is not None:
            out = out.na.fill(fill, subset=list(METRICS))
        return out

    if wide not in ("mean", "sum"):
        raise ValueError(f"wide must be None, 'mean' or 'sum', got {wide!r}")
    aggs = []
    for m in measures:
        is_m = f"`{measure}` = '{m}'"
        aggs += [sums(f"{is_m} AND `{year}` = {lit(base_y)}", f"_{m}_b"),
                 sums(f"{is_m} AND `{year}` = {lit(cur_y)}", f"_{m}_c"),
                 f"max({is_m}) AS `_{m}_has`"]
    agg = src.groupBy(*dims).agg(*[F.expr(a) for a in aggs])
    step = []
    for m in measures:
        b, c = f"CAST(`_{m}_b` AS DOUBLE)", f"CAST(`_{m}_c` AS DOUBLE)"
        if resum:
            b, c = f"coalesce({b}, 0.0D)", f"coalesce({c}, 0.0D)"
        step += [f"{b} AS `_{m}_bb`", f"{c} AS `_{m}_cc`", f"coalesce(`_{m}_has`, false) AS `_{m}_h`"]
    mid = agg.selectExpr(*dsel, *step)
    cols = []
    for m in measures:
        gr = g(f"_{m}_bb", f"_{m}_cc")
        b, c = f"`_{m}_bb`", f"`_{m}_cc`"
        if wide == "sum":
            b, c, gr = (f"coalesce({x}, 0.0D)" for x in (b, c, gr))
        cols += [f"CASE WHEN `_{m}_h` THEN {b} END AS `{m}_base`",
                 f"CASE WHEN `_{m}_h` THEN {c} END AS `{m}_current`",
                 f"CASE WHEN `_{m}_h` THEN {gr} END AS `{m}_growth`"]
    out = mid.selectExpr(*dsel, *cols)
    if fill is not None:
        out = out.na.fill(fill, subset=[f"{m}_{k}" for m in measures for k in METRICS])
    return out


def growth_pairs(df: DataFrame, pairs, scale: float = 1, digits: int | None = 3,
                 zero_base: str = "inf", prefix: str = "y", out: str = "growth_{b}_{c}") -> DataFrame:
    """Growth for consecutive year pairs over pivoted ``y<year>`` columns (GRW-4)."""
    cols = {out.format(b=b, c=c): growth(F.col(f"{prefix}{b}"), F.col(f"{prefix}{c}"),
                                         scale=scale, digits=digits, zero_base=zero_base)
            for b, c in pairs}
    return df.withColumns(cols)


def contribution(df: DataFrame, by, base: str = "base", gap_col: str = "gap",
                 out: str = "contribution") -> DataFrame:
    """gap / Σ base within ``by`` (GRW-6).

    The partition total is a grouped sum joined back (map-side partial
    aggregation) rather than a window, so a format holding a third of all
    rows is not sorted inside one task.
    """
    from comparo.operators.aggregate import partition_total

    with_total = partition_total(df, base, by, out="_total")
    return with_total.withColumn(out, contribution_of(
        F.col(gap_col).cast("double"), F.col("_total").cast("double"))).drop("_total")
