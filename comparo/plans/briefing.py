"""Weekly briefing (RPT-8) and its rolling-period variant (RPT-9).

Growth is a fraction with 3 decimals. The comparison axis is a column with
two labels: calendar years (base, current) or the period split
('old', 'new') of ``functions.dates.period_split``. Comparability is the
register's month flag compared exactly (no upper-casing); register rows
without id, name or flag are ignored.

Tables: store growth (comparable / all stores) · format growth (re-summed
from stores) · store x sector growth · sector matrices (store and format,
sectors as columns, NULL -> 0) · consolidated store matrix
(<measure>_<sector> columns, 'Total' = the store total) · family gap,
growth and contribution · four-level consolidated base · monthly history
with two consecutive-year growths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.functions import labels as L
from comparo.functions.dates import month_start
from comparo.functions.labels import month_column
from comparo.functions.numeric import NEG_INF
from comparo.operators.filters import drop_null_keys
from comparo.operators.growth import contribution, growth_pairs, growth_table
from comparo.operators.joins import attach, with_register
from comparo.operators.pivots import pivot_years
from comparo.operators.sets import union_levels
from comparo.operators.sorts import order_by
from comparo.session import materialize

STORE = ["format", "store_id", "store"]
TOTAL = "Total"


def comparable_slice(fact: DataFrame, register: DataFrame, month) -> DataFrame:
    """fact ⟕ register, flag == 'SC' exactly (JN-3 + FLT-4, case-sensitive)."""
    flag = month_column(month)
    reg = (register.na.drop(subset=["store_id", "name", flag])
                   .filter(F.col(flag) == F.lit("SC")).select("store_id"))
    return with_register(fact, reg, how="inner")


def _g(df, dims, axis, labels, resum=False, measures=None):
    return growth_table(df, dims, labels, measures=measures or _measures(df), year=axis,
                        resum=resum, scale=1, digits=3)


def _measures(df):
    return ("deb", "vct", "vol")


def store_growth(fact: DataFrame, axis: str = "year", labels=(2000, 2001),
                 sort: bool = False) -> DataFrame:
    """Per store and measure: base, current, growth (absent side -> NULL);
    ``sort``: growth descending (SRT-5)."""
    out = _g(fact, STORE, axis, labels)
    return order_by(out, "growth", ties=STORE + ["measure"]) if sort else out


def format_growth(fact: DataFrame, axis: str = "year", labels=(2000, 2001),
                  sort: bool = False) -> DataFrame:
    """Per format: store figures re-summed (absent side counts 0); ``sort``:
    by measure."""
    out = _g(drop_null_keys(fact, STORE), ["format"], axis, labels, resum=True)
    return out.orderBy("measure", "format") if sort else out


def store_sector_growth(sector_fact: DataFrame, axis: str = "year", labels=(2000, 2001)) -> DataFrame:
    return _g(sector_fact, STORE + ["sector"], axis, labels)


def _sector_wide(long: DataFrame, dims, sectors, value: str = "growth") -> DataFrame:
    """Sectors -> columns; a (row, sector) pair that exists reads NULL as 0."""
    aggs = [F.when(F.max(F.col("sector") == s),
                   F.coalesce(F.sum(F.when(F.col("sector") == s, F.col(value))), F.lit(0.0)))
             .alias(s.replace(" ", "_")) for s in sectors]
    return long.groupBy(*dims).agg(*aggs)


def format_sector_matrix(sector_fact: DataFrame, sectors, axis: str = "year",
                         labels=(2000, 2001)) -> DataFrame:
    """Format x measure with one growth column per sector (PIV-4), NULL -> 0."""
    g = _g(drop_null_keys(sector_fact, STORE + ["sector"]), ["format", "sector"], axis, labels,
           resum=True)
    return _sector_wide(g, ["format", "measure"], sectors).na.fill(0.0)


def store_sector_matrix(sector_fact: DataFrame, fact: DataFrame, sectors, axis: str = "year",
                        labels=(2000, 2001)) -> DataFrame:
    """Store x measure, one growth column per sector plus the store total
    (JN-4), everything NULL -> 0."""
    wide = _sector_wide(store_sector_growth(sector_fact, axis, labels),
                        ["store_id", "store", "measure"], sectors)
    tot = store_growth(fact, axis, labels).select(
        "store_id", "measure", "format", F.col("growth").alias("total_store"))
    out = attach(wide, tot, on=["store_id", "measure"], how="left")
    return order_by(out.na.fill(0.0).drop("store_id"), "total_store", ties=["store", "measure"])


def consolidated_matrix(sector_fact: DataFrame, fact: DataFrame, sectors,
                        axis: str = "year", labels=(2000, 2001)) -> DataFrame:
    """(format, store) rows, <measure>_<sector> growth columns incl. the
    store total as sector 'Total' (SET-4 + PIV-5)."""
    ss = store_sector_growth(sector_fact, axis, labels).select(*STORE, "measure", "sector", "growth")
    st = store_growth(fact, axis, labels).select(*STORE, "measure", F.lit(TOTAL).alias("sector"),
                                                "growth")
    both = ss.unionByName(st).withColumn("key", F.concat_ws("_", "measure", "sector"))
    keys = [f"{m}_{s}" for m in _measures(fact) for s in [*sectors, TOTAL]]
    aggs = [F.when(F.max(F.col("key") == k),
                   F.coalesce(F.sum(F.when(F.col("key") == k, F.col("growth"))), F.lit(0.0)))
             .alias(k.replace(" ", "_")) for k in keys]
    return both.groupBy("format", "store").agg(*aggs)


def family_contribution(units_fact: DataFrame, axis: str = "year", labels=(2000, 2001)) -> DataFrame:
    """Units per (format, family, section): base (absent -> 0), current,
    gap, unrounded growth (+inf and 0/0 -> 0) and contribution = gap / Σ
    base of the format (NULL -> 0) (GRW-5/6/8, AGG-5)."""
    dims = ["format", "family", "section", "measure"]
    keys = dims + [c for c in ("sector",) if c in units_fact.columns]
    src = drop_null_keys(units_fact.filter(F.col(axis).isin(*labels)), keys)
    agg = src.groupBy(*dims).agg(
        F.sum(F.when(F.col(axis) == labels[0], F.col("value"))).alias("_b"),
        F.sum(F.when(F.col(axis) == labels[1], F.col("value"))).alias("_c"))
    # written once: the format totals are sums of these rows, not of the lines again
    agg = materialize(agg, name="family-units")
    # the format total is summed exactly (DECIMAL) before the division
    agg = agg.withColumn("_b", F.coalesce(F.col("_b"), F.lit(0).cast("decimal(38,6)")))
    agg = agg.withColumn("_gap", F.col("_c").cast("double") - F.col("_b").cast("double"))
    agg = contribution(agg, "format", base="_b", gap_col="_gap")
    b, c = F.col("_b").cast("double"), F.col("_c").cast("double")
    growth = (F.when(c.isNull(), F.lit(0.0))
              .when(b == 0, F.when(c < 0, NEG_INF()).otherwise(F.lit(0.0)))
              .otherwise(c / b - F.lit(1.0)))
    out = agg.select(*dims, b.alias("base"), c.alias("current"), F.col("_gap").alias("gap"),
                     growth.alias("growth"), "contribution")
    return order_by(out, "contribution", ties=dims)             # SRT-5


def four_levels(fact: DataFrame, sector_fact: DataFrame, axis: str = "year",
                labels=(2000, 2001)) -> DataFrame:
    """Store, format, store x sector and format x sector growth in one long
    table tagged by ``level`` (SET-5); missing keys are NULL."""
    store = store_growth(fact, axis, labels)
    fmt = format_growth(fact, axis, labels)
    ss = store_sector_growth(sector_fact, axis, labels)
    fs = _g(drop_null_keys(sector_fact, STORE + ["sector"]), ["format", "sector"], axis, labels,
            resum=True)
    out = union_levels({"tienda": store, "formato": fmt, "tienda_sector": ss, "formato_sector": fs})
    return out.select("level", "format", "store_id", "store", "measure", "sector",
                      "base", "current", "growth")


def history_growth(hist: DataFrame, years, pairs, bound_year: int, bound_month: int,
                   register: DataFrame | None = None, month=None) -> DataFrame:
    """Monthly history per format and measure: three years as columns and
    the growth of each consecutive pair (fraction, 3 decimals); months after
    the bound month of the bound year are dropped (FLT-7, GRW-4, SRT-4)."""
    src = hist.filter(F.col("year").isin(*years))
    if register is not None:
        src = comparable_slice(src, register, month)
    src = src.withColumn("month_start", month_start("year", "month"))
    src = src.filter(F.col("month_start") <= F.make_date(F.lit(bound_year), F.lit(bound_month),
                                                         F.lit(1)))
    wide = pivot_years(src, ["format", "month", "measure"], years)
    wide = growth_pairs(wide, pairs, scale=1, digits=3, out="growth_{c}")
    wide = wide.withColumn("month_name", F.get(F.array(*[F.lit(m) for m in L.MONTHS_ES]),
                                               F.col("month") - 1))
    return wide.orderBy("format", "measure", "month")          # calendar order (SRT-4)


def briefing_reports(store_fact: DataFrame, sector_fact: DataFrame, units_fact: DataFrame,
                     register: DataFrame, month, sectors, *, axis: str = "year",
                     labels=(2000, 2001), history: DataFrame | None = None,
                     history_years=None, history_pairs=None, bound=None) -> dict:
    """Every briefing table (RPT-8; RPT-9 with ``axis='period'``) as a dict.

    ``store_fact`` / ``sector_fact`` / ``units_fact``: long facts with
    lower-case measures at store, store x sector and product-leaf grain for
    the briefing period; ``history``: store-grain monthly facts. Write the
    dict with ``write_report_set(..., partition_by=['format'])`` to get one
    output per format as the original per-format workbooks.
    """
    c_store = comparable_slice(store_fact, register, month)
    c_sector = comparable_slice(sector_fact, register, month)
    c_units = comparable_slice(units_fact, register, month)
    out = {
        "store_comparable": store_growth(c_store, axis, labels, sort=True),
        "store_all": store_growth(store_fact, axis, labels, sort=True),
        "format_comparable": format_growth(c_store, axis, labels, sort=True),
        "format_all": format_growth(store_fact, axis, labels, sort=True),
        "format_sector": format_sector_matrix(c_sector, sectors, axis, labels),
        "store_sector_matrix": store_sector_matrix(c_sector, c_store, sectors, axis, labels),
        "consolidated_matrix": consolidated_matrix(c_sector, c_store, sectors, axis, labels),
        "family_contribution": family_contribution(c_units, axis, labels),
        "four_levels": four_levels(c_store, c_sector, axis, labels),
    }
    if history is not None:
        by, bm = bound
        out["history_comparable"] = history_growth(history, history_years, history_pairs, by, bm,
                                                   register=register, month=month)
        out["history_all"] = history_growth(history, history_years, history_pairs, by, bm)
    return out
