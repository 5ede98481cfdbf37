"""One closed month: year-over-year growth at every grain (RPT-1).

Tables (all like-for-like stores of the month):
total (measure rows) · format · province · province_format (2 decimals,
NULL -> 0) · store (format, store) · sector · section · family (sales and
units only, NULL growth -> 0) · store_sector · store_section ·
store_family (absent years count as 0) · leaf (years as columns).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.functions import labels as L
from comparo.operators.pivots import pivot_years
from comparo.plans.measures import LEAF_KEYS, comparable_cube
from comparo.plans.reports import Spec, report_hubs, run_spec, run_specs_one_pass
from comparo.session import materialize

P = tuple(L.PRODUCT_MEASURES)
LEAF_REQ = tuple(LEAF_KEYS)

SPECS = [
    Spec("total", ()),
    Spec("format", ("format",), wide="mean"),
    Spec("province", ("province",), wide="mean"),
    Spec("province_format", ("format", "province"), wide="sum", digits=2, fill=0.0),
    Spec("store", ("format", "store"), wide="mean", lead=("format",)),
    Spec("sector", ("sector",), measures=P, wide="sum"),
    Spec("section", ("section",), measures=P, wide="sum"),
    Spec("family", ("family",), measures=P, wide="sum"),
    Spec("store_sector", ("format", "store", "sector"), measures=P, resum=True,
         wide="sum", require=LEAF_REQ, levels=True),
    Spec("store_section", ("format", "store", "section"), measures=P, resum=True,
         wide="sum", require=LEAF_REQ, levels=True),
    Spec("store_family", ("format", "store", "family"), measures=P, resum=True,
         wide="sum", require=LEAF_REQ, levels=True),
]
SPEC = {s.name: s for s in SPECS}


def month_cube(measures: DataFrame, register: DataFrame, years, month: int, *,
               case_sensitive: bool = False) -> DataFrame:
    """Comparable rows of one month of the two years."""
    src = measures.filter(F.col("month") == F.lit(month)).filter(F.col("year").isin(*years))
    return comparable_cube(src, register, month, case_sensitive=case_sensitive)


def monthly_report(measures: DataFrame, register: DataFrame, name: str, years, month: int,
                   *, sort: bool = True) -> DataFrame:
    cube = month_cube(measures, register, years, month)
    if name == "leaf":
        return leaf_pivot(cube, years)
    return run_spec(cube, SPEC[name], years, sort=sort)


def leaf_pivot(cube: DataFrame, years) -> DataFrame:
    """Sales and units at the leaf grain with years as columns (table 12)."""
    dims = ["format", "store", "sector", "section", "family", "measure"]
    src = cube.filter(F.col("measure").isin(*L.PRODUCT_MEASURES))
    src = src.na.drop(subset=list(LEAF_KEYS))
    return pivot_years(src, dims, years)


def monthly_reports(measures: DataFrame, register: DataFrame, years, month: int, *,
                    one_pass: bool = True, reuse: str = "table", sort: bool = True) -> dict:
    """The twelve monthly tables. With ``one_pass`` every growth table comes
    from one roll-up of the cube (``plans.reports``), which is written by one job together with
    the cube's own rows for the leaf table (``reuse``, see ``session.materialize``)."""
    cube = month_cube(measures, register, years, month)
    if one_pass:
        lattice = report_hubs(cube, years, reuse=reuse)
        cube, out = lattice.input, run_specs_one_pass(lattice, SPECS, years, sort=sort)
    else:
        cube = materialize(cube, reuse)
        out = {s.name: run_spec(cube, s, years, sort=sort) for s in SPECS}
    out["leaf"] = leaf_pivot(cube, years)
    return out
