"""Year to date: growth of months 1..limit at every grain (RPT-2, RPT-3).

Every month of both years is filtered to the like-for-like stores of the
limit month. Store-level tables re-sum the monthly figures (an absent year
counts as 0); product tables keep absent years NULL before the sum-pivot.
Known difference kept as a switch: the original total and province x format
tables ignore the month limit (``limit_total=False`` reproduces that).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.functions import labels as L
from comparo.operators.aggregate import cube_sum
from comparo.operators.filters import ytd
from comparo.plans.measures import comparable_cube
from comparo.plans.reports import Spec, report_hubs, run_spec, run_specs_one_pass
from comparo.session import materialize

P = tuple(L.PRODUCT_MEASURES)

SPECS = [
    Spec("total", (), resum=True),
    Spec("format", ("format",), resum=True),
    Spec("province", ("province",), resum=True, wide="sum"),
    Spec("province_format", ("format", "province"), wide="sum", digits=2, fill=0.0),
    Spec("store", ("store",), resum=True, wide="sum"),
    Spec("sector", ("sector",), measures=P, wide="sum"),
    Spec("section", ("section",), measures=P, wide="sum"),
    Spec("family", ("family",), measures=P, wide="sum"),
    Spec("store_sector", ("store", "sector"), measures=P, wide="sum"),
    Spec("store_section", ("store", "section"), measures=P, wide="sum"),
    Spec("store_family", ("store", "family"), measures=P, wide="sum"),
]
SPEC = {s.name: s for s in SPECS}
# Single-format variant: the format table is grouped by measure only.
SINGLE_FORMAT_SPEC = Spec("measure_single_format", (), resum=True)
LEAF_DETAIL_KEYS = ["year", "month", "format", "store", "sector", "section", "family", "measure"]


def ytd_cube(measures: DataFrame, register: DataFrame, years, month_limit: int, *,
             limit: bool = True, case_sensitive: bool = False) -> DataFrame:
    src = measures.filter(F.col("year").isin(*years))
    if limit:
        src = ytd(src, month_limit)
    return comparable_cube(src, register, month_limit, case_sensitive=case_sensitive)


def ytd_report(measures: DataFrame, register: DataFrame, name: str, years, month_limit: int,
               *, limit_total: bool = True, sort: bool = True) -> DataFrame:
    if name == "measure_single_format":
        spec = SINGLE_FORMAT_SPEC
    else:
        spec = SPEC[name]
    limit = limit_total or name not in ("total", "province_format")
    cube = ytd_cube(measures, register, years, month_limit, limit=limit)
    return run_spec(cube, spec, years, sort=sort)


def first_format(cube: DataFrame) -> str | None:
    """The format of the cube's first row by year, month and store (one row to the driver)."""
    return cube.agg(F.min_by("format", F.struct("year", "month", "store_id", "format"))).first()[0]


def leaf_detail(measures: DataFrame, register: DataFrame, years, month_limit: int,
                *, skip_format: str | None = None) -> DataFrame:
    """Long table at the leaf grain (AGG-6). With ``skip_format`` the table is not produced, for any
    row, when the first format of the input is that one, as single-format report sets leave it out."""
    cube = ytd_cube(measures, register, years, month_limit)
    if skip_format is not None:
        found = first_format(cube)
        if found is not None and found.upper() == skip_format.upper():
            cube = cube.limit(0)
    cube = cube.filter(F.col("measure").isin(*L.PRODUCT_MEASURES))
    return cube_sum(cube, LEAF_DETAIL_KEYS).withColumn("value", F.col("value").cast("double"))


def ytd_reports(measures: DataFrame, register: DataFrame, years, month_limit: int, *,
                single_format: bool = False, one_pass: bool = True, reuse: str = "table",
                sort: bool = True) -> dict:
    cube = ytd_cube(measures, register, years, month_limit)
    specs = list(SPECS)
    if single_format:
        specs = [SINGLE_FORMAT_SPEC] + [s for s in specs
                                        if s.name not in ("total", "format", "province_format")]
    if one_pass:
        return run_specs_one_pass(report_hubs(cube, years, reuse=reuse), specs, years, sort=sort)
    cube = materialize(cube, reuse)
    return {s.name: run_spec(cube, s, years, sort=sort) for s in specs}
