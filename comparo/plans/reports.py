"""Report specifications shared by the monthly and year-to-date plans.

A report is one grain of the comparable cube with its own NULL policy
(see ``operators.growth``). Specs are data; ``run_spec`` turns one into a
DataFrame, ``run_specs_one_pass`` computes many from one roll-up of the cube.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.functions import labels as L
from comparo.operators.growth import growth_table
from comparo.operators.lattice import Hubs
from comparo.plans.measures import LEAF_KEYS
from comparo.operators.sorts import order_by_growth


@dataclass(frozen=True)
class Spec:
    name: str
    dims: tuple
    measures: tuple = tuple(L.MEASURES)
    resum: bool = False
    wide: str | None = None
    digits: int = 1
    fill: float | None = None
    require: tuple = ()
    lead: tuple = ()            # descending lead keys of the final order
    levels: bool = False        # order by all keys desc (store x product)


def run_spec(cube: DataFrame, spec: Spec, years, *, value: str = "value",
             sort: bool = True) -> DataFrame:
    out = growth_table(cube, spec.dims, years, measures=spec.measures, value=value,
                       resum=spec.resum, wide=spec.wide, digits=spec.digits,
                       fill=spec.fill, require=spec.require)
    return order_spec(out, spec) if sort else out


def order_spec(df: DataFrame, spec: Spec) -> DataFrame:
    if spec.wide is None:
        return df.orderBy(*[F.asc(c) for c in spec.dims], F.asc("measure"))
    if spec.levels:
        return df.orderBy(*[F.desc(c) for c in spec.dims],
                          F.desc_nulls_last(f"{L.UNITS}_growth"))
    return order_by_growth(df, L.UNITS, lead=spec.lead,
                           ties=[c for c in spec.dims if c not in spec.lead])


#: What the tables of one closed month or year to date are summed from: one row per store and product level.
HUBS = (("format", "province", "store", "sector"), ("format", "province", "store", "section"),
        ("format", "province", "store", "family"), ("format", "province", "store"))


def report_hubs(cube: DataFrame, years, *, reuse: str = "table", hubs=HUBS) -> Hubs:
    """The cube's rows of `years` and its hubs; `value_leaf` sums only rows whose leaf keys are all present."""
    leaf_ok = None
    for k in LEAF_KEYS:
        c = F.col(k).isNotNull()
        leaf_ok = c if leaf_ok is None else leaf_ok & c
    src = cube.filter(F.col("year").isin(*years)).withColumn(
        "value_leaf", F.when(leaf_ok, F.col("value")))
    return Hubs(src, hubs, values=("value", "value_leaf"), reuse=reuse)


def run_specs_one_pass(lattice: Hubs, specs, years, *, sort: bool = True) -> dict:
    """All specs from one roll-up of the cube (:func:`report_hubs`): store tables and all coarser ones read hub rows.
    Grains with ``require`` sum only rows whose leaf keys are all present."""
    out = {}
    for s in specs:
        part = lattice.covering(s.dims)
        value = "value"
        if s.require:
            part = part.filter(F.col("value_leaf").isNotNull())
            value = "value_leaf"
        out[s.name] = run_spec(part, Spec(**{**s.__dict__, "require": ()}), years,
                               value=value, sort=sort)
    return out
