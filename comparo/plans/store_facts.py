"""Store facts joined to the register (RPT-6 comparable, RPT-7 all stores).

Register preparation, in this order: organisation lower-cased and limited
to physical formats (FLT-5) -> first row per store id in file order (DED-1)
-> rows missing id, name or opening date dropped (FLT-1; a store whose first
row is incomplete disappears) -> closing date parsed (DAT-2) and bucketed
by age (CND-1) -> 'express' read as 'proximidad' (CND-6). The fact, at
store grain with its format lower-cased, is left-joined on (store id,
format) (JN-2); the comparable variant keeps flag == 'SC' exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.functions import labels as L
from comparo.functions.dates import closure_bucket, format_date, parse_date
from comparo.functions.labels import month_column
from comparo.functions.text import unify
from comparo.operators.filters import physical_formats
from comparo.operators.joins import first_per_key, with_register

REGISTER_COLS = ["store_id", "name", "open_date", "org", "province", "m_salon", "close_raw",
                 *L.MONTH_COLUMNS]


def register_physical(register: DataFrame, *, order: str | None = None,
                      as_of=None) -> DataFrame:
    cols = [c for c in REGISTER_COLS if c in register.columns]
    reg = register.select(*cols, *([order] if order else []))
    reg = reg.withColumn("org", F.lower("org"))
    reg = physical_formats(reg, "org", L.REGISTER_FORMATS)
    if order:
        reg = first_per_key(reg, "store_id", order)
    reg = reg.na.drop(subset=["store_id", "name", "open_date"])
    reg = reg.withColumn("close_date", parse_date("close_raw", "MM/dd/yyyy"))
    if as_of is not None:
        reg = reg.withColumn("life", closure_bucket("close_date", as_of))
    return reg.withColumn("format", unify("org", L.FORMAT_UNIFY)).drop("org")


def store_facts(fact: DataFrame, register: DataFrame, month, *, comparable: bool = True,
                as_of=None, order: str | None = "row_order") -> DataFrame:
    """``fact``: year, month, format, store_id, store, measure, value at store grain."""
    flag = month_column(month)
    f = fact.withColumn("format", F.lower("format"))
    f = f.filter(F.col("format").isin(*L.REPORT_FORMATS))
    reg = register_physical(register, order=order, as_of=as_of)
    reg = reg.select("store_id", "format",
                     format_date("open_date", "dd/MM/yyyy").alias("open_date"),
                     "close_date", F.col("m_salon").try_cast("double").alias("m_salon"),
                     "province", F.col(flag).alias("surface"),
                     *(["life"] if as_of is not None else []))
    j = with_register(f, reg, on=["store_id", "format"], how="left")
    if as_of is not None:
        j = j.withColumn("life", F.coalesce(F.col("life"), F.lit(L.OPEN_STORE)))
    j = j.withColumn("month_name", F.get(F.array(*[F.lit(m) for m in L.MONTHS_ES]),
                                         F.col("month") - 1))
    if comparable:
        j = j.filter(F.col("surface") == F.lit("SC"))
    return j
