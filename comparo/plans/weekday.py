"""Weekday enrichment of a daily report (RPT-11): year, month, day, date,
English and Spanish weekday names; with a store column, the register's
comparability flag of a month is attached (upper-cased)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.functions.dates import date_of, month_from_name, weekday_es, weekday_name
from comparo.functions.labels import month_column
from comparo.functions.text import store_id, token
from comparo.operators.columns import normalize_columns
from comparo.operators.joins import with_register


def weekday_enrich(report: DataFrame, register: DataFrame | None = None, month=None,
                   day_col: str = "dia", store_col: str = "punto_operacional") -> DataFrame:
    df = normalize_columns(report, drop_suffix=None)
    df = df.withColumns({
        "year": token(day_col, 4),
        "month_name": token(day_col, 2),
        "day": token(day_col, 0),
    })
    df = df.withColumn("date", date_of(F.col("year"), month_from_name("month_name"), F.col("day")))
    df = df.withColumns({"weekday": weekday_name("date"), "weekday_es": weekday_es("date")})
    if register is not None and store_col in df.columns:
        flag = month_column(month)
        reg = (register.na.drop(subset=["store_id", "name", flag])
               .select(F.col("store_id").alias("no"), F.upper(flag).alias(flag)))
        df = df.withColumn("no", store_id(store_col, " "))
        df = with_register(df, reg, on="no", how="left")
    return df
