"""Exported text reports -> the typed inputs of the long fact.

Report columns (after ``normalize_columns``): año, mes ('Enero 2024'),
direccion, punto_operacional ('12-NAME' or '12 NAME'), sector, seccion,
grupo_de_familia, 'ventas_c/impuesto' ('1.234,50'), venta_en_unidades;
tickets reports carry 'cant._tickets_por_local' ('12.345').
Every function is a single projection: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.functions.dates import month_from_name
from comparo.functions.text import (parse_locale_decimal, parse_locale_int, parse_thousands,
                                    store_id, token)
from comparo.operators.columns import normalize_columns

# FIXED VALUES: report headers as exported.
SALES_REPORT = ["Año", "Mes", "Direccion", "Punto Operacional", "Sector", "Seccion",
                "Grupo de Familia", "Ventas c/impuesto", "Venta en Unidades"]
TICKETS_REPORT = ["Año", "Mes", "Direccion", "Punto Operacional", "Indicadores",
                  "Cant. Tickets por Local"]


def _opt(df: DataFrame, name: str):
    return F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("string")


def lines_from_report(raw: DataFrame, *, sep: str = "-", on_error: str = "raise",
                      truncate_units: bool = True) -> DataFrame:
    """Sales/units report -> year, month, format, store_id, store, sector,
    section, family, sales, units. Sector/section may be absent (short
    report). ``on_error='raise'`` fails on a malformed number, 'null' keeps
    it as NULL (the value is then dropped by the fact builder)."""
    df = normalize_columns(raw, drop_suffix=None)
    units = parse_locale_int(F.col("venta_en_unidades"), truncate=truncate_units,
                             on_error=on_error)
    return df.select(
        F.col("año").try_cast("int").alias("year"),
        month_from_name(token("mes", 0)).alias("month"),
        F.col("direccion").alias("format"),
        store_id("punto_operacional", sep).alias("store_id"),
        F.col("punto_operacional").alias("store"),
        _opt(df, "sector").alias("sector"),
        _opt(df, "seccion").alias("section"),
        _opt(df, "grupo_de_familia").alias("family"),
        parse_locale_decimal(F.col("`ventas_c/impuesto`"), on_error=on_error,
                             dtype="decimal(24,6)").alias("sales"),
        units.cast("decimal(24,6)").alias("units"),
    )


def tickets_from_report(raw: DataFrame, *, sep: str = "-", on_error: str = "raise",
                        by_sector: bool = False) -> DataFrame:
    df = normalize_columns(raw, drop_suffix=None)
    value = "`cant._tickets_por_local`" if "cant._tickets_por_local" in df.columns \
        else "cantidad_de_tickets"
    cols = [F.col("año").try_cast("int").alias("year"),
            month_from_name(token("mes", 0)).alias("month"),
            F.col("direccion").alias("format"),
            store_id("punto_operacional", sep).alias("store_id"),
            F.col("punto_operacional").alias("store")]
    if by_sector:
        cols.append(F.col("sector"))
    return df.select(*cols, parse_thousands(F.col(value), on_error=on_error).alias("tickets"))


def history_from_reports(sales_raw: DataFrame, units_raw: DataFrame, tickets_raw: DataFrame,
                         *, sep: str = " ") -> DataFrame:
    """Monthly history reports (sales, units, tickets at store grain) -> one
    long store-grain fact with lower-case measures ('vct', 'vol', 'deb')."""
    def part(raw, value_col, measure, parse):
        df = normalize_columns(raw, drop_suffix=None)
        return df.select(
            F.col("año").try_cast("int").alias("year"),
            month_from_name(token("mes", 0)).alias("month"),
            F.col("direccion").alias("format"),
            store_id("punto_operacional", sep).alias("store_id"),
            F.col("punto_operacional").alias("store"),
            F.lit(measure).alias("measure"),
            parse(F.col(f"`{value_col}`")).cast("decimal(38,6)").alias("value"))

    keys = ["year", "month", "format", "store_id", "store", "measure"]
    both = (part(sales_raw, "ventas_c/impuesto", "vct",
                 lambda c: parse_locale_decimal(c, dtype="decimal(24,6)"))
            .unionByName(part(units_raw, "volumen", "vol",
                              lambda c: parse_locale_decimal(c, dtype="decimal(24,6)")))
            .unionByName(part(tickets_raw, "cant._tickets_por_local", "deb", parse_thousands)))
    return (both.filter(F.col("value").isNotNull()).na.drop(subset=keys[:5])
            .groupBy(*keys).agg(F.sum("value").cast("decimal(38,6)").alias("value")))
