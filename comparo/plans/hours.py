"""Sunday extended-hours profitability (RPT-10).

Half-hour sales (wide, one column per store) are unpivoted, dated and
limited to Sundays; sales in slots outside the store's previous opening
hours are the extended-hours sales. Authorised hours per month give hours
per Sunday, the April-May baseline and the extra hours; margin ratio, staff
cost and a variable-cost share turn the extra sales into an operating
result (ROC). The final table is one row per store with 15 metrics x month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.functions import labels as L
from comparo.functions.dates import date_of, month_from_name, month_name, opening_hours, period_month
from comparo.functions.dates import time_minutes, weekday_name
from comparo.functions.numeric import net_of_tax, variable_cost
from comparo.functions.text import parse_locale_decimal, slot_start, store_id, token
from comparo.operators.aggregate import count_distinct_by
from comparo.operators.columns import rename_month_headers
from comparo.operators.filters import drop_null_columns, drop_totals, on_weekday, outside_hours
from comparo.operators.joins import attach, distinct_pairs
from comparo.operators.pivots import pivot_values, unpivot
from comparo.session import materialize

# FIXED VALUES: id columns and metrics of the report, in its order.
IDS = ["no", "nombre", "localidad", "zona", "gerente regional", "domingos", "horario_anterior"]
MONTHS_LOWER = [m.lower() for m in L.MONTHS_EN]
# Months of the final table, calendar order, as in the original report.
REPORT_MONTHS = MONTHS_LOWER[3:12]
METRICS = ["horas_autorizadas", "cantidad_domingos", "horas_por_domingo",
           "horas_promedio_abril_y_mayo", "crecimiento_horas_domingo",
           "horas_adicionales_por_domingo", "horas_adicionales_total_mes", "vct", "vst",
           "ratio_margen", "margen", "gastos_variables", "costo_hora_hombre",
           "gasto_de_personal", "roc"]
TWO_DIGITS = ("ratio_margen", "crecimiento_horas_domingo")


def _month_lower(date_col) -> F.Column:
    return F.lower(month_name(date_col))


def slot_sales(wide: DataFrame, id_cols=("year", "date_text", "slot_text")) -> DataFrame:
    """Wide half-hour report -> one row per (date, slot, store) with sales
    (FLT-8, UNP-2, STR-1/5/7/8, DAT-1/4). The stores are columns, or one map column ``cells``."""
    ids = list(id_cols)
    stores = [c for c in wide.columns if c not in ids]
    body = drop_totals(wide, ["year"])                          # 'Total' rows (FLT-8)
    body = body.filter(F.col("year").rlike(r"^\d{4}$"))       # the sub-header row
    values = "cells" if stores == ["cells"] else stores
    long = unpivot(body.select(*ids, *[F.col(f"`{c}`").alias(c) for c in stores]), ids, values,
                   "store_label", "vct_text", drop_nulls=True)
    date = date_of(token("date_text", 4), month_from_name(token("date_text", 2)),
                   token("date_text", 0))
    return long.select(
        store_id("store_label", " ").alias("store_id"), "store_label",
        date.alias("date"),
        time_minutes(slot_start("slot_text")).alias("slot_start"),
        parse_locale_decimal("vct_text").alias("vct"),
    ).withColumns({"weekday": weekday_name("date"), "month": _month_lower("date")})


def sundays(slots: DataFrame) -> DataFrame:
    return on_weekday(slots, "date", "Sunday")


def sunday_slots(wide: DataFrame) -> DataFrame:
    """The Sunday slots of the wide report, unpivoted once and written: counts, sales and the last month read them."""
    return materialize(sundays(slot_sales(wide)), name="sundays")


def sundays_per_month(sunday_slots: DataFrame) -> DataFrame:
    """Distinct Sundays per month (AGG-3)."""
    return count_distinct_by(sunday_slots, "date", "month", out="cantidad_domingos")


def monthly_long(wide: DataFrame, value: str, ids=IDS) -> DataFrame:
    """Wide monthly sheet -> (ids, month, value): columns with gaps dropped
    (FLT-2), date headers renamed to month names (PRJ-4), unpivot (UNP-3)."""
    clean = rename_month_headers(drop_null_columns(wide), style="month_lower")
    months = [c for c in clean.columns if c in MONTHS_LOWER]
    keep = [c for c in ids if c in clean.columns]
    return unpivot(clean.select(*[F.col(f"`{c}`") for c in keep + months]), keep, months,
                   "mes", value)


def staff_cost(wide: DataFrame) -> DataFrame:
    """Hourly staff cost per store-month, sign flipped to an expense."""
    return monthly_long(wide, "costo_hora_hombre").withColumn(
        "costo_hora_hombre", -F.col("costo_hora_hombre"))


def margin(long: DataFrame) -> DataFrame:
    """Margin and net sales per (store, month) from the long export (PIV-7):
    amounts parsed first, then pivoted; ratio = margin / sales (MET-1)."""
    amt = F.replace(F.col("importe"), F.lit(","), F.lit(".")).try_cast("double")
    src = long.withColumn("amount", amt)
    wide = pivot_values(src, ["Periodo", "Tienda"], "rubro",
                        ["MARGEN COMERCIAL", "VENTA SIN TASA"], "amount",
                        names=["margen_comercial", "venta_sin_tasa"])
    wide = wide.withColumns({
        "margen_comercial": F.bround("margen_comercial", 2),
        "venta_sin_tasa": F.bround(F.coalesce("venta_sin_tasa", F.lit(0.0)), 2)})
    wide = wide.withColumn("ratio_margen", F.bround(
        F.try_divide(F.col("margen_comercial"), F.col("venta_sin_tasa")), 2))
    wide = wide.na.fill(0.0, subset=["margen_comercial", "venta_sin_tasa", "ratio_margen"])
    month = F.get(F.array(*[F.lit(m) for m in MONTHS_LOWER]), period_month("Periodo") - 1)
    return wide.select(F.col("Tienda").try_cast("bigint").alias("no"), month.alias("mes"),
                       "margen_comercial", "venta_sin_tasa", "ratio_margen")


def baseline_hours(hours_long: DataFrame, months=("april", "may"), weeks: int = 4) -> DataFrame:
    """Mean authorised hours over the baseline months / 4, 2 decimals (AGG-4)."""
    return (hours_long.filter(F.col("mes").isin(*months)).groupBy("no")
            .agg(F.bround(F.avg("horas") / F.lit(float(weeks)), 2)
                 .alias("horas_promedio_abril_y_mayo")))


def hours_metrics(hours_long: DataFrame, n_sundays: DataFrame) -> DataFrame:
    """Hours per Sunday, baseline, hour growth and extra hours (MET-4, JN-5)."""
    h = attach(hours_long, n_sundays.withColumnRenamed("month", "mes"), on="mes",
               broadcast="bounded")          # at most one row per month
    h = h.withColumn("horas_por_domingo",
                     F.bround(F.try_divide(F.col("horas"), F.col("cantidad_domingos")), 1))
    h = attach(h, baseline_hours(hours_long), on="no")
    base = F.col("horas_promedio_abril_y_mayo")
    h = h.withColumns({
        "crecimiento_horas_domingo": F.bround(F.try_divide(F.col("horas_por_domingo"), base) - 1, 2),
        "horas_adicionales_por_domingo": F.col("horas_por_domingo") - base})
    return h.withColumn("horas_adicionales_total_mes",
                        F.col("horas_adicionales_por_domingo") * F.col("cantidad_domingos"))


def opening(hours_long: DataFrame) -> DataFrame:
    """Distinct (store, previous opening hours) -> opening/closing minutes
    (DED-2, DAT-6)."""
    pairs = distinct_pairs(hours_long, ["no", "horario_anterior"])
    o, c = opening_hours("horario_anterior")
    return pairs.select("no", o.alias("open_min"), c.alias("close_min"))


def outside_hours_sales(sunday_slots: DataFrame, opening_df: DataFrame) -> DataFrame:
    """Sunday sales in slots outside opening hours, per store and month
    (JN-6 inner join, FLT-12, AGG-1)."""
    j = attach(sunday_slots.withColumnRenamed("store_id", "no"), opening_df, on="no", how="inner")
    j = j.filter(F.col("open_min").isNotNull())
    return (outside_hours(j).groupBy("no", "month")
            .agg(F.sum("vct").cast("double").alias("vct")))


def operating_result(wide_slots: DataFrame, staff_wide: DataFrame, hours_wide: DataFrame,
                     margin_export: DataFrame, *, vat_rate: str = L.VAT_RATE,
                     variable_rate: str = L.VARIABLE_COST_RATE, slots: DataFrame | None = None) -> DataFrame:
    """Per (store, month): the 15 metrics, rounded (MET-2/3/6). ``slots``: the Sunday slots, if
    the caller has them (:func:`sunday_slots`)."""
    slots = sunday_slots(wide_slots) if slots is None else slots
    n_sun = sundays_per_month(slots)
    hours_long = materialize(monthly_long(hours_wide, "horas"), name="hours")     # read for hours, baseline and openings
    h = hours_metrics(hours_long, n_sun)
    ext = outside_hours_sales(slots, opening(hours_long)).withColumnRenamed("month", "mes")
    h = attach(h, ext, on=["no", "mes"]).withColumn("vct", F.coalesce("vct", F.lit(0.0)))
    h = h.withColumn("vst", net_of_tax(F.col("vct"), vat_rate).cast("double"))
    h = attach(h, margin(margin_export).select("no", "mes", "ratio_margen"), on=["no", "mes"])
    h = h.withColumns({
        "margen": F.bround(F.col("vst") * F.col("ratio_margen"), 2),
        "gastos_variables": variable_cost(F.col("vst"), variable_rate).cast("double")})
    h = attach(h, staff_cost(staff_wide).select("no", "mes", "costo_hora_hombre"), on=["no", "mes"])
    h = h.withColumn("gasto_de_personal",
                     F.col("horas_adicionales_total_mes") * F.col("costo_hora_hombre"))
    h = h.withColumn("roc", F.bround(F.col("margen") + F.col("gastos_variables")
                                     + F.col("gasto_de_personal"), 2))
    h = h.withColumnsRenamed({"horas": "horas_autorizadas", "domingos": "horario_domingo"})
    rounded = {m: F.bround(F.col(m).cast("double"), 2 if m in TWO_DIGITS else 1) for m in METRICS}
    keys = ["no", "nombre", "localidad", "zona", "gerente regional", "horario_domingo",
            "horario_anterior", "mes"]
    return h.select(*[F.col(f"`{k}`") for k in keys], *[v.alias(k) for k, v in rounded.items()])


def hours_wide(result: DataFrame, months=REPORT_MONTHS) -> DataFrame:
    """One row per store, ``<metric>_<month>`` columns in calendar order
    (PIV-8); months outside ``months`` are left out. A store-month that is
    there without a value sums to 0.0, one that is not there stays NULL."""
    keys = ["no", "nombre", "localidad", "zona", "gerente regional", "horario_domingo",
            "horario_anterior"]
    aggs = [F.sum(F.when(F.col("mes") == mo, F.coalesce(F.col(me), F.lit(0.0)))).alias(f"{me}_{mo}")
            for me in METRICS for mo in months]
    return result.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*aggs)


def last_sales_month(sunday_slots: DataFrame, months=REPORT_MONTHS) -> str:
    """The latest of ``months`` with sales (one row to the driver: it names the
    column the report is sorted by); the last of them if none has any."""
    day = sunday_slots.filter(F.col("month").isin(*months)).agg(F.max("date")).first()[0]
    return months[-1] if day is None else MONTHS_LOWER[day.month - 1]


def order_by_last_month(wide: DataFrame, month: str, metric: str = "roc") -> DataFrame:
    """Ascending by the metric of the last month (SRT-6)."""
    return wide.orderBy(F.asc_nulls_last(f"{metric}_{month}"), F.asc("no"))


def presented(wide: DataFrame, months=REPORT_MONTHS) -> DataFrame:
    """Report headers: metric, then the Spanish month (PRJ-5), capitals first."""
    spanish = dict(zip(MONTHS_LOWER, L.MONTHS_ES))
    months_of = {f"{me}_{mo}": (me, f" {spanish[mo]}") for me in METRICS for mo in months}
    parts = [months_of.get(c, (c, "")) for c in wide.columns]
    return wide.toDF(*[name.replace("_", " ").capitalize() + month for name, month in parts])


def extended_hours(wide_slots: DataFrame, staff_wide: DataFrame, hours_wide_sheet: DataFrame,
                   margin_export: DataFrame, months=REPORT_MONTHS) -> DataFrame:
    """The whole report (RPT-10): one row per store, 15 metrics x month,
    ordered by the ROC of the last month with sales, Spanish headers."""
    slots = sunday_slots(wide_slots)
    result = operating_result(wide_slots, staff_wide, hours_wide_sheet, margin_export, slots=slots)
    last = last_sales_month(slots, months)
    return presented(order_by_last_month(hours_wide(result, months), last), months)
