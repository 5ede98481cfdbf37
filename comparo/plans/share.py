"""Market share: wide monthly panel -> long table of the last closed month
(RPT-12).

Date headers become '<mes> <year>' (PRJ-4); a missing store number becomes
'RESTO' (CND-5); the size label keeps the range after the first '-'
(STR-9); months are unpivoted (UNP-4); zero or missing sales are dropped
(FLT-10); sales are truncated to integers and shown in millions (MET-5);
'<own brand> <format>' labels become '<format>' (PRJ-5); the month date is
built (DAT-1) and the last closed month kept (FLT-9).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.functions import labels as L
from comparo.functions.dates import last_closed_month, month_start
from comparo.functions.numeric import in_millions
from comparo.functions.text import map_values, rest_label, size_range
from comparo.operators.columns import rename_month_headers
from comparo.operators.filters import nonzero
from comparo.operators.pivots import unpivot

IDS = ["area", "region", "subregion", "formato_m2", "marca", "formato", "numero_operacional"]


def share_labels(panel: DataFrame, brand: str) -> DataFrame:
    """Identifier columns renamed and cleaned."""
    named = rename_month_headers(panel.toDF(*[c.lower() if not c[:4].isdigit() else c
                                              for c in panel.columns]))
    renames = {**L.SHARE_HEADERS, f"mdo {brand.lower()}": "marca",
               f"bandera {brand.lower()}": "formato"}
    df = named.withColumnsRenamed(renames)
    own = {f"{brand} {f}": f for f in L.SHARE_FORMATS}
    return df.withColumns({
        "numero_operacional": rest_label("numero_operacional"),
        "formato_m2": size_range("formato_m2"),
        "formato": map_values("formato", own, keep_unmapped=True),
    })


def share_long(panel: DataFrame, brand: str, drop=tuple(L.SHARE_YTD_COLUMNS)) -> DataFrame:
    df = share_labels(panel, brand).drop(*drop)
    months = [c for c in df.columns if c not in IDS]
    long = unpivot(df.select(*[F.col(f"`{c}`") for c in IDS + months]), IDS, months, "fecha",
                   "ventas_con_tasa")
    long = nonzero(long, "ventas_con_tasa")
    # '<mes> <year>' header: first and last word (plain substrings keep the
    # projection inside whole-stage codegen)
    mes = F.substring_index(F.col("fecha"), " ", 1)
    anio = F.substring_index(F.col("fecha"), " ", -1)
    month_no = F.nullif(F.array_position(F.array(*[F.lit(m) for m in L.MONTHS_ES]),
                                         F.initcap(mes)), F.lit(0)).cast("int")
    v = F.col("ventas_con_tasa").cast("bigint")
    return long.select(*IDS, mes.alias("mes"), anio.alias("anio"), v.alias("ventas_con_tasa"),
                       in_millions(v).alias("ventas_con_tasa_millones"),
                       month_start(anio, month_no).alias("fecha_final"))


def share_last_closed_month(panel: DataFrame, brand: str, as_of) -> DataFrame:
    return share_long(panel, brand).filter(F.col("fecha_final") == last_closed_month(as_of))
