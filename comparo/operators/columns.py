"""Column-name operators (metadata only: no data movement)."""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import DataFrame

from comparo.functions import labels as L


def normalize_name(name: str, drop_suffix: str | None = ".2") -> str:
    """' Ventas c/impuesto ' -> 'ventas_c/impuesto'; 'M² SALÓN' -> 'm_salón';
    'ENE.2' -> 'ene' (PRJ-1)."""
    n = name.strip().lower().replace(" ", "_").replace("m²", "m")
    if drop_suffix and n.endswith(drop_suffix):
        n = n[: -len(drop_suffix)]
    return n


def normalize_columns(df: DataFrame, renames: dict | None = None,
                      drop_suffix: str | None = ".2") -> DataFrame:
    names = [normalize_name(c, drop_suffix) for c in df.columns]
    out = df.toDF(*names)
    return out.withColumnsRenamed(renames) if renames else out


def present_name(name: str) -> str:
    """'m_pgc' -> 'M pgc', 'p.g.c.' -> 'PGC' (PRJ-3)."""
    n = name.replace("_", " ")
    n = n[:1].upper() + n[1:].lower()
    return re.sub(r"(?i)p\.g\.c\.", "PGC", n)


def present_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[present_name(c) for c in df.columns])


def month_header(value, translate: bool = True, style: str = "month_year") -> str:
    """Date-typed header -> '<Month> <year>' (PRJ-4), or with
    ``style='month_lower'`` the lower-case English month ('january');
    text headers are kept (month names translated to Spanish)."""
    if isinstance(value, (_dt.date, _dt.datetime)):
        if style == "month_lower":
            return L.MONTHS_EN[value.month - 1].lower()
        names = L.MONTHS_ES if translate else L.MONTHS_EN
        return f"{names[value.month - 1]} {value.year}"
    s = str(value)
    m = re.fullmatch(r"(\d{4})-(\d{2})-\d{2}(?:[ T]00:00:00)?", s.strip())
    if m:
        return month_header(_dt.date(int(m.group(1)), int(m.group(2)), 1), translate, style)
    if style == "month_lower":
        return s.strip().lower()
    if translate:
        for en, es in zip(L.MONTHS_EN, L.MONTHS_ES):
            s = re.sub(rf"\b{en}\b", es, s)
    return s


def rename_month_headers(df: DataFrame, translate: bool = True,
                         style: str = "month_year") -> DataFrame:
    return df.toDF(*[month_header(c, translate, style) for c in df.columns])
