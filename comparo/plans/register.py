"""Store register clean-up for the share dashboard (RPT-13).

Column names normalised (PRJ-1); rows without name, organisation or
opening date dropped (FLT-1); physical organisations kept, spelled as in
the register (FLT-5, case-sensitive); state from the closing cell (CND-2);
surface / till cells with sentinels -> 0 (CND-4); postal code as text
(STR-13); update stamp from ``as_of`` (DAT-3); province trimmed,
upper-cased and unified (CND-6); every remaining '-' -> NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from comparo.functions.dates import format_date, lit_date, store_state
from comparo.functions.text import clean_sentinels, dash_to_null, unify

# FIXED VALUES: organisations, surface columns and output names as in the register.
ORGS = ["HIPERMERCADO", "MAXI", "Market", "Express", "E-Commerce"]
SURFACES = ["m² pgc", "m² pft", "m² bazar", "m² electro", "m² textil", "m² pls", "m² galerias",
            "cajas", "m² parcking"]
PROVINCE_FIX = {"NEUQUÉN": "NEUQUEN"}


def _name(c: str) -> str:
    return c.strip().lower().replace(" /", "").replace("/", "").replace(".", " ")


def clean_register(raw: DataFrame, as_of, orgs=ORGS) -> DataFrame:
    df = raw.toDF(*[_name(c) for c in raw.columns])
    df = df.na.drop(subset=["nombre", "organización", "fecha apertura"])
    df = df.filter(F.col("organización").isin(*orgs))
    df = df.withColumn("estado", store_state("fin de cierre"))
    df = df.drop("provincia tableau").withColumnsRenamed(
        {"provincia": "provincia tableau", "gsx": "id tienda"})
    df = df.withColumns({c: clean_sentinels(F.col(f"`{c}`")) for c in SURFACES})
    df = df.withColumn("cod postal", F.col("`cod postal`").cast("string"))
    df = df.withColumn("modificacion", format_date(lit_date(as_of), "dd/MM/yyyy"))
    df = df.withColumn("provincia tableau",
                       unify(F.col("`provincia tableau`"), PROVINCE_FIX, case="upper"))
    cols = ["nombre", "id tienda", "fecha apertura", "organización", "director explotación",
            "director operacional", "director gerente regional", "sub region",
            "director gerente tienda", "provincia tableau", "m² salón", *SURFACES[:7],
            "cod postal", "cajas", "m² parcking", "estado", "modificacion"]
    out = df.select(*[F.col(f"`{c}`") for c in cols])
    return out.select(*[dash_to_null(F.col(f"`{f.name}`")).alias(f.name)
                        if isinstance(f.dataType, StringType) else F.col(f"`{f.name}`")
                        for f in out.schema.fields])
