"""Fixed label tables.

FIXED VALUES: the texts below must equal the ones the reports use
(Spanish month and weekday names, register month columns, store format
names, closure-age labels, share-brand labels) so that outputs carry the
same labels. They are listed in natural order.
"""

# Month names, January to December.
MONTHS_ES = ["Enero", "Febrero", "Marzo", "Abril", "Mayo", "Junio", "Julio",
             "Agosto", "Septiembre", "Octubre", "Noviembre", "Diciembre"]
MONTHS_EN = ["January", "February", "March", "April", "May", "June", "July",
             "August", "September", "October", "November", "December"]
# Register comparability columns, one per month, January to December.
MONTH_COLUMNS = ["ene", "feb", "mar", "abr", "may", "jun", "jul", "ago", "sep",
                 "oct", "nov", "dic"]

# Weekday names, Monday to Sunday (Spanish without accents, as in the reports).
WEEKDAYS_EN = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
               "Saturday", "Sunday"]
WEEKDAYS_ES = ["Lunes", "Martes", "Miercoles", "Jueves", "Viernes", "Sabado",
               "Domingo"]

# Physical store formats as they appear in sales reports and in the register.
REPORT_FORMATS = ["hipermercado", "maxi", "market", "proximidad"]
REGISTER_FORMATS = ["express", "hipermercado", "market", "maxi"]
# Register spelling -> report spelling.
FORMAT_UNIFY = {"express": "proximidad"}

# Closure-age buckets of a store, from "open" to "closed for longest".
OPEN_STORE = "Tienda Abierta"
CLOSED_UNDER_1Y = "Tienda cerrada por menos de un año"
CLOSED_OVER_1Y = "Tienda cerrada por más de un año"
CLOSED_OVER_2Y = "Tienda cerrada por más de dos años"
CLOSED_OVER_3Y = "Tienda cerrada por más de tres años"

# Store state from the closing-date cell.
ACTIVE = "Activa"
CLOSED = "Cerrada"

# Market-share export: identifier headers (lower-cased) and their names here;
# the brand-specific headers are "mdo <brand>" -> marca, "bandera <brand>" -> formato.
SHARE_HEADERS = {"area1_rs": "area", "area_scentia_rs": "region", "mercado reporte": "subregion",
                 "formato_m2_rs": "formato_m2", "succad": "numero_operacional"}
SHARE_YTD_COLUMNS = ["ytd24", "ytd25"]
# Share table: "<brand> <format>" labels of the own brand become "<format>".
SHARE_FORMATS = ["EXPRESS", "HIPER", "MARKET", "MAXI"]
REST_LABEL = "RESTO"

# Measures of the long fact: sales with tax, units, tickets.
SALES, UNITS, TICKETS = "VCT", "VOL", "DEB"
MEASURES = [SALES, UNITS, TICKETS]
PRODUCT_MEASURES = [SALES, UNITS]

# Packaging families excluded from units (exact list and substring variant).
PACKAGING_FAMILIES = ["ENVASES BEBIDAS", "ENVASES PAGADOS"]
PACKAGING_TOKEN = "ENVASES"

# Value-added tax share removed from gross sales (net = gross * (1 - rate)).
VAT_RATE = "0.2650"
# Variable cost share applied to net sales in the operating result.
VARIABLE_COST_RATE = "0.02"


def month_number(name: str) -> int:
    """'Julio' / 'julio' / 'JULIO' -> 7; raises on an unknown month."""
    key = name.strip().capitalize()
    if key not in MONTHS_ES:
        raise ValueError(f"unknown month {name!r}; use a full Spanish month name")
    return MONTHS_ES.index(key) + 1


def month_column(month) -> str:
    """Register comparability column of a month ('Julio' or 7 -> 'jul')."""
    idx = month if isinstance(month, int) else month_number(month)
    if not 1 <= idx <= 12:
        raise ValueError(f"month out of range: {month!r}")
    return MONTH_COLUMNS[idx - 1]
