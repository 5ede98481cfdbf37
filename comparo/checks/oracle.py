"""DuckDB oracle SQL for every catalogue key that SQL can express."""

from __future__ import annotations

from comparo.checks.sqlparts import (LINES, MEASURES, REGISTER, REGISTER_RAW, comparable_register, lit, store_label,
                                     cube_cte, growth_report, in_list, with_)
from comparo.sources import proxy as X

Y = (X.BASE_YEAR, X.CURRENT_YEAR)
M = X.MONTH
MC = "jul"
ORACLE: dict[str, str] = {}
BASE = (LINES, REGISTER, MEASURES)
P = ("VCT", "VOL")
LEAF = ("year", "month", "format", "store_id", "store", "sector", "section", "family")
SG = """sg AS (SELECT year, month, format, store_id, measure, sum(value) AS value
  FROM measures GROUP BY year, month, format, store_id, measure)"""

ORACLE["measures_long"] = with_(*BASE) + """SELECT year, month, format, store_id, store, sector,
  section, family, measure, CAST(value AS DOUBLE) AS value FROM measures"""

ORACLE["exclude_packaging_exact"] = with_(LINES) + f"""SELECT family,
  CAST(sum(units) AS DOUBLE) AS units, count(*) AS n_lines FROM lines
  WHERE NOT coalesce(family IN ({in_list(X.PACKAGING)}), false) GROUP BY family"""

ORACLE["exclude_packaging_contains"] = with_(LINES) + f"""SELECT family,
  CAST(sum(units) AS DOUBLE) AS units, count(*) AS n_lines FROM lines
  WHERE NOT coalesce(contains(family, '{X.PACKAGING_TOKEN}'), false) GROUP BY family"""

ORACLE["register_join_left"] = with_(*BASE, SG) + """SELECT sg.year, sg.month, sg.format,
  sg.store_id, sg.measure, CAST(sg.value AS DOUBLE) AS value, r.province, r.jul AS flag
  FROM sg LEFT JOIN register r ON sg.store_id = r.store_id"""

ORACLE["register_join_store_format"] = with_(*BASE) + """SELECT f.*, r.province,
  CAST(r.m_salon AS DOUBLE) AS m_salon
  FROM (SELECT year, month, lower(format) AS format, store_id, measure,
               CAST(sum(value) AS DOUBLE) AS value
        FROM measures GROUP BY year, month, lower(format), store_id, measure) f
  LEFT JOIN (SELECT store_id, CASE WHEN lower(org) = 'express' THEN 'proximidad'
                                   ELSE lower(org) END AS format, province, m_salon
             FROM register WHERE lower(org) IN ('express', 'hipermercado', 'market', 'maxi')
               AND store_id IS NOT NULL AND name IS NOT NULL AND open_date IS NOT NULL) r
    ON f.store_id = r.store_id AND f.format = r.format
  WHERE f.format IN ('hipermercado', 'maxi', 'market', 'proximidad')"""

ORACLE["comparable_filter"] = with_(*BASE, SG) + f"""SELECT sg.year, sg.month, sg.format,
  sg.store_id, sg.measure, CAST(sg.value AS DOUBLE) AS value, r.province
  FROM sg JOIN ({comparable_register(MC)}) r ON sg.store_id = r.store_id"""

ORACLE["comparable_case_policy"] = with_(REGISTER) + """SELECT store_id, jul AS flag,
  coalesce(upper(jul) = 'SC', false) AS keep_upper, coalesce(jul = 'SC', false) AS keep_exact
  FROM register"""

# -- monthly (one closed month) ---------------------------------------------------
MONTH_CUBE = cube_cte(Y, MC, f"m.month = {M}")
_mon = {
    "total": growth_report([], Y),
    "format": growth_report(["format"], Y, wide="mean"),
    "province": growth_report(["province"], Y, wide="mean"),
    "province_format": growth_report(["format", "province"], Y, wide="sum", digits=2, fill=0.0),
    "store": growth_report(["format", "store"], Y, wide="mean"),
    "sector": growth_report(["sector"], Y, P, wide="sum"),
    "section": growth_report(["section"], Y, P, wide="sum"),
    "family": growth_report(["family"], Y, P, wide="sum"),
    "store_sector": growth_report(["format", "store", "sector"], Y, P, resum=True, wide="sum",
                                  require=LEAF),
    "store_section": growth_report(["format", "store", "section"], Y, P, resum=True, wide="sum",
                                   require=LEAF),
    "store_family": growth_report(["format", "store", "family"], Y, P, resum=True, wide="sum",
                                  require=LEAF),
}
for _k, _sql in _mon.items():
    ORACLE[f"yoy_{_k}"] = with_(*BASE, MONTH_CUBE) + _sql

_leaf_nn = " AND ".join(f"{c} IS NOT NULL" for c in LEAF)
ORACLE["leaf_pivot"] = with_(*BASE, MONTH_CUBE) + f"""SELECT format, store, sector, section,
  family, measure,
  CAST(sum(value) FILTER (WHERE year = {Y[0]}) AS DOUBLE) AS y{Y[0]},
  CAST(sum(value) FILTER (WHERE year = {Y[1]}) AS DOUBLE) AS y{Y[1]}
  FROM cube WHERE measure IN ('VCT', 'VOL') AND {_leaf_nn}
  GROUP BY format, store, sector, section, family, measure"""

# -- year to date ------------------------------------------------------------------
YTD_CUBE = cube_cte(Y, MC, f"m.month <= {M}")
_ytd = {
    "total": growth_report([], Y, resum=True),
    "format": growth_report(["format"], Y, resum=True),
    "province": growth_report(["province"], Y, resum=True, wide="sum"),
    "province_format": growth_report(["format", "province"], Y, wide="sum", digits=2, fill=0.0),
    "store": growth_report(["store"], Y, resum=True, wide="sum"),
    "sector": growth_report(["sector"], Y, P, wide="sum"),
    "section": growth_report(["section"], Y, P, wide="sum"),
    "family": growth_report(["family"], Y, P, wide="sum"),
    "store_sector": growth_report(["store", "sector"], Y, P, wide="sum"),
    "store_section": growth_report(["store", "section"], Y, P, wide="sum"),
    "store_family": growth_report(["store", "family"], Y, P, wide="sum"),
    "measure_single_format": growth_report([], Y, resum=True),
}
for _k, _sql in _ytd.items():
    ORACLE[f"ytd_{_k}"] = with_(*BASE, YTD_CUBE) + _sql
# one format alone (RPT-3)
_ONE = cube_cte(Y, MC, f"m.month <= {M} AND m.format = 'MARKET'")
ORACLE["ytd_measure_single_format"] = with_(*BASE, _ONE) + _ytd["measure_single_format"]

_ld = ("year", "month", "format", "store", "sector", "section", "family", "measure")
ORACLE["leaf_detail"] = with_(*BASE, YTD_CUBE) + f"""SELECT {', '.join(_ld)},
  CAST(sum(value) AS DOUBLE) AS value FROM cube
  WHERE measure IN ('VCT', 'VOL') AND {' AND '.join(f'{c} IS NOT NULL' for c in _ld)}
  GROUP BY {', '.join(_ld)}"""
ORACLE["leaf_detail_single_format"] = f"SELECT * FROM ({ORACLE['leaf_detail']}) WHERE format = 'MARKET'"
ORACLE["leaf_detail_left_out"] = f"SELECT * FROM ({ORACLE['leaf_detail']}) WHERE false"


_GS = [("total", []), ("format", ["format"]), ("province", ["province"]),
       ("province_format", ["format", "province"]), ("store", ["format", "store"]),
       ("sector", ["sector"]), ("section", ["section"]), ("family", ["family"])]
_GS_COLS = ["format", "province", "store", "sector", "section", "family"]
_branches = []
for _g, _keys in _GS:
    sel = ", ".join(c if c in _keys else f"CAST(NULL AS VARCHAR) AS {c}" for c in _GS_COLS)
    where = " AND ".join([f"{k} IS NOT NULL" for k in _keys] +
                         (["measure <> 'DEB'"] if _g in ("sector", "section", "family") else [])
                         ) or "TRUE"
    by = ", ".join(_keys + ["year", "measure"])
    _branches.append(f"SELECT '{_g}' AS grain, {sel}, year, measure, "
                     f"CAST(sum(value) AS DOUBLE) AS value FROM cube WHERE {where} GROUP BY {by}")
ORACLE["report_grouping_sets"] = with_(*BASE, YTD_CUBE) + "\nUNION ALL\n".join(_branches)
ORACLE["report_rollup"] = ORACLE["report_grouping_sets"]

# -- growth policies -----------------------------------------------------------------
from comparo.checks.sqlparts import growth as _g  # noqa: E402

_SF = with_(*BASE, MONTH_CUBE, "sf AS (" + growth_report(
    ["store", "family"], Y, P, resum=True) + ")")
ORACLE["growth_zero_policies"] = _SF + f"""SELECT store, family, measure, base, current,
  {_g('base', 'current')} AS growth_inf,
  {_g('base', 'current', zero_base='null')} AS growth_null,
  {_g('base', 'current', scale=1, digits=None, zero_base='zero')} AS growth_zero FROM sf"""
ORACLE["growth_rounding"] = _SF + f"""SELECT store, family,
  measure, {_g('base', 'current', digits=1)} AS pct_1, {_g('base', 'current', digits=2)} AS pct_2,
  {_g('base', 'current', scale=1, digits=3)} AS frac_3,
  {_g('base', 'current', scale=1, digits=None)} AS frac FROM sf"""

# -- comparison series -----------------------------------------------------------------
HY = X.HISTORY_YEARS
_CMP_CUBE = cube_cte(HY, MC, "TRUE")
_MONTHS_ES = "['Enero', 'Febrero', 'Marzo', 'Abril', 'Mayo', 'Junio', 'Julio', 'Agosto', " \
             "'Septiembre', 'Octubre', 'Noviembre', 'Diciembre']"


def _series_sql(dims, trunc):
    keys = ", ".join(["month", *dims, "measure"])
    ycols = ", ".join(f"CAST(sum(value) FILTER (WHERE year = {y}) AS DOUBLE) AS y{y}" for y in HY)
    ysel = ", ".join((f"CAST(CAST(trunc(y{y}) AS BIGINT) AS DOUBLE) AS y{y}" if trunc else f"y{y}")
                     for y in HY)
    arms = []
    for b, c in X.PAIRS:
        arms.append(f"SELECT {keys}, {ysel}, 'growth {c}' AS series, "
                    f"{_g(f'y{b}', f'y{c}')} AS value, "
                    f"lpad(CAST(month AS VARCHAR), 2, '0') || '-' || right('{c}', 2) AS period, "
                    f"{_MONTHS_ES}[month] AS month_name FROM w")
    store = "store, " if dims else "'Total Formato' AS store, "
    body = "\nUNION ALL\n".join(arms)
    return (f"(WITH w AS (SELECT {keys}, {ycols} FROM cube GROUP BY {keys}) "
            f"SELECT {store}* EXCLUDE ({'store' if dims else 'month'}) "
            f"{', month' if not dims else ''} FROM ({body}))")


_TOTAL = _series_sql([], False)
_STORE = _series_sql(["store"], True)
_CMPB = with_(*BASE, _CMP_CUBE)
ORACLE["comparison_total_series"] = _CMPB + f"SELECT * FROM {_TOTAL}"
ORACLE["comparison_store_series"] = _CMPB + f"SELECT * FROM {_STORE}"
ORACLE["comparison_union"] = _CMPB + f"SELECT * FROM {_STORE} UNION ALL BY NAME SELECT * FROM {_TOTAL}"
_sel = in_list([f"{k}-Supplier#{k:09d}" for k in (1, 2, 3)] + ["Total Formato"])
ORACLE["comparison_selected"] = _CMPB + f"""SELECT * FROM (SELECT * FROM {_STORE}
  UNION ALL BY NAME SELECT * FROM {_TOTAL}) WHERE store IN ({_sel}) AND measure = 'VCT'"""

# -- store facts -------------------------------------------------------------------------
_REG_PHYS = """reg AS (
  SELECT store_id, name, open_date, m_salon, province, jul, close_raw,
         try_strptime(close_raw, '%m/%d/%Y')::DATE AS close_date,
         CASE WHEN org = 'express' THEN 'proximidad' ELSE org END AS format
  FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY row_order) AS rn
        FROM (SELECT * REPLACE (lower(org) AS org) FROM register_raw)
        WHERE org IN ('express', 'hipermercado', 'market', 'maxi'))
  WHERE rn = 1 AND store_id IS NOT NULL AND name IS NOT NULL AND open_date IS NOT NULL)"""
_AS_OF = f"DATE '{X.AS_OF}'"
_LIFE = f"""CASE WHEN close_date IS NULL THEN 'Tienda Abierta'
  WHEN {_AS_OF} - close_date > 1095 THEN 'Tienda cerrada por más de tres años'
  WHEN {_AS_OF} - close_date > 730 THEN 'Tienda cerrada por más de dos años'
  WHEN {_AS_OF} - close_date > 365 THEN 'Tienda cerrada por más de un año'
  ELSE 'Tienda cerrada por menos de un año' END"""
_FACTS = f"""SELECT f.year, f.month, f.format, f.store_id, f.store, f.measure, f.value,
  strftime(r.open_date, '%d/%m/%Y') AS open_date, r.close_date,
  CAST(r.m_salon AS DOUBLE) AS m_salon, r.province, r.jul AS surface,
  coalesce(r.life, 'Tienda Abierta') AS life, {_MONTHS_ES}[f.month] AS month_name
  FROM (SELECT year, month, lower(format) AS format, store_id, store, measure,
               CAST(sum(value) AS DOUBLE) AS value FROM measures
        GROUP BY year, month, lower(format), store_id, store, measure) f
  LEFT JOIN (SELECT *, {_LIFE} AS life FROM reg) r
    ON f.store_id = r.store_id AND f.format = r.format
  WHERE f.format IN ('hipermercado', 'maxi', 'market', 'proximidad')"""
ORACLE["join_export_all"] = with_(*BASE, REGISTER_RAW, _REG_PHYS) + _FACTS
ORACLE["join_export_comparable"] = with_(*BASE, REGISTER_RAW, _REG_PHYS) + \
    f"SELECT * FROM ({_FACTS}) WHERE surface = 'SC'"
ORACLE["closure_buckets"] = with_(REGISTER, REGISTER_RAW, _REG_PHYS) + \
    f"SELECT store_id, name, format, close_date, {_LIFE} AS life FROM reg"
ORACLE["register_first_per_key"] = with_(REGISTER, REGISTER_RAW) + """SELECT store_id, name,
  org FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY row_order) AS rn
  FROM register_raw) WHERE rn = 1 AND store_id IS NOT NULL AND name IS NOT NULL"""

# -- briefing --------------------------------------------------------------------------
from comparo.checks.sqlparts import growth_report as _gr  # noqa: E402

BM3 = ("deb", "vct", "vol")
_CREG = ("creg AS (SELECT store_id FROM register WHERE store_id IS NOT NULL AND name IS NOT NULL "
         "AND jul IS NOT NULL AND jul = 'SC')")
_CUT = "TIMESTAMP '2001-08-01 00:00:00' - INTERVAL 182 DAY - INTERVAL 12 HOUR"


def _brief_ctes(rolling: bool, comparable: bool):
    if rolling:
        ms = "make_date(year, month, 1)"
        scope = f"{ms} >= DATE '{X.ROLLING_FROM}' AND {ms} < DATE '{X.AS_OF}'"
        per = (f", CASE WHEN CAST({ms} AS TIMESTAMP) > {_CUT} THEN '{X.PERIOD_NEW}' "
               f"ELSE '{X.PERIOD_OLD}' END AS period")
        k = "year, month, format, store_id, store, period"
    else:
        scope = f"month = {X.BRIEF_MONTH} AND year IN {tuple(X.BRIEF_YEARS)}"
        per = ""
        k = "year, month, format, store_id, store"
    j = "JOIN creg USING (store_id)" if comparable else ""
    return [
        _CREG,
        f"bm AS (SELECT *{per} FROM measures WHERE {scope})",
        f"bl AS (SELECT *{per} FROM lines WHERE {scope})",
        f"sf0 AS (SELECT {k}, lower(measure) AS measure, sum(value) AS value FROM bm "
        f"GROUP BY {k}, lower(measure))",
        f"sec0 AS (SELECT {k}, sector, lower(measure) AS measure, sum(value) AS value FROM bm "
        f"WHERE measure <> 'DEB' GROUP BY {k}, sector, lower(measure) UNION ALL "
        f"SELECT {k}, sector, 'deb', CAST(count(DISTINCT order_key) AS DECIMAL(38,6)) FROM bl "
        f"GROUP BY {k}, sector)",
        f"fam0 AS (SELECT * REPLACE (lower(measure) AS measure) FROM bm WHERE measure = 'VOL')",
        f"store_x AS (SELECT sf0.* FROM sf0 {j})",
        f"sector_x AS (SELECT sec0.* FROM sec0 {j})",
        f"family_x AS (SELECT fam0.* FROM fam0 {j})",
    ]


def _brief_sql(kind, comparable=True, rolling=False):
    axis, lab = (("period", (X.PERIOD_OLD, X.PERIOD_NEW)) if rolling else ("year", X.BRIEF_YEARS))
    kw = dict(measures=BM3, digits=3, scale=1, axis=axis)
    ctes = with_(LINES, REGISTER, MEASURES, *_brief_ctes(rolling, comparable))
    store = _gr(["format", "store_id", "store"], lab, src="store_x", **kw)
    fmt = _gr(["format"], lab, resum=True, require=("store_id", "store"), src="store_x", **kw)
    ss = _gr(["format", "store_id", "store", "sector"], lab, src="sector_x", **kw)
    fs = _gr(["format", "sector"], lab, resum=True, require=("store_id", "store"),
             src="sector_x", **kw)
    if kind == "store":
        return ctes + store
    if kind == "format":
        return ctes + fmt
    if kind == "store_sector":
        return ctes + ss
    if kind == "format_sector":
        cols = ", ".join(f"coalesce(sum(growth) FILTER (WHERE sector = '{s}'), 0.0) AS {s}"
                         for s in X.SECTORS)
        return ctes + f"SELECT format, measure, {cols} FROM ({fs}) GROUP BY format, measure"
    if kind == "store_sector_matrix":
        cols = ", ".join(f"coalesce(sum(growth) FILTER (WHERE sector = '{s}'), 0.0) AS {s}"
                         for s in X.SECTORS)
        return ctes + f"""SELECT w.* EXCLUDE (store_id), t.format,
          coalesce(t.growth, 0.0) AS total_store
          FROM (SELECT store_id, store, measure, {cols} FROM ({ss})
                GROUP BY store_id, store, measure) w
          LEFT JOIN ({store}) t ON w.store_id = t.store_id AND w.measure = t.measure"""
    if kind == "consolidated":
        keys = [f"{m}_{s}" for m in BM3 for s in [*X.SECTORS, "Total"]]
        cols = ", ".join(
            f"CASE WHEN count(*) FILTER (WHERE k = '{k}') > 0 THEN "
            f"coalesce(sum(growth) FILTER (WHERE k = '{k}'), 0.0) END AS {k}" for k in keys)
        return ctes + f"""SELECT format, store, {cols} FROM (
          SELECT format, store, measure || '_' || sector AS k, growth FROM ({ss})
          UNION ALL SELECT format, store, measure || '_Total', growth FROM ({store}))
          GROUP BY format, store"""
    if kind == "family":
        b = f"sum(value) FILTER (WHERE {axis} = {lit(lab[0])})"
        c = f"CAST(sum(value) FILTER (WHERE {axis} = {lit(lab[1])}) AS DOUBLE)"
        return ctes + f"""SELECT format, family, section, measure, CAST(b AS DOUBLE) AS base,
          current, current - CAST(b AS DOUBLE) AS gap,
          CASE WHEN current IS NULL THEN 0.0
               WHEN b = 0 THEN CASE WHEN current < 0 THEN CAST('-inf' AS DOUBLE) ELSE 0.0 END
               ELSE current / CAST(b AS DOUBLE) - 1 END AS growth,
          CASE WHEN current IS NULL THEN 0.0
               WHEN tot = 0 THEN CASE WHEN current - CAST(b AS DOUBLE) > 0 THEN CAST('inf' AS DOUBLE)
                                      WHEN current - CAST(b AS DOUBLE) < 0 THEN CAST('-inf' AS DOUBLE)
                                      ELSE 0.0 END
               ELSE (current - CAST(b AS DOUBLE)) / CAST(tot AS DOUBLE) END AS contribution
          FROM (SELECT *, sum(b) OVER (PARTITION BY format) AS tot FROM (
                  SELECT format, family, section, measure,
                         coalesce({b}, CAST(0 AS DECIMAL(38,6))) AS b, {c} AS current
                  FROM family_x WHERE {axis} IN ({lit(lab[0])}, {lit(lab[1])})
                    AND format IS NOT NULL AND family IS NOT NULL AND section IS NOT NULL
                    AND measure IS NOT NULL AND sector IS NOT NULL
                  GROUP BY format, family, section, measure))"""
    if kind == "four_levels":
        def sel(q, level, has_store, has_sector):
            sid = "store_id" if has_store else "CAST(NULL AS BIGINT) AS store_id"
            st = "store" if has_store else "CAST(NULL AS VARCHAR) AS store"
            sec = "sector" if has_sector else "CAST(NULL AS VARCHAR) AS sector"
            return (f"SELECT '{level}' AS level, format, {sid}, {st}, measure, {sec}, "
                    f"base, current, growth FROM ({q})")
        return ctes + "\nUNION ALL\n".join([
            sel(store, "tienda", True, False), sel(fmt, "formato", False, False),
            sel(ss, "tienda_sector", True, True), sel(fs, "formato_sector", False, True)])
    raise KeyError(kind)


for _k, _args in {
    "briefing_store_comparable": ("store",), "briefing_store_all": ("store", False),
    "briefing_format": ("format",), "briefing_format_all": ("format", False),
    "briefing_format_sector": ("format_sector",),
    "briefing_store_sector_matrix": ("store_sector_matrix",),
    "briefing_consolidated_matrix": ("consolidated",),
    "briefing_family_contribution": ("family",), "briefing_four_levels": ("four_levels",),
    "period_split_store": ("store", True, True), "period_split_format": ("format", True, True),
    "period_split_sector": ("store_sector", True, True),
    "period_split_family": ("family", True, True),
    "period_split_format_sector": ("format_sector", True, True),
    "period_split_store_sector_matrix": ("store_sector_matrix", True, True),
    "period_split_consolidated_matrix": ("consolidated", True, True),
    "period_split_four_levels": ("four_levels", True, True),
}.items():
    ORACLE[_k] = _brief_sql(*_args)


def _history_sql(comparable):
    hy = X.BRIEF_HISTORY_YEARS
    j = "JOIN creg USING (store_id)" if comparable else ""
    ycols = ", ".join(f"CAST(sum(value) FILTER (WHERE year = {y}) AS DOUBLE) AS y{y}" for y in hy)
    gcols = ", ".join(f"{_g(f'y{b}', f'y{c}', scale=1, digits=3)} AS growth_{c}"
                      for b, c in X.BRIEF_PAIRS)
    return with_(LINES, REGISTER, MEASURES, _CREG) + f"""SELECT format, month, measure,
      {', '.join(f'y{y}' for y in hy)}, {gcols}, {_MONTHS_ES}[month] AS month_name FROM (
      SELECT format, month, measure, {ycols} FROM (
        SELECT h.* FROM (SELECT year, month, format, store_id, store, lower(measure) AS measure,
                                sum(value) AS value FROM measures WHERE year IN {tuple(hy)}
                         GROUP BY year, month, format, store_id, store, lower(measure)) h {j})
      WHERE make_date(year, month, 1) <= DATE '{X.CURRENT_YEAR}-{X.BRIEF_MONTH:02d}-01'
        AND format IS NOT NULL AND month IS NOT NULL AND measure IS NOT NULL
      GROUP BY format, month, measure)"""


ORACLE["history_growth_comparable"] = _history_sql(True)
ORACLE["history_growth_all"] = _history_sql(False)

# -- Sunday extended hours -----------------------------------------------------------
_N = "(SELECT count(*) FROM supplier)"
_DAY = f"CAST(CAST(ts AS DATE) + CAST(event_id % {X.SLOT_WEEKS} * 7 AS INTEGER) AS DATE)"
_SLOTS = f"""slots AS (
  SELECT user_id % {_N} AS store_id,
         CAST(user_id % {_N} AS VARCHAR) || ' Supplier#' || lpad(CAST(user_id % {_N} AS VARCHAR), 9, '0')
           AS store_label,
         {_DAY} AS date, CAST(((hour(ts) * 60 + minute(ts)) // 30) * 30 AS INTEGER) AS slot_start,
         sum(CAST(value AS DECIMAL(12,2))) AS vct
  FROM events WHERE event_type = 'purchase' GROUP BY ALL)"""
_SPM = """spm AS (SELECT lower(monthname(date)) AS month, count(DISTINCT date) AS cantidad_domingos
  FROM slots WHERE dayofweek(date) = 0 GROUP BY 1)"""
_IDS = """ids AS (
  SELECT s.s_suppkey AS no, s.s_name AS nombre, n.n_name AS localidad, r.r_name AS zona,
         'GR ' || CAST(n.n_regionkey AS VARCHAR) AS "gerente regional", 'SI' AS domingos,
         lpad(CAST(s.s_suppkey % 3 + 8 AS VARCHAR), 2, '0') || ':00 a '
           || lpad(CAST(s.s_suppkey % 2 + 20 AS VARCHAR), 2, '0') || ':00' AS horario_anterior
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey)"""
_HOURS = """hours AS (
  SELECT * EXCLUDE (m), lower(monthname(make_date(2024, m, 1))) AS mes,
         CAST(((no + m) % 5) * 4 + 8 AS DOUBLE) AS horas,
         -CAST(no % 50 + 100 + m AS DOUBLE) AS costo_hora_hombre
  FROM (SELECT *, unnest(range(1, 13)) AS m FROM ids))"""
_BASE_H = """bh AS (SELECT no, round_even(avg(horas) / 4.0, 2) AS horas_promedio_abril_y_mayo
  FROM hours WHERE mes IN ('april', 'may') GROUP BY no)"""
_HM = """hm AS (
  SELECT h.* EXCLUDE (costo_hora_hombre), sm.cantidad_domingos,
         round_even(h.horas / sm.cantidad_domingos, 1) AS horas_por_domingo,
         b.horas_promedio_abril_y_mayo
  FROM hours h LEFT JOIN spm sm ON h.mes = sm.month LEFT JOIN bh b ON h.no = b.no),
hm2 AS (
  SELECT *, round_even(horas_por_domingo / horas_promedio_abril_y_mayo - 1, 2)
              AS crecimiento_horas_domingo,
         horas_por_domingo - horas_promedio_abril_y_mayo AS horas_adicionales_por_domingo,
         (horas_por_domingo - horas_promedio_abril_y_mayo) * cantidad_domingos
              AS horas_adicionales_total_mes
  FROM hm)"""


def _mins(x):
    return (f"(CAST(split_part({x}, ':', 1) AS INTEGER) * 60 "
            f"+ CAST(split_part({x}, ':', 2) AS INTEGER))")


_OPEN = f"""op AS (SELECT no, {_mins("split_part(horario_anterior, ' ', 1)")} AS open_min,
  {_mins("split_part(horario_anterior, ' ', 3)")} AS close_min
  FROM (SELECT DISTINCT no, horario_anterior FROM hours))"""
_EXT = """ext AS (SELECT s.store_id AS no, lower(monthname(s.date)) AS month,
  CAST(sum(s.vct) AS DOUBLE) AS vct
  FROM slots s JOIN op o ON s.store_id = o.no
  WHERE dayofweek(s.date) = 0 AND o.open_min IS NOT NULL
    AND (s.slot_start < o.open_min OR s.slot_start >= o.close_min)
  GROUP BY 1, 2)"""
_MARGIN = f"""mg0 AS (SELECT strftime({_DAY}, '%Y%m') AS Periodo, user_id % {_N} AS Tienda,
  CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS sales,
  CAST(sum(CAST(value AS DECIMAL(12,2))) FILTER (WHERE event_type = 'purchase') AS DOUBLE) AS margin
  FROM events GROUP BY 1, 2),
mg AS (SELECT CAST(Tienda AS BIGINT) AS no,
  lower(monthname(strptime(Periodo, '%Y%m'))) AS mes,
  coalesce(round_even(margin, 2), 0.0) AS margen_comercial,
  round_even(coalesce(sales, 0.0), 2) AS venta_sin_tasa,
  coalesce(CASE WHEN round_even(coalesce(sales, 0.0), 2) = 0 THEN NULL
                ELSE round_even(round_even(margin, 2) / round_even(coalesce(sales, 0.0), 2), 2) END,
           0.0) AS ratio_margen
  FROM mg0)"""
_HCTES = (_SLOTS, _SPM, _IDS, _HOURS, _BASE_H, _HM, _OPEN, _EXT, _MARGIN)

ORACLE["unpivot_stores"] = with_(_SLOTS) + """SELECT store_id, store_label, date, slot_start,
  CAST(vct AS DOUBLE) AS vct, dayname(date) AS weekday, lower(monthname(date)) AS month FROM slots"""
ORACLE["sundays_per_month"] = with_(_SLOTS, _SPM) + "SELECT * FROM spm"
ORACLE["outside_hours_sales"] = with_(*_HCTES) + "SELECT * FROM ext"
ORACLE["hours_metrics"] = with_(*_HCTES) + "SELECT * FROM hm2"
ORACLE["baseline_hours"] = with_(*_HCTES) + "SELECT * FROM bh"
ORACLE["margin_ratio"] = with_(*_HCTES) + "SELECT * FROM mg"

_H_METRICS = ["horas_autorizadas", "cantidad_domingos", "horas_por_domingo",
              "horas_promedio_abril_y_mayo", "crecimiento_horas_domingo",
              "horas_adicionales_por_domingo", "horas_adicionales_total_mes", "vct", "vst",
              "ratio_margen", "margen", "gastos_variables", "costo_hora_hombre",
              "gasto_de_personal", "roc"]
_RES = """res AS (
  SELECT no, nombre, localidad, zona, "gerente regional", domingos AS horario_domingo,
         horario_anterior, mes, horas AS horas_autorizadas, cantidad_domingos, horas_por_domingo,
         horas_promedio_abril_y_mayo, crecimiento_horas_domingo, horas_adicionales_por_domingo,
         horas_adicionales_total_mes, vct, vst, ratio_margen, margen, gastos_variables,
         costo_hora_hombre, gasto_de_personal,
         round_even(margen + gastos_variables + gasto_de_personal, 2) AS roc
  FROM (SELECT *, horas_adicionales_total_mes * costo_hora_hombre AS gasto_de_personal
        FROM (SELECT x.*, round_even(x.vst * m.ratio_margen, 2) AS margen,
                     -x.vst * 0.02 AS gastos_variables, c.costo_hora_hombre, m.ratio_margen
              FROM (SELECT hm2.*, coalesce(e.vct, 0.0) AS vct,
                           coalesce(e.vct, 0.0) * (1 - 0.2650) AS vst
                    FROM hm2 LEFT JOIN ext e ON hm2.no = e.no AND hm2.mes = e.month) x
              LEFT JOIN mg m ON x.no = m.no AND x.mes = m.mes
              LEFT JOIN hours c ON x.no = c.no AND x.mes = c.mes)))"""
_rounded = ", ".join(
    f"round_even(CAST({m} AS DOUBLE), {2 if m in ('ratio_margen', 'crecimiento_horas_domingo') else 1})"
    f" AS {m}" for m in _H_METRICS)
_RES_FINAL = ("resf AS (SELECT no, nombre, localidad, zona, \"gerente regional\", horario_domingo, "
              f"horario_anterior, mes, {_rounded} FROM res)")
ORACLE["operating_result"] = with_(*_HCTES, _RES, _RES_FINAL) + "SELECT * FROM resf"
_months = [m.lower() for m in ("January February March April May June July August September "
                               "October November December").split()]
_wide = ", ".join(f"sum(coalesce({me}, 0.0)) FILTER (WHERE mes = '{mo}') AS {me}_{mo}"
                  for me in _H_METRICS for mo in _months)
ORACLE["hours_wide"] = with_(*_HCTES, _RES, _RES_FINAL) + f"""SELECT no, nombre, localidad, zona,
  "gerente regional", horario_domingo, horario_anterior, {_wide} FROM resf
  GROUP BY no, nombre, localidad, zona, "gerente regional", horario_domingo, horario_anterior"""

# the report: April to December, Spanish headers, by the ROC of the last month with Sunday sales
_es = dict(zip(_months, ("Enero Febrero Marzo Abril Mayo Junio Julio Agosto Septiembre Octubre "
                         "Noviembre Diciembre").split()))
_cap = lambda x: x.replace("_", " ").capitalize()
_rep = ", ".join(f"sum(coalesce({me}, 0.0)) FILTER (WHERE mes = '{mo}') AS \"{_cap(me)} {_es[mo]}\""
                 for me in _H_METRICS for mo in _months[3:])
_last = "CASE coalesce((SELECT max(month(date)) FROM slots WHERE dayofweek(date) = 0 AND month(date) > 3), 12) " + \
    " ".join(f"WHEN {i + 1} THEN \"Roc {_es[mo]}\"" for i, mo in enumerate(_months) if i > 2) + " END"
ORACLE["extended_hours_report"] = with_(*_HCTES, _RES, _RES_FINAL) + f"""SELECT *,
  row_number() OVER (ORDER BY {_last} ASC NULLS LAST, "No") AS row_no FROM (
  SELECT no AS "No", nombre AS "Nombre", localidad AS "Localidad", zona AS "Zona",
  "gerente regional" AS "Gerente regional", horario_domingo AS "Horario domingo",
  horario_anterior AS "Horario anterior", {_rep} FROM resf
  GROUP BY no, nombre, localidad, zona, "gerente regional", horario_domingo, horario_anterior)"""

# -- weekday, share, register clean-up ---------------------------------------------------
_WD_ES = ("CASE dayname(date) WHEN 'Monday' THEN 'Lunes' WHEN 'Tuesday' THEN 'Martes' "
          "WHEN 'Wednesday' THEN 'Miercoles' WHEN 'Thursday' THEN 'Jueves' "
          "WHEN 'Friday' THEN 'Viernes' WHEN 'Saturday' THEN 'Sabado' "
          "WHEN 'Sunday' THEN 'Domingo' END")


def _weekday_sql(with_store):
    sk = ", l.l_suppkey AS store" if with_store else ""
    gb = "1, 2" if with_store else "1"
    dia = (f"CAST(day(date) AS VARCHAR) || ' de ' || {_MONTHS_ES}[month(date)] || ' de ' "
           f"|| CAST(year(date) AS VARCHAR)")
    base = f"""dr AS (SELECT CAST(o.o_orderdate AS DATE) AS date{sk},
      CAST(sum(CAST(l.l_extendedprice AS DECIMAL(12,2))) AS DOUBLE) AS ventas
      FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey GROUP BY {gb})"""
    cols = (f"{dia} AS dia, CAST(ventas AS DOUBLE) AS ventas, CAST(year(date) AS VARCHAR) AS year, "
            f"{_MONTHS_ES}[month(date)] AS month_name, CAST(day(date) AS VARCHAR) AS day, date, "
            f"dayname(date) AS weekday, {_WD_ES} AS weekday_es")
    if not with_store:
        return with_(base) + f"SELECT {cols} FROM dr"
    return with_(REGISTER, base) + f"""SELECT {cols},
      CAST(store AS VARCHAR) || ' Supplier#' || lpad(CAST(store AS VARCHAR), 9, '0') AS punto_operacional,
      store AS no, r.jul
      FROM dr LEFT JOIN (SELECT store_id, upper(jul) AS jul FROM register
                         WHERE store_id IS NOT NULL AND name IS NOT NULL AND jul IS NOT NULL) r
        ON dr.store = r.store_id"""


ORACLE["weekday_enrich"] = _weekday_sql(False)
ORACLE["weekday_with_flag"] = _weekday_sql(True)

from comparo.checks.sqlparts import case_mod  # noqa: E402

_OWN = X.OWN_BRAND
_SP = f"""sp AS (
  SELECT r.r_name AS area, n.n_name AS region, c.c_mktsegment AS subregion,
    CASE WHEN c.c_nationkey % 5 = 0 THEN '3'
         ELSE '1-' || CAST((c.c_nationkey % 3 + 1) * 200 AS VARCHAR) || '-'
              || CAST((c.c_nationkey % 3 + 1) * 500 AS VARCHAR) END AS fm2raw,
    CASE WHEN c.c_nationkey % 3 = 0 THEN '{_OWN}' ELSE '{X.OTHER_BRAND}' END AS marca,
    CASE WHEN c.c_nationkey % 3 = 0 THEN '{_OWN}' ELSE '{X.OTHER_BRAND}' END || ' '
      || {case_mod('c.c_custkey', ['EXPRESS', 'HIPER', 'MARKET', 'MAXI'])} AS fmt_raw,
    CASE WHEN c.c_nationkey % 3 = 0 THEN CAST(c.c_nationkey AS DOUBLE) END AS succad,
    CAST(month(o.o_orderdate) AS INTEGER) AS m,
    CAST(sum(CAST(o.o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS v
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
       JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  WHERE year(o.o_orderdate) = {X.SHARE_YEAR}
  GROUP BY ALL),
spl AS (
  SELECT area, region, subregion,
    CASE WHEN strpos(fm2raw, '-') > 0 THEN replace(substr(fm2raw, strpos(fm2raw, '-') + 1), '-', 'a')
    END AS formato_m2,
    marca,
    CASE WHEN fmt_raw IN ({in_list([f'{_OWN} {f}' for f in ['EXPRESS', 'HIPER', 'MARKET', 'MAXI']])})
         THEN split_part(fmt_raw, ' ', 2) ELSE fmt_raw END AS formato,
    coalesce(nullif(CAST(CAST(trunc(succad) AS BIGINT) AS VARCHAR), '0'), 'RESTO') AS numero_operacional,
    m, v FROM sp)"""


_SHARE = f"""SELECT area, region, subregion, formato_m2, marca, formato, numero_operacional,
  {_MONTHS_ES}[m] AS mes, '{X.SHARE_YEAR}' AS anio, CAST(trunc(v) AS BIGINT) AS ventas_con_tasa,
  round_even(CAST(CAST(trunc(v) AS BIGINT) AS DOUBLE) / 1000000.0, 2) AS ventas_con_tasa_millones,
  make_date({X.SHARE_YEAR}, m, 1) AS fecha_final
  FROM spl WHERE v IS NOT NULL AND v <> 0"""
ORACLE["share_long"] = with_(_SP) + _SHARE
ORACLE["share_last_closed_month"] = with_(_SP) + f"""SELECT * FROM ({_SHARE})
  WHERE fecha_final = CAST(date_trunc('month', DATE '{X.AS_OF}' - INTERVAL 28 DAY) AS DATE)"""
ORACLE["share_labels"] = with_(_SP) + """SELECT DISTINCT area, region, subregion, formato_m2, marca,
  formato, numero_operacional FROM spl"""


def _cell_sql(i):
    k = f"(s.s_suppkey + {i})"
    return (f"CASE WHEN {k} % 6 = 0 THEN 0 WHEN {k} % 6 IN (1, 2, 3, 4) THEN 0 "
            f"ELSE s.s_suppkey * 10 + {i} END")


_M2 = ["m² pgc", "m² pft", "m² bazar", "m² electro", "m² textil", "m² pls", "m² galerias",
       "m² parcking", "cajas"]
_cells = {c: _cell_sql(i) for i, c in enumerate(_M2)}
_ORGS6 = ["HIPERMERCADO", "MAXI", "Market", "Express", "E-Commerce", "Mayorista"]
ORACLE["register_clean"] = with_(REGISTER) + f"""SELECT * FROM (
  SELECT s.s_name AS nombre, s.s_suppkey AS "id tienda", g.open_date AS "fecha apertura",
    {case_mod('s.s_suppkey', _ORGS6)} AS "organización",
    'DE ' || r.r_name AS "director explotación", 'DO ' || r.r_name AS "director operacional",
    'GR ' || n.n_name AS "director gerente regional", r.r_name AS "sub region",
    'GT ' || s.s_name AS "director gerente tienda",
    CASE WHEN upper(trim(CASE WHEN s.s_suppkey % 9 = 0 THEN ' Neuquén ' ELSE n.n_name END)) = 'NEUQUÉN'
         THEN 'NEUQUEN'
         ELSE upper(trim(CASE WHEN s.s_suppkey % 9 = 0 THEN ' Neuquén ' ELSE n.n_name END)) END
      AS "provincia tableau",
    g.m_salon AS "m² salón",
    {', '.join(f'CAST({_cells[c]} AS BIGINT) AS "{c}"' for c in _M2[:7])},
    CAST(s.s_suppkey + 1000 AS VARCHAR) AS "cod postal",
    CAST({_cells['cajas']} AS BIGINT) AS cajas, CAST({_cells['m² parcking']} AS BIGINT) AS "m² parcking",
    CASE WHEN g.close_raw = '-' THEN 'Activa' ELSE 'Cerrada' END AS estado,
    '01/08/2001' AS modificacion
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
       JOIN region r ON n.n_regionkey = r.r_regionkey
       JOIN register g ON s.s_suppkey = g.store_id
  WHERE s.s_name IS NOT NULL AND g.open_date IS NOT NULL)
  WHERE "organización" IN ('HIPERMERCADO', 'MAXI', 'Market', 'Express', 'E-Commerce')"""

# -- scalar functions ------------------------------------------------------------------------
_LOC = "translate(format('{:,.2f}', CAST(l_extendedprice AS DECIMAL(12,2))), ',.', '.,')"
ORACLE["parse_locale_decimal"] = f"""SELECT l_orderkey, l_linenumber, {_LOC} AS text,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS bad
  FROM lineitem"""
ORACLE["parse_locale_int"] = """SELECT l_orderkey, l_linenumber,
  CAST(trunc(CAST(l_extendedprice AS DECIMAL(12,2))) AS BIGINT) AS truncated,
  CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS DOUBLE) AS kept,
  replace(format('{:,d}', l_orderkey * 37), ',', '.') AS tickets_text, l_orderkey * 37 AS tickets
  FROM lineitem"""
ORACLE["store_id_dash"] = f"""SELECT l_orderkey, l_linenumber, {store_label('l_suppkey', '-')} AS store,
  l_suppkey AS store_id FROM lineitem"""
ORACLE["store_id_space"] = f"""SELECT l_orderkey, l_linenumber, {store_label('l_suppkey', ' ')} AS store,
  l_suppkey AS store_id FROM lineitem"""
ORACLE["month_token"] = f"""SELECT o_orderkey,
  {_MONTHS_ES}[month(o_orderdate)] || ' ' || CAST(year(o_orderdate) AS VARCHAR) AS period,
  CAST(month(o_orderdate) AS INTEGER) AS month, CAST(year(o_orderdate) AS VARCHAR) AS year,
  CAST(NULL AS VARCHAR) AS missing FROM orders"""
ORACLE["period_label"] = """SELECT o_orderkey,
  lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') || '-' || right(CAST(year(o_orderdate) AS VARCHAR), 2)
  AS period FROM orders"""
ORACLE["time_minutes"] = """SELECT event_id, strftime(ts, '%H:%M') AS hhmm,
  CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS minutes,
  CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS slot_start,
  CAST(hour(ts) * 60 + minute(ts) AS INTEGER) AS open_min, 1410 AS close_min FROM events"""
ORACLE["date_parse"] = with_(REGISTER) + """SELECT store_id, close_raw,
  CAST(try_strptime(close_raw, '%m/%d/%Y') AS DATE) AS close_date,
  strftime(open_date, '%d/%m/%Y') AS open_text FROM register"""
_heads = ", ".join(f"""CAST(no % 50 + 100 + {m} AS DOUBLE) AS "2024-{m:02d}-01 00:00:00\""""
                   for m in range(1, 13))
ORACLE["drop_null_columns"] = with_(_IDS) + f"SELECT *, {_heads} FROM ids"
ORACLE["distinct_pairs"] = with_(_IDS) + "SELECT DISTINCT no, horario_anterior FROM ids"

# -- sources and sinks: the round trip must give back the source query ------------------------
ORACLE["csv_utf16_roundtrip"] = ORACLE["ytd_format"]
ORACLE["report_set_roundtrip"] = ORACLE["yoy_store"]
ORACLE["append_month_idempotent"] = ORACLE["share_last_closed_month"]
ORACLE["overwrite_table"] = ORACLE["register_clean"]
ORACLE["report_ingest"] = ORACLE["measures_long"]
ORACLE["report_file_ingest"] = ORACLE["report_ingest"]
ORACLE["register_file_ingest"] = with_(REGISTER) + """SELECT CAST(store_id AS BIGINT) AS store_id,
  CASE WHEN store_id % 10 <> 0 THEN name END AS name, CASE WHEN store_id % 10 <> 0 THEN ene END AS ene,
  CASE WHEN store_id % 10 <> 0 THEN feb END AS feb, CASE WHEN store_id % 10 <> 0 THEN jul END AS ene_1,
  CASE WHEN store_id % 10 <> 0 THEN dic END AS feb_1 FROM register"""

# -- final orders ---------------------------------------------------------------------
for _k, _by in {
    "yoy_store": "format DESC, VOL_growth DESC NULLS LAST, store ASC",
    "yoy_family": "VOL_growth DESC NULLS LAST, family ASC",
    "yoy_store_family": "format DESC, store DESC, family DESC, VOL_growth DESC NULLS LAST",
    "comparison_union": "store, measure, month, series",
    "briefing_store_comparable": "growth DESC NULLS LAST, format, store_id, store, measure",
    "briefing_family_contribution": "contribution DESC NULLS LAST, format, family, section, measure",
}.items():
    ORACLE[f"order_{_k}"] = f"""SELECT *, row_number() OVER (ORDER BY {_by}) AS row_no
  FROM ({ORACLE[_k]})"""

# -- files written and read back ---------------------------------------------------------
ORACLE["share_file_ingest"] = ORACLE["share_long"]
ORACLE["hours_file_ingest"] = ORACLE["operating_result"]
ORACLE["report_bad_rows"] = with_(LINES) + """SELECT year, count(*) FILTER (WHERE order_key % 50 <> 0) AS n_good,
  nullif(count(*) FILTER (WHERE order_key % 50 = 0), 0) AS n_bad,
  CASE WHEN count(*) FILTER (WHERE order_key % 50 = 0) > 0 THEN 10 END::BIGINT AS cells
  FROM lines GROUP BY year"""
ORACLE["history_incremental"] = ORACLE["history_growth_comparable"]
ORACLE["report_set_by_format"] = ORACLE["yoy_store_family"]
ORACLE["briefing_set_by_format"] = ORACLE["briefing_consolidated_matrix"]
ORACLE["swap_table"] = ORACLE["overwrite_table"]
ORACLE["ytd_set_by_format"] = ORACLE["ytd_format"]
ORACLE["history_file_ingest"] = ORACLE["history_growth_comparable"]
ORACLE["bucketed_store_totals"] = with_(LINES, REGISTER) + """SELECT l.store_id, r.province, l.year,
  CAST(sum(l.sales) AS DOUBLE) AS sales, CAST(sum(l.units) AS DOUBLE) AS units
  FROM lines l JOIN register r ON l.store_id = r.store_id WHERE upper(r.jul) = 'SC' GROUP BY ALL"""
ORACLE["register_presented"] = with_(REGISTER) + f"""SELECT s.s_suppkey AS "Gsx", s.s_name AS "Nombre",
  g.open_date AS "Fecha apertura", r.r_name AS "Sub region", g.m_salon AS "M salón",
  CASE WHEN s.s_suppkey % 6 = 0 THEN '-' WHEN s.s_suppkey % 6 = 1 THEN 'sd' WHEN s.s_suppkey % 6 = 2 THEN 'SD'
       WHEN s.s_suppkey % 6 = 3 THEN '' WHEN s.s_suppkey % 6 = 5 THEN CAST(s.s_suppkey * 10 AS VARCHAR) END AS "M pgc",
  CASE WHEN s.s_suppkey % 9 = 0 THEN ' Neuquén ' ELSE n.n_name END AS "Provincia"
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  JOIN register g ON s.s_suppkey = g.store_id"""
