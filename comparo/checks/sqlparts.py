"""SQL building blocks for the DuckDB oracle.

The oracle recomputes every catalogue query in plain SQL, in the
reference's two-step shape (aggregate long, then pivot), so it checks the
engine's single-pass conditional aggregation rather than repeating it.
The proxy inputs are the same rules as ``comparo.sources.proxy``.
"""

from __future__ import annotations

from comparo.functions import labels as L
from comparo.sources import proxy as X


def case_mod(key: str, labels) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(labels))
    return f"CASE {key} % {len(labels)} {whens} END"


def in_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def store_label(key: str, sep: str = "-") -> str:
    return f"(CAST({key} AS VARCHAR) || '{sep}Supplier#' || lpad(CAST({key} AS VARCHAR), 9, '0'))"


LINES = f"""lines AS (
  SELECT CAST(year(o.o_orderdate) AS INTEGER) AS year,
         CAST(month(o.o_orderdate) AS INTEGER) AS month,
         {case_mod('l.l_suppkey', X.FORMATS)} AS format,
         l.l_suppkey AS store_id,
         {store_label('l.l_suppkey')} AS store,
         p.p_type AS sector, p.p_brand AS section, upper(p.p_name) AS family,
         CAST(CAST(l.l_extendedprice AS DECIMAL(12,2))
              * (1 - CAST(l.l_discount AS DECIMAL(4,2)))
              * (1 + CAST(l.l_tax AS DECIMAL(4,2))) AS DECIMAL(24,6)) AS sales,
         CAST(l.l_quantity AS DECIMAL(12,2)) AS units,
         l.l_orderkey AS order_key
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
                  JOIN part p ON l.l_partkey = p.p_partkey)"""


def _flag(m: int) -> str:
    k = f"(s.s_suppkey + {m})"
    return (f"CASE WHEN {k} % 13 = 0 THEN NULL WHEN {k} % 5 = 0 THEN 'NSC' "
            f"WHEN {k} % 11 = 0 THEN 'sc' ELSE 'SC' END")


_CLOSE = "(DATE '1997-01-01' + CAST((s.s_suppkey * 37) % 1800 AS INTEGER))"
FLAGS = ",\n         ".join(f"{_flag(i + 1)} AS {c}" for i, c in enumerate(L.MONTH_COLUMNS))

REGISTER = f"""register AS (
  SELECT s.s_suppkey AS store_id, s.s_name AS name,
         CAST(DATE '1990-01-01' + CAST((s.s_suppkey * 53) % 3000 AS INTEGER) AS DATE) AS open_date,
         {case_mod('s.s_suppkey', X.ORGS)} AS org,
         n.n_name AS province, r.r_name AS region,
         CAST(abs(s.s_acctbal) AS DECIMAL(12,2)) AS m_salon,
         CASE WHEN s.s_suppkey % 7 = 0 THEN strftime({_CLOSE}, '%m/%d/%Y') ELSE '-' END AS close_raw,
         CASE WHEN s.s_suppkey % 7 = 0 THEN CAST({_CLOSE} AS DATE) END AS close_date,
         {FLAGS}
  FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey
                  JOIN region r ON n.n_regionkey = r.r_regionkey)"""

REGISTER_RAW = """register_raw AS (
  SELECT *, store_id * 2 AS row_order FROM register
  UNION ALL
  SELECT * REPLACE (name || ' BIS' AS name), store_id * 2 + 1 FROM register WHERE store_id % 6 = 0
  UNION ALL
  SELECT * REPLACE (CAST(NULL AS VARCHAR) AS name), store_id * 2 - 1 FROM register WHERE store_id % 6 = 3)"""

STORE_KEYS = "year, month, format, store_id, store"
LEAF = "year, month, format, store_id, store, sector, section, family"


def measures_cte(packaging_exact=True) -> str:
    if packaging_exact:
        pack = f"coalesce(family IN ({in_list(X.PACKAGING)}), false)"
    else:
        pack = f"coalesce(contains(family, '{X.PACKAGING_TOKEN}'), false)"
    return f"""measures AS (
  SELECT {LEAF}, measure, CAST(sum(value) AS DECIMAL(38,6)) AS value FROM (
    SELECT {LEAF}, 'VCT' AS measure, sales AS value FROM lines
    UNION ALL
    SELECT {LEAF}, 'VOL' AS measure, units AS value FROM lines WHERE NOT {pack}
  ) WHERE value IS NOT NULL AND year IS NOT NULL AND month IS NOT NULL
      AND format IS NOT NULL AND store_id IS NOT NULL AND store IS NOT NULL
  GROUP BY {LEAF}, measure
  UNION ALL
  SELECT {STORE_KEYS}, NULL, NULL, NULL, 'DEB',
         CAST(count(DISTINCT order_key) AS DECIMAL(38,6))
  FROM lines GROUP BY {STORE_KEYS})"""


MEASURES = measures_cte()


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


def growth(b: str, c: str, scale=100, digits=1, zero_base="inf") -> str:
    ratio = f"(({c}) / ({b}) - 1) * {float(scale)}"
    val = f"round_even({ratio}, {digits})" if digits is not None else ratio
    if zero_base == "inf":
        z = (f"CASE WHEN ({c}) > 0 THEN CAST('inf' AS DOUBLE) "
             f"WHEN ({c}) < 0 THEN CAST('-inf' AS DOUBLE) END")
    elif zero_base == "null":
        z = "CAST(NULL AS DOUBLE)"
    else:
        z = "0.0"
    return (f"CASE WHEN ({b}) IS NULL OR ({c}) IS NULL THEN CAST(NULL AS DOUBLE) "
            f"WHEN ({b}) = 0 THEN {z} ELSE {val} END")


def comparable_register(month_col: str, case_sensitive=False, cols=("province",)) -> str:
    flag = month_col if case_sensitive else f"upper({month_col})"
    c = "".join(f", {x}" for x in cols)
    return (f"SELECT store_id{c} FROM register WHERE store_id IS NOT NULL AND name IS NOT NULL "
            f"AND open_date IS NOT NULL AND {month_col} IS NOT NULL AND {flag} = 'SC'")


def cube_cte(years, month_col: str, where: str, cols=("province",)) -> str:
    reg = comparable_register(month_col, cols=cols)
    c = "".join(f", r.{x}" for x in cols)
    return f"""cube AS (
  SELECT m.*{c} FROM measures m JOIN ({reg}) r ON m.store_id = r.store_id
  WHERE m.year IN ({', '.join(str(y) for y in years)}) AND {where})"""


def lit(v) -> str:
    return f"'{v}'" if isinstance(v, str) else str(v)


def growth_report(dims, years, measures=("VCT", "VOL", "DEB"), resum=False, wide=None,
                  digits=1, fill=None, require=(), src="cube", axis="year", scale=100) -> str:
    """Two-step growth table: long (dims, measure) sums with growth, then an
    optional pivot of measures into <measure>_<metric> columns."""
    dims = list(dims)
    keys = dims + ["measure"]
    notnull = " AND ".join(f"{k} IS NOT NULL" for k in dict.fromkeys(keys + list(require)))
    by = ", ".join(keys)
    b = f"CAST(sum(value) FILTER (WHERE {axis} = {lit(years[0])}) AS DOUBLE)"
    c = f"CAST(sum(value) FILTER (WHERE {axis} = {lit(years[1])}) AS DOUBLE)"
    if resum:
        b, c = f"coalesce({b}, 0.0)", f"coalesce({c}, 0.0)"
    long = (f"SELECT {by}, base, current, "
            f"{growth('base', 'current', scale=scale, digits=digits)} AS growth "
            f"FROM (SELECT {by}, {b} AS base, {c} AS current FROM {src} "
            f"WHERE {axis} IN ({lit(years[0])}, {lit(years[1])}) "
            f"AND measure IN ({in_list(measures)}) "
            f"AND {notnull} GROUP BY {by})")
    if wide is None:
        if fill is not None:
            return (f"SELECT {by}, coalesce(base, {fill}) AS base, coalesce(current, {fill}) AS current, "
                    f"coalesce(growth, {fill}) AS growth FROM ({long})")
        return long
    cols = []
    for m in measures:
        for k in ("base", "current", "growth"):
            if wide == "sum":
                e = (f"CASE WHEN count(*) FILTER (WHERE measure = '{m}') > 0 THEN "
                     f"coalesce(sum({k}) FILTER (WHERE measure = '{m}'), 0.0) END")
            else:
                e = f"avg({k}) FILTER (WHERE measure = '{m}')"
            if fill is not None:
                e = f"coalesce({e}, {fill})"
            cols.append(f"{e} AS {m}_{k}")
    dsel = ", ".join(dims)
    if dims:
        return f"SELECT {dsel}, {', '.join(cols)} FROM ({long}) GROUP BY {dsel}"
    return f"SELECT {', '.join(cols)} FROM ({long})"
