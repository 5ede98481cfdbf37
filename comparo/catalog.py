"""Query catalogue: one entry per operator / report of the blueprint.

Each entry takes ``(spark, sf_dir)`` and returns a lazy DataFrame built on
the proxy inputs of ``comparo.sources.proxy``. Metric columns are DOUBLE;
money is summed as DECIMAL first.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comparo.functions import labels as L
from comparo.functions.labels import month_column
from comparo.operators.aggregate import grouping_sets_sum
from comparo.operators.filters import comparable_predicate, exclude_packaging
from comparo.operators.joins import with_register
from comparo.operators.lattice import rollup_sums
from comparo.operators.sorts import numbered
from comparo.plans import monthly, ytd
from comparo.plans.measures import (LEAF_KEYS, STORE_KEYS, comparable_cube, measures_of, register_for_month,
                                    to_measures, with_first_sector)
from comparo.session import materialize
from comparo.sources import proxy as X

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
YEARS = (X.BASE_YEAR, X.CURRENT_YEAR)
MONTH = X.MONTH


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn
    return deco


GRAINS = {"leaf": LEAF_KEYS, "store": STORE_KEYS, "sector": STORE_KEYS + ["sector"]}


def measures(spark: SparkSession, d: str, *, contains: bool = False, grain: str = "leaf",
             ranges=None, comparable: int | None = None) -> DataFrame:
    """The long fact aggregated straight from the lines at the coarsest grain
    a report needs ('store' reports never pay for the product-leaf groups);
    ``ranges`` are the report's date ranges, pushed into the orders scan;
    ``comparable`` keeps the like-for-like stores of that month before anything
    is aggregated. Tickets do not read the part table."""
    keys = GRAINS[grain]
    stores = None if comparable is None else register_for_month(
        X.register(spark, d), comparable, cols=())
    packaging = {"packaging_token": X.PACKAGING_TOKEN} if contains else {"packaging": X.PACKAGING}
    if grain == "store":     # tickets counted in the same pass
        return to_measures(X.lines(spark, d, ranges), keys=keys, stores=stores, ticket_key="order_key", **packaging)
    return to_measures(X.lines(spark, d, ranges), X.tickets(spark, d, ranges=ranges), keys=keys,
                       stores=stores, **packaging)


def month_ranges(years, month):
    """[start, end) of one month in each year."""
    nxt = lambda y: (y + 1, 1) if month == 12 else (y, month + 1)
    return [(f"{y}-{month:02d}-01", "{}-{:02d}-01".format(*nxt(y))) for y in years]


def ytd_ranges(years, month):
    """[January 1st, first day after the limit month) in each year."""
    return [(f"{y}-01-01", r[1]) for y, r in zip(years, month_ranges(years, month))]


MONTH_RANGES = month_ranges(YEARS, MONTH)
YTD_RANGES = ytd_ranges(YEARS, MONTH)


def _grain_for(dims) -> str:
    return "leaf" if set(dims) & {"sector", "section", "family"} else "store"


def _double(df: DataFrame, col: str = "value") -> DataFrame:
    return df.withColumn(col, F.col(col).cast("double"))


# -- long fact, packaging, register join, comparability ---------------------------

@query("measures_long")
def q_measures_long(spark, d):
    return _double(measures(spark, d))


def _packaging(spark, d, **kw):
    lines = X.lines(spark, d).withColumn("measure", F.lit(L.UNITS))
    kept = exclude_packaging(lines, "family", **kw)
    return kept.groupBy("family").agg(
        F.sum("units").cast("double").alias("units"), F.count(F.lit(1)).alias("n_lines"))


@query("exclude_packaging_exact")
def q_pack_exact(spark, d):
    return _packaging(spark, d, families=X.PACKAGING)


@query("exclude_packaging_contains")
def q_pack_contains(spark, d):
    return _packaging(spark, d, contains=X.PACKAGING_TOKEN)


def _store_grain(m: DataFrame) -> DataFrame:
    return (m.groupBy("year", "month", "format", "store_id", "measure")
             .agg(F.sum("value").alias("value")))


@query("register_join_left")
def q_register_join_left(spark, d):
    reg = X.register(spark, d).select("store_id", "province", F.col("jul").alias("flag"))
    return _double(with_register(_store_grain(measures(spark, d, grain="store")), reg, how="left"))


@query("register_join_store_format")
def q_register_join_store_format(spark, d):
    from comparo.plans.store_facts import register_physical
    fact = _store_grain(measures(spark, d, grain="store")).withColumn("format", F.lower("format"))
    fact = fact.filter(F.col("format").isin(*L.REPORT_FORMATS))
    reg = register_physical(X.register(spark, d)).select("store_id", "format", "province", "m_salon")
    out = with_register(fact, reg, on=["store_id", "format"], how="left")
    return _double(_double(out), "m_salon")


@query("comparable_filter")
def q_comparable_filter(spark, d):
    cube = comparable_cube(_store_grain(measures(spark, d, grain="store")), X.register(spark, d),
                           MONTH)
    return _double(cube)


@query("comparable_case_policy")
def q_comparable_case_policy(spark, d):
    flag = month_column("Julio")
    reg = X.register(spark, d)
    return reg.select(
        "store_id", F.col(flag).alias("flag"),
        F.coalesce(comparable_predicate(flag, case_sensitive=False), F.lit(False)).alias("keep_upper"),
        F.coalesce(comparable_predicate(flag, case_sensitive=True), F.lit(False)).alias("keep_exact"))


# -- monthly (RPT-1) ------------------------------------------------------------

def _monthly(name):
    grain = "leaf" if name == "leaf" else _grain_for(monthly.SPEC[name].dims)

    def fn(spark, d):
        return monthly.monthly_report(measures(spark, d, grain=grain, ranges=MONTH_RANGES,
                                               comparable=MONTH),
                                      X.register(spark, d), name, YEARS, MONTH)
    return fn


for _n in [s.name for s in monthly.SPECS] + ["leaf"]:
    query("leaf_pivot" if _n == "leaf" else f"yoy_{_n}")(_monthly(_n))


SINGLE_FORMAT, NO_LEAF_FORMAT = "MARKET", "PROXIMIDAD"


# -- year to date (RPT-2 / RPT-3) -------------------------------------------------

def _ytd(name):
    spec = ytd.SINGLE_FORMAT_SPEC if name == "measure_single_format" else ytd.SPEC[name]
    grain = _grain_for(spec.dims)

    def fn(spark, d):
        m = measures(spark, d, grain=grain, ranges=YTD_RANGES, comparable=MONTH)
        if name == "measure_single_format":       # RPT-3: the input holds one format
            m = m.filter(F.col("format") == SINGLE_FORMAT)
        return ytd.ytd_report(m, X.register(spark, d), name, YEARS, MONTH)
    return fn


for _n in [s.name for s in ytd.SPECS] + ["measure_single_format"]:
    query(f"ytd_{_n}")(_ytd(_n))


@query("leaf_detail")
def q_leaf_detail(spark, d):
    return ytd.leaf_detail(measures(spark, d, ranges=YTD_RANGES, comparable=MONTH), X.register(spark, d), YEARS,
                           MONTH)


def _leaf_single(fmt):
    def fn(spark, d):
        m = measures(spark, d, ranges=YTD_RANGES, comparable=MONTH).filter(F.col("format") == fmt)
        return ytd.leaf_detail(m, X.register(spark, d), YEARS, MONTH, skip_format=NO_LEAF_FORMAT)
    return fn


query("leaf_detail_single_format")(_leaf_single(SINGLE_FORMAT))
query("leaf_detail_left_out")(_leaf_single(NO_LEAF_FORMAT))

GS_GRAINS = {
    "total": [], "format": ["format"], "province": ["province"],
    "province_format": ["format", "province"], "store": ["format", "store"],
    "sector": ["sector"], "section": ["section"], "family": ["family"],
}
GS_PRODUCT = ("sector", "section", "family")


@query("report_grouping_sets")
def q_report_grouping_sets(spark, d):
    cube = ytd.ytd_cube(measures(spark, d, ranges=YTD_RANGES, comparable=MONTH), X.register(spark, d),
                        YEARS, MONTH)
    out = grouping_sets_sum(cube, GS_GRAINS, exclude={g: [L.TICKETS] for g in GS_PRODUCT})
    cols = list(dict.fromkeys(k for ks in GS_GRAINS.values() for k in ks))
    return out.select("grain", *cols, "year", "measure", F.col("value").cast("double").alias("value"))


@query("report_rollup")
def q_report_rollup(spark, d):
    """The same tables, each grain from the smallest computed one."""
    from comparo.plans.reports import HUBS
    cube = ytd.ytd_cube(measures(spark, d, ranges=YTD_RANGES, comparable=MONTH), X.register(spark, d),
                        YEARS, MONTH)
    out = rollup_sums(cube, GS_GRAINS, HUBS, exclude={g: [L.TICKETS] for g in GS_PRODUCT})
    cols = list(dict.fromkeys(k for ks in GS_GRAINS.values() for k in ks))
    return out.select("grain", *cols, "year", "measure", F.col("value").cast("double").alias("value"))


# -- growth policies -------------------------------------------------------------------

def _store_family_long(spark, d):
    from comparo.operators.growth import growth_table
    cube = monthly.month_cube(measures(spark, d, ranges=MONTH_RANGES, comparable=MONTH), X.register(spark, d),
                              YEARS, MONTH)
    return growth_table(cube, ["store", "family"], YEARS, measures=L.PRODUCT_MEASURES,
                        resum=True).drop("growth")


@query("growth_zero_policies")
def q_growth_zero_policies(spark, d):
    from comparo.functions.numeric import growth
    t = _store_family_long(spark, d)
    return t.select("store", "family", "measure", "base", "current",
                    growth("base", "current", zero_base="inf").alias("growth_inf"),
                    growth("base", "current", zero_base="null").alias("growth_null"),
                    growth("base", "current", scale=1, digits=None, zero_base="zero")
                    .alias("growth_zero"))


@query("growth_rounding")
def q_growth_rounding(spark, d):
    from comparo.functions.numeric import growth
    t = _store_family_long(spark, d)
    return t.select("store", "family", "measure",
                    growth("base", "current", digits=1).alias("pct_1"),
                    growth("base", "current", digits=2).alias("pct_2"),
                    growth("base", "current", scale=1, digits=3).alias("frac_3"),
                    growth("base", "current", scale=1, digits=None).alias("frac"))


# -- comparison series (RPT-4 / RPT-5) ---------------------------------------------------

CMP_YEARS = X.HISTORY_YEARS
CMP_PAIRS = X.PAIRS
SELECTED_STORES = [f"{k}-Supplier#{k:09d}" for k in (1, 2, 3)]
CMP_RANGES = [(f"{CMP_YEARS[0]}-01-01", f"{CMP_YEARS[-1] + 1}-01-01")]


def _cmp(fn_name):
    def fn(spark, d):
        from comparo.plans import comparison as C
        return getattr(C, fn_name)(measures(spark, d, grain="store", ranges=CMP_RANGES, comparable=MONTH),
                                   X.register(spark, d), CMP_YEARS,
                                   CMP_PAIRS, MONTH)
    return fn


query("comparison_total_series")(_cmp("total_series"))
query("comparison_store_series")(_cmp("store_series"))
query("comparison_union")(_cmp("comparison"))


@query("comparison_selected")
def q_comparison_selected(spark, d):
    from comparo.plans import comparison as C
    series = C.comparison(measures(spark, d, grain="store", ranges=CMP_RANGES, comparable=MONTH),
                          X.register(spark, d), CMP_YEARS, CMP_PAIRS, MONTH)
    return C.selected(series, SELECTED_STORES, L.SALES)


# -- store facts (RPT-6 / RPT-7) ------------------------------------------------------------

def _store_fact(spark, d):
    """The long fact at store grain (already one row per store, month and measure)."""
    return _double(measures(spark, d, grain="store"))


@query("join_export_comparable")
def q_join_export_comparable(spark, d):
    from comparo.plans.store_facts import store_facts
    return store_facts(_store_fact(spark, d), X.register_raw(spark, d), MONTH,
                       comparable=True, as_of=X.AS_OF)


@query("join_export_all")
def q_join_export_all(spark, d):
    from comparo.plans.store_facts import store_facts
    return store_facts(_store_fact(spark, d), X.register_raw(spark, d), MONTH,
                       comparable=False, as_of=X.AS_OF)


@query("closure_buckets")
def q_closure_buckets(spark, d):
    from comparo.plans.store_facts import register_physical
    reg = register_physical(X.register_raw(spark, d), order="row_order", as_of=X.AS_OF)
    return reg.select("store_id", "name", "format", "close_date", "life")


@query("register_first_per_key")
def q_register_first_per_key(spark, d):
    from comparo.operators.joins import first_per_key
    raw = X.register_raw(spark, d).select("store_id", "name", "org", "row_order")
    return first_per_key(raw, "store_id", "row_order").na.drop(subset=["store_id", "name"])


@query("bucketed_store_totals")
def q_bucketed_store_totals(spark, d):
    """Sales and units of the comparable stores by year, from a fact and a register stored by store."""
    from comparo.sources.bucketed import store_by_key, sums_by_store
    fact = X.lines(spark, d).select("store_id", "year", "sales", "units")
    stored = store_by_key(fact, X.register(spark, d).select("store_id", "province", F.col("jul").alias("flag")), buckets=8)
    rows = stored.joined(spark, where=F.upper("flag") == "SC")
    out = sums_by_store(rows, stored, ["year", "province"], {"sales": "sales", "units": "units"})
    return _double(_double(out, "sales"), "units").select("store_id", "province", "year", "sales", "units")


# -- briefing (RPT-8) and rolling-period briefing (RPT-9) --------------------------------

def _lower_measure(df):
    return df.withColumn("measure", F.lower("measure"))


def _brief_scope(df, rolling: bool):
    from comparo.functions.dates import lit_date, month_start, period_split
    if not rolling:
        return df.filter((F.col("month") == X.BRIEF_MONTH) & F.col("year").isin(*X.BRIEF_YEARS))
    ms = month_start("year", "month")
    df = df.filter((ms >= lit_date(X.ROLLING_FROM)) & (ms < lit_date(X.AS_OF)))
    return df.withColumn("period", period_split(ms, X.AS_OF, new=X.PERIOD_NEW, old=X.PERIOD_OLD))


def _brief_ranges(rolling: bool):
    return [(X.ROLLING_FROM, X.AS_OF)] if rolling else month_ranges(X.BRIEF_YEARS, X.BRIEF_MONTH)


def brief_store_sector(spark, d, rolling: bool = False):
    """(store fact, sector fact) of the briefing period, tickets included, from one pass over the lines:
    the store-sector rows are written once and both facts are sums of them."""
    rows = materialize(with_first_sector(X.lines(spark, d, _brief_ranges(rolling)), packaging=X.PACKAGING),
                       name="store-sector")
    facts = (measures_of(rows, STORE_KEYS, "_store_tickets"), measures_of(rows, GRAINS["sector"], "_tickets"))
    return tuple(_lower_measure(_brief_scope(f, rolling)) for f in facts)


def brief_family(spark, d, rolling: bool = False):
    """Units by product leaf of the briefing period."""
    leaf = to_measures(X.lines(spark, d, _brief_ranges(rolling)), packaging=X.PACKAGING)
    return _lower_measure(_brief_scope(leaf.filter(F.col("measure") == L.UNITS), rolling))


def brief_inputs(spark, d, rolling: bool = False):
    """(store fact, sector fact, units-by-family fact) of the briefing period."""
    return *brief_store_sector(spark, d, rolling), brief_family(spark, d, rolling)


def _axis(rolling):
    return ("period", (X.PERIOD_OLD, X.PERIOD_NEW)) if rolling else ("year", X.BRIEF_YEARS)


def _brief(kind: str, comparable: bool = True, rolling: bool = False):
    def fn(spark, d):
        from comparo.plans import briefing as B
        reg = X.register(spark, d)
        keep = (lambda f: B.comparable_slice(f, reg, X.BRIEF_MONTH)) if comparable else (lambda f: f)
        if kind == "family":
            return B.family_contribution(keep(brief_family(spark, d, rolling)), *_axis(rolling))
        store, sector = map(keep, brief_store_sector(spark, d, rolling))
        axis, labels = _axis(rolling)
        if kind == "store":
            return B.store_growth(store, axis, labels, sort=True)
        if kind == "format":
            return B.format_growth(store, axis, labels, sort=True)
        if kind == "store_sector":
            return B.store_sector_growth(sector, axis, labels)
        if kind == "format_sector":
            return B.format_sector_matrix(sector, X.SECTORS, axis, labels)
        if kind == "store_sector_matrix":
            return B.store_sector_matrix(sector, store, X.SECTORS, axis, labels)
        if kind == "consolidated":
            return B.consolidated_matrix(sector, store, X.SECTORS, axis, labels)
        if kind == "four_levels":
            return B.four_levels(store, sector, axis, labels)
        raise KeyError(kind)
    return fn


query("briefing_store_comparable")(_brief("store"))
query("briefing_store_all")(_brief("store", comparable=False))
query("briefing_format")(_brief("format"))
query("briefing_format_all")(_brief("format", comparable=False))
query("briefing_format_sector")(_brief("format_sector"))
query("briefing_store_sector_matrix")(_brief("store_sector_matrix"))
query("briefing_consolidated_matrix")(_brief("consolidated"))
query("briefing_family_contribution")(_brief("family"))
query("briefing_four_levels")(_brief("four_levels"))
query("period_split_store")(_brief("store", rolling=True))
query("period_split_format")(_brief("format", rolling=True))
query("period_split_sector")(_brief("store_sector", rolling=True))
query("period_split_family")(_brief("family", rolling=True))
query("period_split_format_sector")(_brief("format_sector", rolling=True))
query("period_split_store_sector_matrix")(_brief("store_sector_matrix", rolling=True))
query("period_split_consolidated_matrix")(_brief("consolidated", rolling=True))
query("period_split_four_levels")(_brief("four_levels", rolling=True))


def _history(comparable: bool):
    def fn(spark, d):
        from comparo.plans import briefing as B
        rng = [(f"{X.BRIEF_HISTORY_YEARS[0]}-01-01", month_ranges([X.CURRENT_YEAR], X.BRIEF_MONTH)[0][1])]
        m = measures(spark, d, grain="store", ranges=rng)
        hist = _lower_measure(m.filter(F.col("year").isin(*X.BRIEF_HISTORY_YEARS))
                              .groupBy("year", "month", "format", "store_id", "store", "measure")
                              .agg(F.sum("value").alias("value")))
        reg = X.register(spark, d) if comparable else None
        return B.history_growth(hist, X.BRIEF_HISTORY_YEARS, X.BRIEF_PAIRS, X.CURRENT_YEAR,
                                X.BRIEF_MONTH, register=reg, month=X.BRIEF_MONTH)
    return fn


@query("history_incremental")
def q_history_incremental(spark, d):
    """The comparable history from stored monthly sums: all months but the last loaded before, the last one added."""
    from comparo.plans import briefing as B
    from comparo.streaming.monthly_store import load_months, stored_sums
    (start, end), last = (f"{X.BRIEF_HISTORY_YEARS[0]}-01-01", month_ranges([X.CURRENT_YEAR], X.BRIEF_MONTH)[0][1]), \
        month_ranges([X.CURRENT_YEAR], X.BRIEF_MONTH)[0]
    root = _scratch(spark, "monthly")
    load_months(X.lines(spark, d, [(start, last[0])]), root, packaging=X.PACKAGING)
    load_months(X.lines(spark, d, [last]), root, packaging=X.PACKAGING)        # the new month, read by itself
    hist = _lower_measure(stored_sums(spark, root, [(start, end)]))
    return B.history_growth(hist, X.BRIEF_HISTORY_YEARS, X.BRIEF_PAIRS, X.CURRENT_YEAR, X.BRIEF_MONTH,
                            register=X.register(spark, d), month=X.BRIEF_MONTH)


@query("history_file_ingest")
def q_history_file_ingest(spark, d):
    """The comparable history from three text reports: sales, units, tickets by store and month."""
    from comparo.plans import briefing as B
    from comparo.plans.ingest import history_from_reports
    from comparo.sources.readers import read_report_csv
    from comparo.sources.writers import write_locale_csv
    rng = [(f"{X.BRIEF_HISTORY_YEARS[0]}-01-01", month_ranges([X.CURRENT_YEAR], X.BRIEF_MONTH)[0][1])]
    facts = measures(spark, d, grain="store", ranges=rng)
    read = []
    for measure, header in ((L.SALES, "Ventas c/impuesto"), (L.UNITS, "VOLUMEN"), (L.TICKETS, "Cant. Tickets por Local")):
        text = X.history_report_text(facts, measure, header)
        path = write_locale_csv(text, _scratch(spark, "historia"), title=f"Historia, {header}")
        read.append(read_report_csv(spark, path, text.columns, parts=True))
    hist = history_from_reports(*read)
    return B.history_growth(hist, X.BRIEF_HISTORY_YEARS, X.BRIEF_PAIRS, X.CURRENT_YEAR, X.BRIEF_MONTH,
                            register=X.register(spark, d), month=X.BRIEF_MONTH)


query("history_growth_comparable")(_history(True))
query("history_growth_all")(_history(False))


# -- Sunday extended hours (RPT-10) ------------------------------------------------------

def _slots(spark, d):
    from comparo.plans import hours as H
    return H.slot_sales(X.slot_sales_sheet(spark, d))


@query("unpivot_stores")
def q_unpivot_stores(spark, d):
    return _slots(spark, d).withColumn("vct", F.col("vct").cast("double"))


@query("sundays_per_month")
def q_sundays_per_month(spark, d):
    from comparo.plans import hours as H
    return H.sundays_per_month(H.sundays(_slots(spark, d)))


@query("outside_hours_sales")
def q_outside_hours_sales(spark, d):
    from comparo.plans import hours as H
    hl = H.monthly_long(X.authorised_hours_wide(spark, d), "horas")
    return H.outside_hours_sales(H.sundays(_slots(spark, d)), H.opening(hl))


@query("hours_metrics")
def q_hours_metrics(spark, d):
    from comparo.plans import hours as H
    hl = H.monthly_long(X.authorised_hours_wide(spark, d), "horas")
    return H.hours_metrics(hl, H.sundays_per_month(H.sundays(_slots(spark, d))))


@query("baseline_hours")
def q_baseline_hours(spark, d):
    from comparo.plans import hours as H
    return H.baseline_hours(H.monthly_long(X.authorised_hours_wide(spark, d), "horas"))


@query("margin_ratio")
def q_margin_ratio(spark, d):
    from comparo.plans import hours as H
    return H.margin(X.margin_long(spark, d))


def _operating(spark, d):
    from comparo.plans import hours as H
    return H.operating_result(X.slot_sales_sheet(spark, d), X.staff_cost_wide(spark, d),
                              X.authorised_hours_wide(spark, d), X.margin_long(spark, d))


@query("operating_result")
def q_operating_result(spark, d):
    return _operating(spark, d)


@query("hours_wide")
def q_hours_wide(spark, d):
    from comparo.plans import hours as H
    return H.hours_wide(_operating(spark, d), H.MONTHS_LOWER)


@query("extended_hours_report")
def q_extended_hours_report(spark, d):
    """The whole report as presented, with its row numbers."""
    from comparo.plans import hours as H
    return numbered(H.extended_hours(X.slot_sales_sheet(spark, d), X.staff_cost_wide(spark, d),
                                      X.authorised_hours_wide(spark, d), X.margin_long(spark, d)))


# -- weekday (RPT-11), market share (RPT-12), register clean-up (RPT-13) -------------------

@query("weekday_enrich")
def q_weekday_enrich(spark, d):
    from comparo.plans.weekday import weekday_enrich
    return weekday_enrich(X.daily_report(spark, d, with_store=False))


@query("weekday_with_flag")
def q_weekday_with_flag(spark, d):
    from comparo.plans.weekday import weekday_enrich
    return weekday_enrich(X.daily_report(spark, d), X.register(spark, d), MONTH)


@query("share_long")
def q_share_long(spark, d):
    from comparo.plans.share import share_long
    return share_long(X.share_panel(spark, d), X.OWN_BRAND)


@query("share_last_closed_month")
def q_share_last_closed_month(spark, d):
    from comparo.plans.share import share_last_closed_month
    return share_last_closed_month(X.share_panel(spark, d), X.OWN_BRAND, X.AS_OF)


@query("share_labels")
def q_share_labels(spark, d):
    from comparo.plans.share import IDS, share_labels
    return share_labels(X.share_panel(spark, d), X.OWN_BRAND).select(*IDS).dropDuplicates()


@query("register_clean")
def q_register_clean(spark, d):
    from comparo.plans.register import clean_register
    return clean_register(X.register_full(spark, d), X.AS_OF)


@query("register_presented")
def q_register_presented(spark, d):
    """The register's columns normalised, then presented."""
    from comparo.operators.columns import normalize_columns, present_columns
    sheet = X.register_full(spark, d).select("GSX", "NOMBRE", "Fecha apertura", "SUB REGION", "M² SALÓN", "M² PGC", "PROVINCIA")
    return present_columns(normalize_columns(sheet))


# -- scalar functions over the tables --------------------------------------------------------

@query("parse_locale_decimal")
def q_parse_locale_decimal(spark, d):
    from comparo.functions.text import format_locale_decimal, parse_locale_decimal
    li = X.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(12,2)").alias("p"))
    text = format_locale_decimal(F.col("p"))
    return li.select("l_orderkey", "l_linenumber", text.alias("text"),
                     parse_locale_decimal(text).cast("double").alias("value"),
                     parse_locale_decimal(F.concat(text, F.lit("x"))).cast("double").alias("bad"))


@query("parse_locale_int")
def q_parse_locale_int(spark, d):
    from comparo.functions.text import (format_locale_decimal, parse_locale_int,
                                        parse_thousands)
    li = X.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(12,2)").alias("p"))
    text = format_locale_decimal(F.col("p"))
    tick = F.translate(F.format_number(F.col("l_orderkey") * 37, 0), ",", ".")
    return li.select("l_orderkey", "l_linenumber",
                     parse_locale_int(text).alias("truncated"),
                     parse_locale_int(text, truncate=False).cast("double").alias("kept"),
                     tick.alias("tickets_text"), parse_thousands(tick).alias("tickets"))


@query("store_id_dash")
def q_store_id_dash(spark, d):
    from comparo.functions.text import store_id
    li = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    label = X.store_label(F.col("l_suppkey"), "-")
    return li.select("l_orderkey", "l_linenumber", label.alias("store"),
                     store_id(label, "-").alias("store_id"))


@query("store_id_space")
def q_store_id_space(spark, d):
    from comparo.functions.text import store_id
    li = X.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    label = X.store_label(F.col("l_suppkey"), " ")
    return li.select("l_orderkey", "l_linenumber", label.alias("store"),
                     store_id(label, " ").alias("store_id"))


@query("month_token")
def q_month_token(spark, d):
    from comparo.functions.dates import month_from_name
    from comparo.functions.text import token
    o = X.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    month_es = F.get(F.array(*[F.lit(m) for m in L.MONTHS_ES]), F.month("o_orderdate") - 1)
    label = F.concat_ws(" ", month_es, F.year("o_orderdate").cast("string"))
    return o.select("o_orderkey", label.alias("period"),
                    month_from_name(token(label, 0)).alias("month"),
                    token(label, 1).alias("year"), token(label, 5).alias("missing"))


@query("period_label")
def q_period_label(spark, d):
    from comparo.functions.text import period_label
    o = X.table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return o.select("o_orderkey", period_label(F.month("o_orderdate"), F.year("o_orderdate"))
                    .alias("period"))


@query("time_minutes")
def q_time_minutes(spark, d):
    from comparo.functions.dates import opening_hours, time_minutes
    from comparo.functions.text import slot_start
    ev = X.table(spark, d, "events").select("event_id", "ts")
    hhmm = F.date_format("ts", "HH:mm")
    slot = F.concat(F.lit("Desde "), hhmm, F.lit(" Hasta 23:59"))
    hours = F.concat(hhmm, F.lit(" a 23:30"))
    o, c = opening_hours(hours)
    return ev.select("event_id", hhmm.alias("hhmm"), time_minutes(hhmm).alias("minutes"),
                     time_minutes(slot_start(slot)).alias("slot_start"),
                     o.alias("open_min"), c.alias("close_min"))


@query("date_parse")
def q_date_parse(spark, d):
    from comparo.functions.dates import format_date, parse_date
    reg = X.register(spark, d)
    return reg.select("store_id", "close_raw", parse_date("close_raw", "MM/dd/yyyy").alias("close_date"),
                      format_date("open_date", "dd/MM/yyyy").alias("open_text"))


@query("drop_null_columns")
def q_drop_null_columns(spark, d):
    from comparo.operators.filters import drop_null_columns
    return drop_null_columns(X.staff_cost_wide(spark, d))


@query("distinct_pairs")
def q_distinct_pairs(spark, d):
    from comparo.operators.joins import distinct_pairs
    from comparo.plans import hours as H
    return distinct_pairs(H.monthly_long(X.authorised_hours_wide(spark, d), "horas"),
                          ["no", "horario_anterior"])


# -- sources and sinks: write to the shared checkpoint folder, read back -----------------------

def _scratch(spark, name):
    import uuid

    from comparo.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("csv_utf16_roundtrip")
def q_csv_utf16_roundtrip(spark, d):
    from comparo.functions.text import parse_locale_decimal
    from comparo.sources.readers import read_report_csv
    from comparo.sources.writers import write_locale_csv
    rep = QUERIES["ytd_format"](spark, d)
    path = write_locale_csv(rep, _scratch(spark, "csv"), title="Acumulado por formato")
    back = read_report_csv(spark, path, rep.columns, parts=True)
    return back.select("format", "measure",
                       *[parse_locale_decimal(c, dtype="double").alias(c)
                         for c in ("base", "current", "growth")])


@query("report_set_roundtrip")
def q_report_set_roundtrip(spark, d):
    from comparo.sources.writers import write_report_set
    reps = monthly.monthly_reports(measures(spark, d, ranges=MONTH_RANGES, comparable=MONTH),
                                   X.register(spark, d), YEARS, MONTH,
                                   sort=False)
    paths = write_report_set(reps, _scratch(spark, "reports"))
    return spark.read.parquet(paths["store"])


def _partitioned(spark, reports: dict, name: str) -> DataFrame:
    """A report set written with a folder per format, one of its tables read back."""
    from comparo.sources.writers import write_report_set
    paths = write_report_set(reports, _scratch(spark, "by-format"), partition_by=["format"])
    return spark.read.parquet(paths[name]).select(*reports[name].columns)


@query("report_set_by_format")
def q_report_set_by_format(spark, d):
    reps = monthly.monthly_reports(measures(spark, d, ranges=MONTH_RANGES, comparable=MONTH),
                                   X.register(spark, d), YEARS, MONTH, sort=False)
    return _partitioned(spark, reps, "store_family")


@query("ytd_set_by_format")
def q_ytd_set_by_format(spark, d):
    reps = ytd.ytd_reports(measures(spark, d, ranges=YTD_RANGES, comparable=MONTH), X.register(spark, d), YEARS, MONTH,
                           sort=False)
    return _partitioned(spark, reps, "format")


@query("briefing_set_by_format")
def q_briefing_set_by_format(spark, d):
    from comparo.plans.briefing import briefing_reports
    store, sector, family = brief_inputs(spark, d)
    reps = briefing_reports(store, sector, family, X.register(spark, d), X.BRIEF_MONTH, X.SECTORS, labels=X.BRIEF_YEARS)
    return _partitioned(spark, reps, "consolidated_matrix")


@query("swap_table")
def q_swap_table(spark, d):
    """The cleaned register published twice to a versioned table, read as it is now."""
    from comparo.plans.register import clean_register
    from comparo.sources import versions
    reg = clean_register(X.register_full(spark, d), X.AS_OF)
    safe = reg.toDF(*[c.replace(" ", "_") for c in reg.columns])
    path = _scratch(spark, "versioned")
    versions.publish(safe.limit(3), path)
    versions.publish(safe, path)
    versions.vacuum(spark, path)
    return versions.read(spark, path).toDF(*reg.columns)


@query("append_month_idempotent")
def q_append_month_idempotent(spark, d):
    from comparo.plans.share import share_last_closed_month
    from comparo.streaming.incremental import append_month
    month = share_last_closed_month(X.share_panel(spark, d), X.OWN_BRAND, X.AS_OF)
    path = _scratch(spark, "share")
    append_month(month, path, "fecha_final")
    append_month(month, path, "fecha_final")
    back = spark.read.parquet(path)
    return back.select(*month.columns)


@query("overwrite_table")
def q_overwrite_table(spark, d):
    from comparo.plans.register import clean_register
    from comparo.sources.writers import save_table
    reg = clean_register(X.register_full(spark, d), X.AS_OF)
    safe = reg.toDF(*[c.replace(" ", "_") for c in reg.columns])
    path = _scratch(spark, "register")
    save_table(safe, path)
    save_table(safe, path)
    back = spark.read.parquet(path)
    return back.toDF(*reg.columns)


# -- final orders (SRT-1..5): the sorted reports with their row numbers ---------------------------

for _k in ("yoy_store", "yoy_family", "yoy_store_family", "comparison_union",
           "briefing_store_comparable", "briefing_family_contribution"):
    query(f"order_{_k}")(lambda spark, d, k=_k: numbered(QUERIES[k](spark, d)))


# -- report files: written, read back, parsed ----------------------------------------------------

@query("report_file_ingest")
def q_report_file_ingest(spark, d):
    """UTF-16 report files (title line with a comma, empty cells) back into the long fact."""
    from comparo.plans.ingest import SALES_REPORT, TICKETS_REPORT, lines_from_report, tickets_from_report
    from comparo.sources.readers import land, read_any, read_report_csv
    from comparo.sources.writers import write_locale_csv
    paths = [write_locale_csv(rep.select(*[F.col(f"`{c}`") for c in cols]), _scratch(spark, name), title=f"Informe, {name}",
                              compression="gzip")
             for rep, cols, name in ((X.sales_report_text(spark, d), SALES_REPORT, "ventas"),
                                     (X.tickets_report_text(spark, d), TICKETS_REPORT, "tickets"))]
    sales = land(read_report_csv(spark, paths[0], SALES_REPORT, parts=True).toDF(
        *[c.replace(" ", "_") for c in SALES_REPORT]), _scratch(spark, "landed"))
    lines = lines_from_report(sales.toDF(*SALES_REPORT))
    used = [c for c in TICKETS_REPORT if c != "Indicadores"]
    tickets = tickets_from_report(read_any(spark, paths[1], "csv", columns=TICKETS_REPORT, usecols=used, parts=True))
    return _double(to_measures(lines, tickets, packaging=X.PACKAGING))


@query("register_file_ingest")
def q_register_file_ingest(spark, d):
    """A register sheet below free text, with ids like '13.0' and repeated month headers."""
    from comparo.sources.readers import read_register
    from comparo.sources.writers import write_locale_csv
    sheet = X.register_sheet(spark, d)
    header = ["GSX", "NOMBRE", "ENE", "FEB", "ENE", "FEB"]
    path = write_locale_csv(sheet, _scratch(spark, "padron"), encoding="UTF-8", title="Padron, tiendas",
                            header=header)
    back = read_register(spark, path, header, parts=True)
    return back.select(F.col("GSX").try_cast("double").cast("bigint").alias("store_id"),
                       F.col("NOMBRE").alias("name"), F.col("ENE").alias("ene"), F.col("FEB").alias("feb"),
                       F.col("`ENE.1`").alias("ene_1"), F.col("`FEB.1`").alias("feb_1"))


def _sheet_file(spark, df: DataFrame, name: str, headers: dict | None = None, **kw) -> str:
    """`df` written as a sheet of text below a title; `headers` gives columns the header they have in the file."""
    from comparo.sources.writers import write_locale_csv
    return write_locale_csv(df, _scratch(spark, name), title=f"Planilla {name}, exportada",
                            header=[(headers or {}).get(c, c) for c in df.columns], encoding="UTF-8", **kw)


def _month_headers(df: DataFrame, write) -> dict:
    from comparo.sources.readers import header_month
    return {c: write(m) for c in df.columns if (m := header_month(c))}


@query("share_file_ingest")
def q_share_file_ingest(spark, d):
    """The market-share panel as a sheet file with dates for headers, read by its header row."""
    from comparo.plans.share import share_long
    from comparo.sources.readers import read_sheet
    panel = X.share_panel(spark, d)
    area, region, subregion, size, store = [k.upper() for k in L.SHARE_HEADERS]
    path = _sheet_file(spark, panel, "share", _month_headers(panel, lambda m: f"{m:%d/%m/%Y}"))
    back = read_sheet(spark, path, [area, region, subregion, size, store], parts=True)
    return share_long(back.withColumn(store, F.replace(F.col(store), F.lit(","), F.lit(".")).cast("double")), X.OWN_BRAND)


@query("hours_file_ingest")
def q_hours_file_ingest(spark, d):
    """Half-hour sales, staff cost, authorised hours and margins from files to the operating result."""
    from comparo.plans import hours as H
    from comparo.sources.readers import read_cells, read_delimited, read_sheet
    from comparo.sources.writers import write_sheet_csv
    ids = ["year", "date_text", "slot_text"]
    slot_path = write_sheet_csv(X.slot_sales_sheet(spark, d), ids, X.store_header(spark, d),
                                _scratch(spark, "slots"), title="Ventas por media hora, tiendas")
    sheets = []
    for df, name in ((X.staff_cost_wide(spark, d), "costo"), (X.authorised_hours_wide(spark, d), "horas")):
        headers = _month_headers(df, lambda m: f"{L.MONTHS_ES[m.month - 1]} {m.year}")
        sheet = read_sheet(spark, _sheet_file(spark, df, name, headers), ["no", "nombre", "horario_anterior"], parts=True)
        sheets.append(sheet.withColumn("no", F.col("no").cast("bigint")))
    margin = X.margin_long(spark, d)
    margin_path = _scratch(spark, "margen")
    margin.write.option("sep", ";").option("header", True).csv(margin_path)
    return H.operating_result(
        read_cells(spark, slot_path, ids), *sheets,
        read_delimited(spark, margin_path, "Periodo string, Tienda string, rubro string, importe string"))


@query("report_bad_rows")
def q_report_bad_rows(spark, d):
    """A report in which every 50th line has a surplus cell: good rows by month, and the quarantined ones."""
    from comparo.plans.ingest import SALES_REPORT, lines_from_report
    from comparo.sources.readers import read_report_csv
    from comparo.sources.writers import write_locale_csv
    text = X.sales_report_text(spark, d, key=True)
    surplus = F.when(F.col("_order") % 50 == 0, F.lit("sobra"))
    path = write_locale_csv(text.select(*[F.col(f"`{c}`") for c in SALES_REPORT], surplus.alias("_extra")),
                            _scratch(spark, "ragged"), title="Informe", header=[*SALES_REPORT, None], compression="gzip")
    read = read_report_csv(spark, path, SALES_REPORT, parts=True, bad_rows="keep")
    quarantine = _scratch(spark, "quarantine")
    read.quarantine(quarantine)
    good = lines_from_report(read.rows).groupBy("year", "month").agg(F.count(F.lit(1)).alias("n_good"))
    bad = spark.read.parquet(quarantine).select(F.regexp_extract("text", "([0-9]{4})", 1).cast("int").alias("year"), "cells")
    bad = bad.groupBy("year").agg(F.count(F.lit(1)).alias("n_bad"), F.max("cells").cast("bigint").alias("cells"))
    return good.groupBy("year").agg(F.sum("n_good").alias("n_good")).join(bad, "year", "left").select("year", "n_good", "n_bad", "cells")


# -- text reports -> long fact ------------------------------------------------------------------

@query("report_ingest")
def q_report_ingest(spark, d):
    """Locale-formatted text reports parsed back into the long fact."""
    from comparo.plans.ingest import lines_from_report, tickets_from_report
    lines = lines_from_report(X.sales_report_text(spark, d))
    tickets = tickets_from_report(X.tickets_report_text(spark, d))
    return _double(to_measures(lines, tickets, packaging=X.PACKAGING))
