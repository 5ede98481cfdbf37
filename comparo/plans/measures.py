"""The canonical long fact and the comparable cube.

``measures``: year, month, format, store_id, store, sector, section, family,
measure ('VCT' sales with tax, 'VOL' units without packaging, 'DEB'
tickets), value DECIMAL. Sales and units are at product grain; tickets are
at store grain with NULL product keys (tickets are not additive over
products, so product reports leave them out).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from comparo.functions import labels as L
from comparo.functions.labels import month_column
from comparo.operators.filters import comparable_predicate, drop_null_keys, is_packaging
from comparo.operators.joins import with_register
from comparo.operators.pivots import stack_measures

STORE_KEYS = ["year", "month", "format", "store_id", "store"]
PRODUCT_KEYS = ["sector", "section", "family"]
LEAF_KEYS = STORE_KEYS + PRODUCT_KEYS
VALUE_TYPE = "decimal(38,6)"     # summed values
ROW_TYPE = VALUE_TYPE            # one line: as wide as the sums, so no amount is too large


def to_measures(lines: DataFrame, tickets: DataFrame | None = None, *,
                packaging=None, packaging_token: str | None = None,
                sales: str = "sales", units: str = "units", tick: str = "tickets",
                keys=LEAF_KEYS, stores: DataFrame | None = None,
                ticket_key: str | None = None) -> DataFrame:
    """Wide sales/units rows + ticket rows -> one long fact (UNP-5, FLT-3,
    AGG-1, SET-1). ``stores`` (store_id) keeps the rows of those stores, before
    anything is aggregated; ``ticket_key`` counts its distinct values at the
    grain of ``keys`` in the same pass, as tickets. Rows whose store keys are NULL are dropped (they never
    form a group); NULL product keys are kept for store-level totals."""
    keys = list(keys)
    store_keys = [k for k in keys if k not in PRODUCT_KEYS]
    if stores is not None:
        lines = lines.join(stores, "store_id", "left_semi")
        tickets = None if tickets is None else tickets.join(stores, "store_id", "left_semi")
    src = drop_null_keys(lines, store_keys)
    units_kept = F.when(~is_packaging("family", packaging, packaging_token), F.col(units))
    if set(keys) >= set(PRODUCT_KEYS):
        # at product grain nearly every line is a group of its own: a sum before the shuffle would hold all lines of a
        # task's files and send rows wider than the lines, so the lines are dealt out by their keys and summed there
        named = dict.fromkeys([*keys, "family", sales, units, *([ticket_key] if ticket_key else [])])
        src = src.select(*named).repartition(*keys)
    # both measures summed in the same row (half the rows through the hash
    # aggregation), stacked afterwards; a measure with no value forms no row
    wide = src.groupBy(*keys).agg(
        F.sum(F.col(sales).cast(ROW_TYPE)).alias("_sales"),
        F.sum(units_kept.cast(ROW_TYPE)).alias("_units"),
        *([F.countDistinct(ticket_key).cast(ROW_TYPE).alias("_tickets")] if ticket_key else []))
    stacked = {L.SALES: "_sales", L.UNITS: "_units"} | ({L.TICKETS: "_tickets"} if ticket_key else {})
    agg = (stack_measures(wide, keys, stacked)
           .filter(F.col("value").isNotNull())
           .withColumn("value", F.col("value").cast(VALUE_TYPE)))
    if tickets is None:
        return agg
    t = drop_null_keys(tickets.filter(F.col(tick).isNotNull()), store_keys)
    t = t.select(*store_keys,
                 *[F.lit(None).cast("string").alias(k) for k in keys if k in PRODUCT_KEYS],
                 F.lit(L.TICKETS).alias("measure"),
                 F.col(tick).cast(VALUE_TYPE).alias("value"))
    return agg.unionByName(t)


def with_first_sector(lines: DataFrame, *, order_key: str = "order_key", sector: str = "sector",
                      packaging=None, packaging_token: str | None = None, sales: str = "sales",
                      units: str = "units") -> DataFrame:
    """Store x sector rows (_sales, _units, _tickets, _store_tickets) whose ticket counts both add up.

    A ticket with lines of several sectors counts once in each (_tickets), so those counts do not add up to the
    store's. It is therefore also counted in the first of its sectors alone (_store_tickets): the sum of
    that column over any sectors of a store is the store's count of distinct tickets there, exactly, from one pass over
    the lines. (A bitmap of tickets for each store and sector would add up too, but with ticket numbers spread over
    all stores it holds 4 KB for nearly every ticket.) A ticket has few sectors, so the row numbers run
    over short groups; lines are summed by (store, sector, ticket) before any shuffle.
    """
    src = drop_null_keys(lines, STORE_KEYS)
    units_kept = F.when(~is_packaging("family", packaging, packaging_token), F.col(units))
    per_order = src.groupBy(*STORE_KEYS, sector, order_key).agg(
        F.sum(F.col(sales).cast(ROW_TYPE)).alias("_sales"), F.sum(units_kept.cast(ROW_TYPE)).alias("_units"))
    first = F.row_number().over(Window.partitionBy(*STORE_KEYS, order_key).orderBy(F.col(sector).asc_nulls_last())) == 1
    ticket = F.col(order_key).isNotNull()
    marked = per_order.withColumn("_first", F.when(ticket & first, F.lit(1)).otherwise(F.lit(0)))
    return marked.groupBy(*STORE_KEYS, sector).agg(
        F.sum("_sales").alias("_sales"), F.sum("_units").alias("_units"),
        F.count(F.col(order_key)).cast(ROW_TYPE).alias("_tickets"),
        F.sum("_first").cast(ROW_TYPE).alias("_store_tickets"))


def measures_of(rows: DataFrame, keys, tickets: str) -> DataFrame:
    """The long fact at the grain of `keys` from the rows of :func:`with_first_sector`: `tickets` is the
    column that adds up at that grain (a ticket count of 0 makes no row, as no line did)."""
    wide = rows.groupBy(*keys).agg(*[F.sum(c).cast(VALUE_TYPE).alias(c) for c in ("_sales", "_units", tickets)])
    long = stack_measures(wide, keys, {L.SALES: "_sales", L.UNITS: "_units", L.TICKETS: tickets})
    return long.filter(F.col("value").isNotNull())


def register_for_month(register: DataFrame, month, *, case_sensitive: bool = False,
                       cols=("province",), required=("name", "open_date")) -> DataFrame:
    """Register rows that are like-for-like in ``month`` (STR-11 + FLT-4).

    Rows missing the id, any ``required`` column or the month flag are
    dropped first; ``case_sensitive=False`` upper-cases the flag."""
    flag = month_column(month)
    reg = register.na.drop(subset=["store_id", *required, flag])
    reg = reg.filter(comparable_predicate(flag, case_sensitive))
    return reg.select("store_id", *cols)


def comparable_cube(measures: DataFrame, register: DataFrame, month, *,
                    case_sensitive: bool = False, cols=("province",)) -> DataFrame:
    """measures ⟕ register then keep 'SC' rows == inner join with the SC
    slice of the register (JN-1 + FLT-4). Give the same slice to
    ``to_measures(stores=)`` so that other stores are never aggregated."""
    reg = register_for_month(register, month, case_sensitive=case_sensitive, cols=cols)
    return with_register(measures, reg, how="inner")


def rolled_up(measures: DataFrame, keys) -> DataFrame:
    """Sales and units at a coarser grain, from rows already aggregated (tickets do not add up)."""
    return (measures.filter(F.col("measure") != L.TICKETS).groupBy(*keys, "measure")
            .agg(F.sum("value").cast(VALUE_TYPE).alias("value")))
