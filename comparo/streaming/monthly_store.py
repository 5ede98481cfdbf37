"""Monthly sums kept up to date.

The sums of a month (year, month, format, store, measure) are stored under the month's key of a versioned
table (``sources.versions``). Loading a month reads that month of the fact alone, sums it and puts its
rows in the place of those that were there; the other months are neither read nor written. So loading a month again, after
corrections too, gives the same table as summing everything anew, and a load that fails leaves the months as they were.
A load holds the whole month: ticket counts are distinct counts, which do not add up over parts of a month.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comparo.operators.filters import drop_null_keys
from comparo.plans.measures import STORE_KEYS, to_measures
from comparo.sources import versions
from comparo.sources.fact import months_of

KEY = "period"


def month_key(year: int, month: int) -> str:
    return f"{year:04d}-{month:02d}"


def monthly_sums(lines: DataFrame, **options) -> DataFrame:
    """Sales, units and tickets by store and month, with the month's key; ``options`` as for ``to_measures``."""
    sums = to_measures(drop_null_keys(lines, ["year", "month"]), keys=STORE_KEYS, ticket_key="order_key", **options)
    return sums.withColumn(KEY, F.format_string("%04d-%02d", F.col("year"), F.col("month")))


def load_months(lines: DataFrame, root: str, **options) -> int:
    """Put the sums of the months that `lines` holds into the table at `root`; `lines` holds those months whole."""
    return versions.publish_keys(monthly_sums(lines, **options), root, KEY)


def stored_sums(spark: SparkSession, root: str, ranges) -> DataFrame:
    """The stored sums of the months of `ranges`: the folders of those months alone are read."""
    keys = [month_key(y, m) for y, first, last in months_of(ranges) for m in range(first, last + 1)]
    return versions.read(spark, root, keys=keys).drop(KEY)
