"""Monthly growth series, stores against the format total (RPT-4, RPT-5).

For every month: sums per year (three years), growth of each consecutive
year pair (percent, 1 decimal), unpivoted into one row per pair with a
'MM-YY' period label. The total line is labelled 'Total Formato'; the store
lines carry their year sums truncated to integers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.functions import labels as L
from comparo.functions.text import period_label
from comparo.operators.filters import comparison_series
from comparo.operators.growth import growth_pairs
from comparo.operators.pivots import pivot_years, unpivot
from comparo.operators.sets import union_all
from comparo.plans.measures import VALUE_TYPE, comparable_cube

TOTAL_LABEL = "Total Formato"


def _series(cube: DataFrame, dims, years, pairs) -> DataFrame:
    wide = pivot_years(cube, ["month", *dims, "measure"], years)
    wide = growth_pairs(wide, pairs, scale=100, digits=1, out="growth_{c}")
    long = unpivot(wide, ["month", *dims, "measure", *[f"y{y}" for y in years]],
                   [f"growth_{c}" for _, c in pairs], "series", "value")
    year = F.substring_index(F.col("series"), "_", -1)
    return long.withColumns({
        "series": F.concat(F.lit("growth "), year),
        "period": period_label(F.col("month"), year),
        "month_name": F.get(F.array(*[F.lit(m) for m in L.MONTHS_ES]), F.col("month") - 1),
    })


def comparison(measures: DataFrame, register: DataFrame, years, pairs, month) -> DataFrame:
    """Both series from one aggregate: the total is a roll-up of the store rows, whose
    shuffle both read."""
    cube = comparable_cube(measures.filter(F.col("year").isin(*years)), register, month)
    by_store = cube.groupBy("year", "month", "store", "measure").agg(
        F.sum("value").cast(VALUE_TYPE).alias("value"))
    total = _series(by_store, [], years, pairs).withColumn("store", F.lit(TOTAL_LABEL))
    stores = _series(by_store, ["store"], years, pairs)
    stores = stores.withColumns({f"y{y}": F.col(f"y{y}").cast("bigint").cast("double")
                                 for y in years})
    return union_all(stores, total).orderBy("store", "measure", "month", "series")  # SRT-4


def total_series(measures, register, years, pairs, month) -> DataFrame:
    cube = comparable_cube(measures.filter(F.col("year").isin(*years)), register, month)
    return _series(cube, [], years, pairs).withColumn("store", F.lit(TOTAL_LABEL))


def store_series(measures, register, years, pairs, month) -> DataFrame:
    cube = comparable_cube(measures.filter(F.col("year").isin(*years)), register, month)
    s = _series(cube, ["store"], years, pairs)
    return s.withColumns({f"y{y}": F.col(f"y{y}").cast("bigint").cast("double") for y in years})


def selected(series: DataFrame, stores, measure: str) -> DataFrame:
    """Chosen stores and the total line for one measure (RPT-5)."""
    return comparison_series(series, stores, measure, total_label=TOTAL_LABEL)
