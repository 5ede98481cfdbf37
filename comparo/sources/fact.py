"""The fact table landed by year and month, and reading the months a report needs.

A report covers some months of some years. The lines are therefore landed in one folder per year and month;
a report's period becomes a predicate on those two columns, so Spark lists and reads the folders of its
months alone (``PartitionFilters``). Where the period is itself a table (:func:`period_table`), a semi-join with
it prunes at run time (dynamic partition pruning).

Landing writes each month in files of like size however uneven the months are: the rebalance hint lets
AQE split a month that holds a third of all lines and put small ones together. The landed table is a
versioned one (``sources.versions``): a failed landing leaves no half table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from comparo.session import checkpoint_dir
from comparo.sources import versions

PERIOD = ("year", "month")


def land_fact(lines: DataFrame, root: str) -> int:
    """Write `lines` (with year and month) as the new version of the fact at `root`."""
    return versions.publish(lines.hint("rebalance", *[F.col(c) for c in PERIOD]), root, partition_by=PERIOD)


def signature(spark: SparkSession, *paths: str) -> str:
    """A name for the state of some inputs: it changes when files are added, replaced or rewritten."""
    state = []
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        total = fs.getContentSummary(at)
        state.append((path, total.getLength(), total.getFileCount(), fs.getFileStatus(at).getModificationTime()))
    return hashlib.sha256(repr(state).encode()).hexdigest()[:24]


def landed(spark: SparkSession, name: str, inputs, make) -> DataFrame:
    """The fact that `make()` derives from the files `inputs`, landed once a session for their present state."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{signature(spark, *inputs)}"
    if not versions.current(spark, root)[1]:
        land_fact(make(), root)
    return versions.read(spark, root)


def months_of(ranges) -> list[tuple[int, int, int]]:
    """(year, first month, last month) of the half-open ranges of days, which begin and end with a month."""
    out = []
    for start, end in ranges:
        (y, m, d), (end_y, end_m, end_d) = (tuple(map(int, x.split("-"))) for x in (start, end))
        if d != 1 or end_d != 1:
            raise ValueError(f"a period of whole months is asked for, got {start} to {end}")
        last = end_y * 12 + end_m - 2      # months from year 0, the last one that belongs
        for year in range(y, last // 12 + 1):
            out.append((year, m if year == y else 1, last % 12 + 1 if year == last // 12 else 12))
    return out


def in_months(ranges) -> Column:
    """A predicate on year and month alone, for the folders to read."""
    cond = F.lit(False)
    for year, first, last in months_of(ranges):
        cond = cond | ((F.col("year") == year) & F.col("month").between(first, last))
    return cond


def period_table(spark: SparkSession, ranges) -> DataFrame:
    """(year, month) rows of the ranges: bounded by the calendar."""
    rows = [(y, m) for y, first, last in months_of(ranges) for m in range(first, last + 1)]
    return spark.createDataFrame(rows, "year int, month int")


def in_periods(fact: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows of the months that the table `periods` holds; only their folders are read."""
    return fact.join(F.broadcast(periods.select(*PERIOD).distinct()), list(PERIOD), "left_semi")
