"""Set operations: UNION ALL by name (SET-1..5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_all(*dfs: DataFrame, allow_missing: bool = True) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), dfs)


def union_levels(levels: dict, tag: str = "level") -> DataFrame:
    """UNION ALL of report levels, each tagged with its name (SET-4/5)."""
    return union_all(*[df.withColumn(tag, F.lit(name)) for name, df in levels.items()])
