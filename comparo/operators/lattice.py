"""Sums at many grains, each from the smallest one already computed.

``GROUPING SETS`` copies every row once for each grain before anything is summed. Sums (and counts that add up) can
instead be taken from coarser rows: the caller names a few *hubs*, fine enough for all reports
(store x sector, store, ...); each hub is summed once, from the smallest hub before it that has its keys, or from the
input; every report then reads the smallest hub that has its keys. Hubs are written to the shared folder, so
their rows are summed once whatever reads them.

A hub keeps the groups whose key is NULL: they leave the tables of that key and still count in coarser ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.operators.filters import drop_null_keys
from comparo.operators.sets import union_all
from comparo.session import materialize


class Hubs:
    """The hubs of an input, finest first, and what to read for a grain. The input's rows and all hubs are written by
    one job, to one table with a folder for each; where a hub is summed from another, both read the same shuffle."""

    def __init__(self, df: DataFrame, hubs, *, always=("year", "measure"), values=("value",), reuse: str = "table"):
        self.always, self.values = tuple(always), tuple(values)
        self.tables: list[tuple[frozenset, DataFrame]] = [(frozenset(df.columns), df)]
        for keys in hubs:
            rows = self.covering(keys).groupBy(*keys, *self.always).agg(*[F.sum(v).alias(v) for v in self.values])
            rows = rows.select(*keys, *self.always, *[F.col(v).cast(df.schema[v].dataType).alias(v) for v in self.values])
            self.tables.append((frozenset(keys) | set(self.always), rows))
        if reuse == "none":
            return
        tagged = [rows.withColumn("_hub", F.lit(k)) for k, (_, rows) in enumerate(self.tables)]
        written = materialize(union_all(*tagged), reuse, name="hubs", **({"partition_by": ["_hub"]} if reuse == "table" else {}))
        self.tables = [(own, written.filter(F.col("_hub") == k).select(*rows.columns))
                       for k, (own, rows) in enumerate(self.tables)]

    @property
    def input(self) -> DataFrame:
        return self.tables[0][1]

    def covering(self, keys) -> DataFrame:
        """The table with the fewest keys that has all of `keys`."""
        fit = [(len(own), k) for k, (own, _) in enumerate(self.tables) if own >= set(keys) | set(self.always)]
        if not fit:
            raise ValueError(f"no table with the keys {list(keys)}")
        return self.tables[min(fit)[1]][1]


def rollup_sums(df: DataFrame, grains: dict, hubs, *, always=("year", "measure"), value: str = "value",
                exclude: dict | None = None, grain_col: str = "grain", reuse: str = "table") -> DataFrame:
    """Sums of `value` at all `grains` ({name: keys}) in one table tagged by `grain_col`; same rows as
    ``grouping_sets_sum`` gives."""
    lattice = Hubs(df, hubs, always=always, values=(value,), reuse=reuse)
    columns = list(dict.fromkeys(k for keys in grains.values() for k in keys))
    parts = []
    for name, keys in grains.items():
        rows = drop_null_keys(lattice.covering(keys), list(keys))
        if exclude and exclude.get(name):
            rows = rows.filter(~F.col("measure").isin(*exclude[name]))
        rows = rows.groupBy(*keys, *always).agg(F.sum(value).alias(value))
        parts.append(rows.select(F.lit(name).alias(grain_col), *[
            F.col(c) if c in keys else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in columns], *always, value))
    return union_all(*parts)
