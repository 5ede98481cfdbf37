"""Joins of a large side whose keys are uneven.

One product or store can hold a third of all lines. A shuffle join sends them to one task, unless the session lets AQE
split skewed partitions. Here the split is part of the plan: a sketch of frequent items finds the heavy keys in one
pass (a few values come to the driver), the lines of a heavy key are dealt to `parts` numbers, and the row that they are
joined to is there once for each number. All other keys have number 0 on both sides, so the smaller side grows by the few
heavy keys alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRACKED = 4096          # items that the sketch keeps
HEAVY = 64              # heavy keys at most
SHARE = 0.01            # of all rows: from here on a key is heavy


def heavy_keys(df: DataFrame, key: str, *, share: float = SHARE, most: int = HEAVY, tracked: int = TRACKED) -> list:
    """The values of `key` that may hold `share` of the rows or more, most frequent first.

    The sketch's counts are too high by less than rows / tracked, so no key that heavy is left out.
    """
    row = df.where(F.col(key).isNotNull()).agg(
        F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(`{key}`, {most}, {tracked})").alias("top")).first()
    return [x["item"] for x in row["top"] or [] if x["count"] >= share * row["n"]]


def _in(c: Column, values: list) -> Column:
    return c.isin(values) if values else F.lit(False)


def spread_join(df: DataFrame, other: DataFrame, on: str, how: str = "inner", *, parts: int | None = None,
                share: float = SHARE, heavy: list | None = None) -> DataFrame:
    """``df.join(other, on, how)`` (inner, left, left_semi or left_anti) with the heavy keys of `df` split.

    ``heavy`` gives the keys if the caller knows them. Rows whose key is NULL, which match nothing, are dealt out as well.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"how must be inner, left, left_semi or left_anti, got {how!r}")
    heavy = heavy_keys(df, on, share=share) if heavy is None else heavy
    parts = parts or max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    left = df.withColumn("_part", F.when(F.col(on).isNull() | _in(F.col(on), heavy), dealt).otherwise(F.lit(0)))
    copies = F.when(_in(F.col(on), heavy), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
    right = other.withColumn("_part", F.explode(copies))
    return left.join(right, [on, "_part"], how).drop("_part")
