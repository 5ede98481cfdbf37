"""Presentation orderings. Used only at the end of a report, always with
unique tie keys so the order is deterministic; and row numbers of an ordered report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from comparo.session import materialize


def order_by_growth(df: DataFrame, measure: str = "VOL", lead=(), ties=(),
                    growth_col: str | None = None) -> DataFrame:
    """Lead keys desc, growth of ``measure`` desc with NULLs last, then the
    tie keys ascending (SRT-1/2)."""
    g = growth_col or f"{measure}_growth"
    return df.orderBy(*[F.desc(c) for c in lead], F.desc_nulls_last(g),
                      *[F.asc(c) for c in ties])


def order_by(df: DataFrame, cols, desc: bool = True, ties=()) -> DataFrame:
    cols = [cols] if isinstance(cols, str) else list(cols)
    first = [F.desc_nulls_last(c) if desc else F.asc_nulls_last(c) for c in cols]
    return df.orderBy(*first, *[F.asc(c) for c in ties])


def numbered(df: DataFrame, out: str = "row_no") -> DataFrame:
    """Row numbers, from 1, of a report that was sorted last.

    The sort is a range shuffle: its tasks hold the report's parts in order. They are written with
    their task and place; a task's first number is the sum of the rows of the tasks before it (one count
    a task goes through the driver). No task ever holds the whole report, as a window over all rows would.
    """
    place = F.monotonically_increasing_id()        # task in the upper bits, place within it in the lower 33
    rows = materialize(df.withColumn("_place", place), name="ordered").withColumns(
        {"_task": F.shiftright("_place", 33), "_place": F.col("_place").bitwiseAND((1 << 33) - 1)})
    before, starts = 0, []
    for task, n in sorted(tuple(r) for r in rows.groupBy("_task").count().collect()):
        starts.append((task, before))
        before += n
    offsets = df.sparkSession.createDataFrame(starts, "_task long, _before long")
    return rows.join(F.broadcast(offsets), "_task").withColumn(
        out, F.col("_before") + F.col("_place") + 1).drop("_task", "_place", "_before")
