"""Idempotent monthly append (SNK-5).

The table is partitioned by the month column and written with dynamic
partition overwrite: loading a month replaces that month's partition only,
so running the same load twice leaves one copy (a plain append would
duplicate it). A load holds the whole month. The mode is an option of the
writer, so parallel writes of the session do not see it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def append_month(df: DataFrame, path: str, month_col: str, fmt: str = "parquet") -> str:
    (df.write.mode("overwrite").format(fmt).option("partitionOverwriteMode", "dynamic")
     .partitionBy(month_col).save(path))
    return path
