"""comparo: like-for-like retail growth analytics on Spark DataFrames.

Sub-packages:

* ``functions`` – column expressions (locale numbers, labels, dates, growth).
* ``operators`` – DataFrame -> DataFrame building blocks (filters, joins,
  conditional-sum pivots, grouping sets, unpivots, unions, sorts).
* ``sources``   – report readers, writers and the driver-table stand-ins.
* ``plans``     – the report pipelines a user calls (monthly, year-to-date,
  comparison series, briefing, extended hours, weekday, share, register).
* ``streaming`` – the only incremental behaviour: idempotent monthly append.
"""

from comparo.session import get_spark, checkpoint_dir, materialize  # noqa: F401

__all__ = ["get_spark", "checkpoint_dir", "materialize"]
