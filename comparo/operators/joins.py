"""Joins and de-duplication.

Broadcast policy (``broadcast=`` argument):

* ``'auto'``    – no hint. The planner broadcasts a side whose size in bytes,
  known from its files, is below ``spark.sql.autoBroadcastJoinThreshold``, and
  AQE does so from the measured shuffle size at run time; otherwise it is a
  shuffle join with AQE skew splitting. The store register and every
  intermediate result are joined this way.
* ``'bounded'`` – the key domain proves the size (one row per month, per store
  format): broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _side(df: DataFrame, broadcast: str) -> DataFrame:
    if broadcast == "bounded":
        return F.broadcast(df)
    if broadcast == "auto":
        return df
    raise ValueError(f"broadcast must be bounded or auto, got {broadcast!r}")


def with_register(fact: DataFrame, register: DataFrame, on=("store_id",),
                  how: str = "left", cols=None) -> DataFrame:
    """Fact ⟕ register on the store key (JN-1/2/3). ``cols`` limits the
    register columns carried over (the keys are always kept)."""
    on = [on] if isinstance(on, str) else list(on)
    reg = register
    if cols is not None:
        reg = reg.select(*on, *[c for c in cols if c not in on])
    return fact.join(reg, on=on, how=how)


def attach(df: DataFrame, other: DataFrame, on, how: str = "left", broadcast: str = "auto") -> DataFrame:
    """Attribute attach (JN-4/5/6) under the broadcast policy above."""
    on = [on] if isinstance(on, str) else list(on)
    return df.join(_side(other, broadcast), on=on, how=how)


def first_per_key(df: DataFrame, key, order: str, cols=None) -> DataFrame:
    """Keep the first row per key by ``order`` (DED-1).

    Written as ``min_by`` over a struct so that it aggregates map-side:
    a key holding a third of all rows is combined before the shuffle
    instead of being sorted in one task as a window would do.
    """
    keys = [key] if isinstance(key, str) else list(key)
    cols = [c for c in (cols or df.columns) if c not in keys and c != order]
    packed = F.struct(*[F.col(c) for c in cols])
    return (df.groupBy(*keys)
              .agg(F.min_by(packed, F.col(order)).alias("_first"))
              .select(*keys, *[F.col(f"_first.{c}").alias(c) for c in cols]))


def distinct_pairs(df: DataFrame, cols) -> DataFrame:
    """Distinct combinations (DED-2); aggregates map-side."""
    return df.select(*cols).dropDuplicates()
