"""Tables stored by key, so that joins and sums on the key move nothing.

The fact and the register are written in the same number of buckets of the store id. A join of the two on that id and a
sum by store then need no shuffle: each task reads one bucket of both. The layout pays off for a fact that many
reports join and sum by store; it costs one shuffle when it is written.

A store that holds a large share of the lines would make its bucket as large. Heavy stores (``operators.skew``) are
therefore dealt to ``parts`` parts, the buckets go by (store id, part), and the register holds a heavy store once for each part. The
join still moves nothing; sums are then taken by store and part first, and only those few sums move.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from comparo.operators.skew import heavy_keys
from comparo.session import checkpoint_dir, freed_shuffles

PART = "_part"


class Stored(NamedTuple):
    """A fact and a register in buckets of the same keys."""

    fact: str
    register: str
    keys: tuple[str, ...]

    def joined(self, spark: SparkSession, how: str = "inner", where=None) -> DataFrame:
        """Fact and register rows of the same store; ``where`` filters the register."""
        register = spark.table(self.register)
        return spark.table(self.fact).join(register if where is None else register.filter(where), list(self.keys), how)

    def drop(self, spark: SparkSession) -> None:
        for name in (self.fact, self.register):
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _save(df: DataFrame, name: str, keys, buckets: int) -> str:
    table = f"{name}_{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{table}"
    with freed_shuffles(df.sparkSession):
        # one file a bucket: every task has the rows of its buckets alone
        (df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table))
    return table


def store_by_key(fact: DataFrame, register: DataFrame, key: str = "store_id", *, buckets: int = 64, parts: int = 16,
                 heavy: list | None = None) -> Stored:
    """Write both tables in buckets of `key`; ``heavy`` gives the heavy keys if the caller knows them."""
    heavy = heavy_keys(fact, key, share=2 / buckets) if heavy is None else heavy
    keys: tuple[str, ...] = (key,)
    if heavy:
        keys = (key, PART)
        dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(parts)).cast("int")
        fact = fact.withColumn(PART, F.when(F.col(key).isin(heavy), dealt).otherwise(F.lit(0)))
        copies = F.when(F.col(key).isin(heavy), F.sequence(F.lit(0), F.lit(parts - 1))).otherwise(F.array(F.lit(0)))
        register = register.withColumn(PART, F.explode(copies))
    return Stored(_save(fact, "fact", keys, buckets), _save(register, "register", keys, buckets), keys)


def sums_by_store(rows: DataFrame, stored: Stored, by, sums: dict) -> DataFrame:
    """Sums of a join of `stored` by its key and `by` ({name: column}); no shuffle unless a store is split."""
    key, *part = stored.keys
    first = rows.groupBy(*stored.keys, *by).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    return first.groupBy(key, *by).agg(*[F.sum(n).alias(n) for n in sums]) if part else first
