"""Split joins: same rows as a plain join, and no task with a third of them."""

import pytest
from pyspark.sql import functions as F

from comparo.operators.skew import heavy_keys, spread_join


def lines(spark, n=9000):
    """A third of the lines on part 7, some without a part."""
    return spark.range(n).selectExpr("if(id % 3 = 0, 7, if(id % 100 = 1, null, id % 500)) as part", "id as line")


def parts(spark):
    return spark.range(400).selectExpr("id as part", "concat('p', id) as name").unionByName(
        spark.range(2).selectExpr("7L as part", "'again' as name"))


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_same_rows_as_a_plain_join(spark, how):
    a, b = lines(spark), parts(spark)
    assert rows(spread_join(a, b, "part", how, parts=5)) == rows(a.join(b, ["part"], how))
    assert rows(spread_join(a, b, "part", how, heavy=[])) == rows(a.join(b, ["part"], how))


def test_heavy_keys(spark):
    assert heavy_keys(lines(spark), "part") == [7]
    assert heavy_keys(lines(spark).where("part <> 7"), "part", share=0.01) == []
    assert heavy_keys(lines(spark).limit(0), "part") == []
    text = lines(spark).withColumn("part", F.concat(F.lit("x"), "part"))
    assert heavy_keys(text, "part") == ["x7"]


def test_no_task_gets_the_hot_part(spark):
    """With AQE and broadcasts off, as on a session that is not ours: rows of the largest task against the mean."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "12"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        largest = lambda df: max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())
        a, b = lines(spark, 30_000), parts(spark).dropDuplicates(["part"])
        plain, split = largest(a.join(b, "part")), largest(spread_join(a, b, "part"))
        assert plain > 10_000 and split < 2 * 30_000 / 12
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_other_joins_are_refused(spark):
    with pytest.raises(ValueError):
        spread_join(lines(spark), parts(spark), "part", "full")


def _exchanges(df):
    return sum("Exchange hashpartitioning" in x for x in df._jdf.queryExecution().executedPlan().toString().splitlines())


@pytest.mark.parametrize("hot", [False, True])
def test_stored_by_key_joins_and_sums_in_place(spark, hot):
    """No shuffle between scan, join and sum; a store with a third of the lines is split, and only its few sums move."""
    from comparo.sources.bucketed import store_by_key, sums_by_store
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    fact = spark.range(6000).selectExpr(f"if({'id % 3 = 0' if hot else 'false'}, 7, id % 200) as store_id", "2001 as year", "1.5D as sales")
    register = spark.range(150).selectExpr("id as store_id", "concat('p', id % 5) as province")
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        stored = store_by_key(fact, register, buckets=8, parts=32)
        assert stored.keys == (("store_id", "_part") if hot else ("store_id",))
        joined = stored.joined(spark, where=F.col("province") != "p1")
        assert _exchanges(joined) == 0
        semi = stored.joined(spark, "left_semi")
        assert _exchanges(semi) == 0
        out = sums_by_store(joined, stored, ["province"], {"sales": "sales"})
        assert _exchanges(out) == (1 if hot else 0)
        want = fact.join(register.where("province <> 'p1'"), "store_id").groupBy("store_id", "province").agg(F.sum("sales").alias("sales"))
        assert rows(out) == rows(want)
        if hot:
            per_task = [r["count"] for r in spark.table(stored.fact).groupBy(F.spark_partition_id()).count().collect()]
            assert max(per_task) < 2000
        stored.drop(spark)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
