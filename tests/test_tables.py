"""Versioned tables, the landed fact and its periods."""

import uuid

import pytest
from pyspark.sql import functions as F

from comparo.session import checkpoint_dir
from comparo.sources import fact, versions


@pytest.fixture
def root(spark):
    return f"{checkpoint_dir(spark)}/versions-{uuid.uuid4().hex}"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_publish_replaces_the_whole_table(spark, root):
    assert versions.current(spark, root) == (0, {})
    with pytest.raises(ValueError):
        versions.read(spark, root)
    assert versions.publish(spark.range(3), root) == 1
    assert versions.publish(spark.range(5, 7), root) == 2
    assert rows(versions.read(spark, root)) == [(5,), (6,)]
    assert rows(versions.read(spark, root, version=1)) == [(0,), (1,), (2,)]
    assert versions.vacuum(spark, root) == 1
    assert rows(versions.read(spark, root)) == [(5,), (6,)]
    with pytest.raises(Exception):
        versions.read(spark, root, version=1)


def test_a_write_that_fails_midway_leaves_the_old_table(spark, root):
    versions.publish(spark.range(100), root)
    bad = spark.range(1000).repartition(8).select(
        F.when(F.col("id") == 777, F.raise_error(F.lit("disk is gone"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="disk is gone"):
        versions.publish(bad, root)
    assert versions.read(spark, root).count() == 100 and versions.current(spark, root)[0] == 1
    with pytest.raises(Exception, match="disk is gone"):
        versions.publish_keys(bad.withColumn("m", F.lit("x")), f"{root}-k", "m")
    assert versions.current(spark, f"{root}-k") == (0, {})
    assert versions.publish(spark.range(2), root) == 2
    assert versions.vacuum(spark, root) >= 1                       # the old version, and what the failed write left
    assert rows(versions.read(spark, root)) == [(0,), (1,)]


def test_two_writers_of_the_same_state(spark, root):
    versions.publish(spark.range(3), root)
    after, _ = versions.current(spark, root)
    versions.publish(spark.range(4), root)
    with pytest.raises(versions.ConcurrentChange):
        versions._commit(spark, root, after, {"": "v-late"})
    assert versions.read(spark, root).count() == 4


def test_months_are_replaced_alone(spark, root):
    df = lambda *r: spark.createDataFrame(list(r), "month string, k string, v int")
    versions.publish_keys(df(("2025-11", "a", 1), ("2025-12", "a", 2)), root, "month")
    _, first = versions.current(spark, root)
    versions.publish_keys(df(("2025-12", "b", 3), ("2025-12", "c", 4), ("odd = / name", "d", 5)), root, "month")
    _, second = versions.current(spark, root)
    assert first["2025-11"] == second["2025-11"] and first["2025-12"] != second["2025-12"]
    assert rows(versions.read(spark, root)) == [("2025-11", "a", 1), ("2025-12", "b", 3), ("2025-12", "c", 4), ("odd = / name", "d", 5)]
    assert rows(versions.read(spark, root, keys=["2025-12"])) == [("2025-12", "b", 3), ("2025-12", "c", 4)]
    assert versions.read(spark, root, keys=["2031-01"]).count() == 0
    assert versions.vacuum(spark, root) == 1                      # December of the first version
    assert versions.read(spark, root).count() == 4
    with pytest.raises(ValueError):
        versions.publish(spark.range(1), f"{root}-whole") and versions.publish_keys(df(("x", "y", 1)), f"{root}-whole", "month")


def test_months_of_ranges():
    assert fact.months_of([("2000-08-01", "2001-08-01")]) == [(2000, 8, 12), (2001, 1, 7)]
    assert fact.months_of([("2000-01-01", "2001-01-01"), ("2001-12-01", "2002-01-01")]) == [(2000, 1, 12), (2001, 12, 12)]
    with pytest.raises(ValueError):
        fact.months_of([("2000-01-15", "2000-02-01")])


def test_landed_fact_is_read_by_month(spark, root):
    lines = spark.range(2400).selectExpr("cast(2000 + id % 2 as int) as year", "cast(id % 12 + 1 as int) as month", "id as v")
    fact.land_fact(lines, root)
    back = versions.read(spark, root)
    assert rows(back.select("year", "month", "v")) == rows(lines)
    some = back.filter(fact.in_months([("2000-03-01", "2000-05-01")]))
    want = rows(lines.where("year = 2000 and month in (3, 4)"))
    assert rows(some.select("year", "month", "v")) == want
    scan = next(x for x in some._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x)
    assert "DataFilters: []" in scan and "(month#" in scan
    periods = fact.period_table(spark, [("2000-03-01", "2000-05-01")])
    joined = fact.in_periods(back, periods.where("month > 0"))
    assert rows(joined.select("year", "month", "v")) == want
    assert "dynamicpruningexpression" in joined._jdf.queryExecution().executedPlan().toString()


def test_a_month_that_holds_most_lines_is_written_by_many_tasks(spark, root):
    conf = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        lines = spark.range(0, 60_000, 1, 6).selectExpr("2000 as year", "cast(if(id % 3 > 0, 1, id % 12 + 1) as int) as month", "uuid() as v")
        fact.land_fact(lines, root)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files = versions.read(spark, root).where("month = 1").inputFiles()
    assert len([f for f in files if "month=1/" in f]) > 3


def test_signature_follows_the_files(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    spark.range(3).write.parquet(path)
    one = fact.signature(spark, path)
    assert fact.signature(spark, path) == one
    spark.range(4).write.mode("overwrite").parquet(path)
    assert fact.signature(spark, path) != one


def test_landing_happens_once_for_a_state(spark, tmp_path):
    path, made = f"file://{tmp_path}/t", []
    spark.range(3).write.parquet(path)

    def make():
        made.append(1)
        return spark.read.parquet(path).selectExpr("2000 as year", "1 as month", "id")
    for _ in range(2):
        assert fact.landed(spark, "t", [path], make).count() == 3
    assert len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(path)
    assert fact.landed(spark, "t", [path], make).count() == 5 and len(made) == 2


def test_monthly_sums_follow_a_full_run(spark, root):
    """A month loaded again after corrections, months in any order, one month read at a time."""
    from comparo.plans.measures import STORE_KEYS, to_measures
    from comparo.streaming.monthly_store import load_months, stored_sums
    columns = ("year int, month int, format string, store_id long, store string, sector string, section string, family string, "
               "sales decimal(24,6), units decimal(24,6), order_key long")
    make = lambda rows: spark.createDataFrame([(y, m, "f", s, f"s{s}", "a", "b", "c", v, v, o) for y, m, s, v, o in rows], columns)
    from decimal import Decimal as D
    old = [(2000, m, s, D(m * s), m * 10 + o) for m in (11, 12) for s in (1, 2) for o in (0, 1, 1)] + [(2001, 1, 1, D(5), 7)]
    new = [(2001, 1, 1, D(6), 7), (2001, 1, 1, D(6), 8), (2001, 1, 3, D(9), 9)]
    load_months(make(old), root)
    _, before = versions.current(spark, root)
    load_months(make(new), root)
    load_months(make(new), root)
    _, after = versions.current(spark, root)
    assert {k for k in after if after[k] == before.get(k)} == {"2000-11", "2000-12"}
    whole = to_measures(make([r for r in old if r[0] == 2000] + new), keys=STORE_KEYS, ticket_key="order_key")
    stored = stored_sums(spark, root, [("2000-11-01", "2001-02-01")])
    assert rows(stored.select(*whole.columns)) == rows(whole)
    january = stored_sums(spark, root, [("2001-01-01", "2001-02-01")])
    assert len({f.rsplit("/", 1)[0] for f in january.inputFiles()}) == 1
    assert {(r.store_id, float(r.value)) for r in january.where("measure = 'DEB'").collect()} == {(1, 2.0), (3, 1.0)}


def test_loading_a_month_reads_its_folder_alone(spark, sf_small):
    from comparo.catalog import month_ranges
    from comparo.sources import proxy as X
    from comparo.streaming.monthly_store import monthly_sums
    (last,) = month_ranges([2001], 7)
    plan = monthly_sums(X.lines(spark, sf_small, [last]))._jdf.queryExecution().executedPlan().toString()
    scan = [x for x in plan.splitlines() if "FileScan" in x]
    assert len(scan) == 1 and "(year#" in scan[0] and "= 2001" in scan[0] and "PartitionFilters" in scan[0]


def test_every_report_of_a_set_by_format(spark, sf_small):
    """All tables of the monthly and year-to-date sets written with a folder per format and read back."""
    from comparo.catalog import MONTH, MONTH_RANGES, YEARS, YTD_RANGES, measures
    from comparo.plans import monthly, ytd
    from comparo.sources import proxy as X
    from comparo.sources.writers import write_report_set
    reg = X.register(spark, sf_small)
    sets = {"monthly": monthly.monthly_reports(measures(spark, sf_small, ranges=MONTH_RANGES), reg, YEARS, MONTH, sort=False),
            "ytd": ytd.ytd_reports(measures(spark, sf_small, ranges=YTD_RANGES), reg, YEARS, MONTH, sort=False),
            "ytd-single": ytd.ytd_reports(measures(spark, sf_small, ranges=YTD_RANGES), reg, YEARS, MONTH, sort=False, single_format=True)}
    parted = 0
    for name, reports in sets.items():
        paths = write_report_set(reports, f"{checkpoint_dir(spark)}/sets-{uuid.uuid4().hex}/{name}", partition_by=["format"])
        assert len(paths) == len(reports) >= 9
        for table, df in reports.items():
            back = spark.read.parquet(paths[table])
            assert back.select(*df.columns).exceptAll(df).isEmpty() and df.exceptAll(back.select(*df.columns)).isEmpty(), (name, table)
            folders = {f.split("/format=")[1].split("/")[0] for f in back.inputFiles() if "/format=" in f}
            assert bool(folders) == ("format" in df.columns), (name, table)
            parted += bool(folders)
    assert parted >= 8


def test_materialized_tables_free_their_shuffles_and_go_when_discarded(spark):
    from comparo.session import discard, freed_shuffles, materialize
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    kept = materialize(df, name="kept")
    assert rows(kept) == rows(df) and kept.dtypes == df.dtypes
    assert spark.conf.get(key, "false") == before
    with freed_shuffles(spark):
        assert spark.conf.get(key) == "true"
    parted = materialize(df, name="parted", partition_by=["k"])
    assert rows(parted.select("k", "count")) == rows(df) and len(parted.where("k = 3").inputFiles()) >= 1
    files = kept.inputFiles()
    discard(kept)
    assert not any(spark._jvm.java.io.File(f.removeprefix("file:")).exists() for f in files)
    for how in ("cache", "none", "checkpoint"):
        assert rows(materialize(df, how)) == rows(df)
    with pytest.raises(ValueError):
        materialize(df, "elsewhere")
