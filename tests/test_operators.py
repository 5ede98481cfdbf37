"""Operators on literal fixtures (FIXTURES.md §3) and their invariants."""

import math

from pyspark.sql import functions as F

from comparo.operators.aggregate import grouping_sets_sum, partition_total
from comparo.operators.filters import (comparable, drop_null_columns, exclude_packaging,
                                       outside_hours)
from comparo.operators.growth import contribution, growth_table
from comparo.operators.joins import first_per_key
from comparo.operators.pivots import unpivot
from comparo.operators.sets import union_levels
from comparo.plans.briefing import family_contribution

E1 = [("A", 2024, 100.0), ("A", 2025, 110.5), ("B", 2024, 0.0), ("B", 2025, 5.0),
      ("C", 2025, 7.0), ("D", 2024, 9.0), ("E", 2024, 0.0), ("E", 2025, 0.0),
      ("F", 2024, 16.0), ("F", 2025, 17.0)]


def e1(spark):
    return (spark.createDataFrame(E1, "store string, year int, value double")
            .withColumn("measure", F.lit("VOL"))
            .withColumn("value", F.col("value").cast("decimal(18,4)")))


def by_store(df, col):
    return {r["store"]: r[col] for r in df.collect()}


def test_growth_pivot_once(spark):
    g = by_store(growth_table(e1(spark), ["store"], (2024, 2025), measures=("VOL",)), "growth")
    assert g == {"A": 10.5, "B": math.inf, "C": None, "D": None, "E": None, "F": 6.2}


def test_growth_resummed(spark):
    g = by_store(growth_table(e1(spark), ["store"], (2024, 2025), measures=("VOL",), resum=True),
                 "growth")
    assert g == {"A": 10.5, "B": math.inf, "C": math.inf, "D": -100.0, "E": None, "F": 6.2}


def test_growth_sum_pivot(spark):
    t = growth_table(e1(spark), ["store"], (2024, 2025), measures=("VOL", "VCT"), wide="sum")
    g = by_store(t, "VOL_growth")
    assert g == {"A": 10.5, "B": math.inf, "C": 0.0, "D": 0.0, "E": 0.0, "F": 6.2}
    assert set(by_store(t, "VCT_growth").values()) == {None}        # absent pair stays NULL
    assert by_store(t, "VOL_base")["C"] == 0.0


def test_growth_mean_pivot_keeps_null(spark):
    t = growth_table(e1(spark), ["store"], (2024, 2025), measures=("VOL",), wide="mean")
    assert by_store(t, "VOL_growth")["C"] is None


def test_contribution(spark):  # E2
    rows = [("F", "a", 100.0, 120.0), ("F", "b", None, 50.0), ("F", "c", 100.0, None)]
    df = spark.createDataFrame(rows, "format string, family string, b double, c double")
    long = (df.select("format", "family", F.lit("vol").alias("measure"), F.lit("section").alias("section"),
                      F.inline(F.array(F.struct(F.lit(2024).alias("year"), F.col("b").alias("value")),
                                       F.struct(F.lit(2025).alias("year"), F.col("c").alias("value")))))
            .filter(F.col("value").isNotNull())
            .withColumn("value", F.col("value").cast("decimal(18,4)")))
    out = {r["family"]: r for r in family_contribution(long, "year", (2024, 2025)).collect()}
    assert out["a"]["gap"] == 20.0 and abs(out["a"]["growth"] - 0.2) < 1e-12
    assert out["b"]["gap"] == 50.0 and out["b"]["growth"] == 0.0
    assert out["c"]["gap"] is None and out["c"]["growth"] == 0.0
    assert [out[k]["contribution"] for k in "abc"] == [0.1, 0.25, 0.0]


def test_keep_first_per_key(spark):  # E4
    rows = [(5, "a", 0), (5, "b", 1), (7, "c", 2), (5, "d", 3)]
    df = spark.createDataFrame(rows, "id int, name string, o int")
    got = sorted((r.id, r.name) for r in first_per_key(df, "id", "o").collect())
    assert got == [(5, "a"), (7, "c")]
    rows = [(5, None, 0), (5, "b", 1)]
    df = spark.createDataFrame(rows, "id int, name string, o int")
    assert first_per_key(df, "id", "o").na.drop(subset=["name"]).count() == 0


def test_comparable_case_policy(spark):  # E5
    df = spark.createDataFrame([("SC",), ("sc",), ("NSC",), (None,)], "f string")
    assert comparable(df, "f").count() == 2
    assert comparable(df, "f", case_sensitive=True).count() == 1


def test_packaging(spark):  # E10
    fam = ["ENVASES BEBIDAS", "ENVASES PAGADOS", "ENVASES X", "AGUAS", None]
    df = spark.createDataFrame([(f,) for f in fam], "family string")
    assert sorted(map(str, [r[0] for r in exclude_packaging(df).collect()])) == \
        ["AGUAS", "ENVASES X", "None"]
    assert sorted(map(str, [r[0] for r in exclude_packaging(df, contains="ENVASES").collect()])) == \
        ["AGUAS", "None"]


def test_null_group_key(spark):  # E11
    rows = [("P1", "F", 2025, 1.0), (None, "F", 2025, 2.0)]
    df = (spark.createDataFrame(rows, "province string, format string, year int, value double")
          .withColumn("measure", F.lit("VCT")))
    prov = growth_table(df, ["province"], (2024, 2025), measures=("VCT",))
    fmt = growth_table(df, ["format"], (2024, 2025), measures=("VCT",))
    assert prov.count() == 1
    assert fmt.first()["current"] == 3.0


def test_grouping_sets_equal_group_by(spark):
    rows = [("F1", "S1", "VCT", 2024, 1.0), ("F1", "S2", "VCT", 2024, 2.0),
            ("F2", "S1", "DEB", 2024, 4.0), ("F2", None, "VCT", 2025, 8.0)]
    df = spark.createDataFrame(rows, "format string, sector string, measure string, year int, value double")
    gs = grouping_sets_sum(df, {"total": [], "format": ["format"], "sector": ["sector"]},
                           exclude={"sector": ["DEB"]})
    got = {(r.grain, r.format, r.sector, r.measure, r.year): r.value for r in gs.collect()}
    assert got[("total", None, None, "VCT", 2024)] == 3.0
    assert got[("format", "F2", None, "VCT", 2025)] == 8.0
    assert ("sector", None, "S1", "DEB", 2024) not in got          # tickets not over products
    assert not any(k[0] == "sector" and k[2] is None for k in got)  # NULL key forms no group
    for (fmt, meas, year), v in {("F1", "VCT", 2024): 3.0, ("F2", "DEB", 2024): 4.0}.items():
        assert got[("format", fmt, None, meas, year)] == v


def test_partition_total_and_contribution(spark):
    df = spark.createDataFrame([("F", 10.0, 1.0), ("F", 30.0, -2.0), ("G", 5.0, 5.0)],
                               "format string, base double, gap double")
    out = contribution(df, "format").collect()
    s = {(r.format, r.base): r.contribution for r in out}
    assert s[("F", 10.0)] == 1.0 / 40.0 and s[("G", 5.0)] == 1.0
    zero = spark.createDataFrame([("Z", 0.0, 2.0), ("Z", 0.0, -2.0), ("Z", 0.0, 0.0), ("Z", 0.0, None)],
                                 "format string, base double, gap double")
    assert {r.gap: r.contribution for r in contribution(zero, "format").collect()} == {
        2.0: float("inf"), -2.0: float("-inf"), 0.0: 0.0, None: 0.0}
    assert {r.total for r in partition_total(df, "base", "format").collect()} == {40.0, 5.0}


def test_unpivot_and_union_levels(spark):
    df = spark.createDataFrame([(1, 2.0, None)], "id int, a double, b double")
    assert unpivot(df, ["id"], ["a", "b"], "k", "v").count() == 2
    assert unpivot(df, ["id"], ["a", "b"], "k", "v", drop_nulls=True).count() == 1
    u = union_levels({"x": df.select("id"), "y": df.select("id", "a")})
    assert sorted(r.level for r in u.collect()) == ["x", "y"]


def test_drop_null_columns(spark):
    df = spark.createDataFrame([(1, None, 3), (2, 5, 6)], "a int, b int, c int")
    assert drop_null_columns(df).columns == ["a", "c"]


def test_outside_hours(spark):  # E7
    df = spark.createDataFrame([(450,), (480,), (1230,), (1260,)], "slot_start int")
    df = df.withColumn("open_min", F.lit(480)).withColumn("close_min", F.lit(1260))
    assert sorted(r.slot_start for r in outside_hours(df).collect()) == [450, 1260]


def test_skew_safe_plans(spark):
    """Keep-first and partition totals aggregate map-side; no window sorts a
    whole key group inside one task."""
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"),
                                  (F.col("id") * 2).alias("v"))
    kf = first_per_key(df, "k", "o")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in kf
    assert "partial_min_by" in kf
    pt = partition_total(df, "v", "k")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in pt and "partial_sum" in pt
