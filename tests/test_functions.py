"""Scalar functions on literal fixtures (FIXTURES.md §3)."""

import datetime as dt
import math

from pyspark.sql import functions as F

from comparo.functions import labels as L
from comparo.functions.dates import (closure_bucket, date_of, last_closed_month, month_from_name,
                                     opening_hours, parse_date, period_split, store_state,
                                     time_minutes, weekday_es, weekday_name)
from comparo.functions.numeric import growth, in_millions
from comparo.functions.text import (clean_sentinels, format_locale_decimal, parse_locale_decimal,
                                    parse_locale_int, parse_thousands, period_label, rest_label,
                                    size_range, slot_start, store_id, token, unify)


def one(spark, rows, schema, col):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_locale_numbers(spark):  # E3
    vals = one(spark, [("1.234,50",), ("12",), ("-3,25",), ("x",)], "s string",
               parse_locale_decimal("s").cast("double"))
    assert vals == [1234.5, 12.0, -3.25, None]
    assert one(spark, [("1.234,99",)], "s string", parse_locale_int("s")) == [1234]
    assert one(spark, [("12.345",)], "s string", parse_thousands("s")) == [12345]


def test_locale_strict_raises(spark):
    import pytest
    with pytest.raises(Exception):
        spark.createDataFrame([("x",)], "s string").select(
            parse_locale_decimal("s", on_error="raise")).collect()


def test_locale_format_round_trip(spark):
    vals = one(spark, [(1234567.5,)], "v double",
               format_locale_decimal(F.col("v").cast("decimal(12,2)")))
    assert vals == ["1.234.567,50"]


def test_labels_and_tokens(spark):
    df = spark.createDataFrame([("12-NAME X", "12 NAME", "Julio 2001")], "a string, b string, c string")
    r = df.select(store_id("a", "-"), store_id("b", " "), token("c", 0), token("c", 5),
                  month_from_name(token("c", 0)), period_label(F.lit(7), F.lit(2001))).first()
    assert list(r) == [12, 12, "Julio", None, 7, "07-01"]


def test_size_range(spark):  # E9
    assert one(spark, [("1-200-500",), ("3-1000",), ("abc",)], "s string", size_range("s")) == \
        ["200a500", "1000", None]


def test_dates_and_times(spark):  # E7
    df = spark.createDataFrame([("5 de Enero de 2025", "Desde 07:30 Hasta 08:00", "08:00 a 21:00")],
                               "d string, s string, h string")
    day = date_of(token("d", 4), month_from_name(token("d", 2)), token("d", 0))
    o, c = opening_hours("h")
    r = df.select(day, weekday_name(day), weekday_es(day), time_minutes(slot_start("s")), o, c).first()
    assert list(r) == [dt.date(2025, 1, 5), "Sunday", "Domingo", 450, 480, 1260]


def test_closure_buckets(spark):  # E6
    rows = [(None,), (dt.date(2025, 6, 1),), (dt.date(2024, 12, 31),), (dt.date(2026, 3, 1),),
            (dt.date(2024, 6, 1),), (dt.date(2023, 6, 1),), (dt.date(2022, 1, 1),)]
    got = one(spark, rows, "d date", closure_bucket("d", "2025-12-31"))
    assert got == [L.OPEN_STORE, L.CLOSED_UNDER_1Y, L.CLOSED_UNDER_1Y, L.CLOSED_UNDER_1Y,
                   L.CLOSED_OVER_1Y, L.CLOSED_OVER_2Y, L.CLOSED_OVER_3Y]


def test_last_closed_month_and_period_split(spark):  # E8
    assert one(spark, [(1,)], "x int", last_closed_month("2026-01-15")) == [dt.date(2025, 12, 1)]
    rows = [(dt.date(2025, 12, 1),), (dt.date(2024, 12, 1),), (None,)]
    assert one(spark, rows, "d date", period_split("d", "2026-01-10")) == ["new", "old", "old"]


def test_register_cells(spark):
    rows = [("-",), ("sd",), ("SD",), ("",), (None,), ("42",)]
    assert one(spark, rows, "s string", clean_sentinels("s")) == [0, 0, 0, 0, 0, 42]
    assert one(spark, [("-",), ("01/02/2020",), (None,)], "s string", store_state("s")) == \
        [L.ACTIVE, L.CLOSED, L.CLOSED]
    assert one(spark, [(None,), (0.0,), (3.0,)], "v double", rest_label("v")) == ["RESTO", "RESTO", "3"]
    assert one(spark, [(" Neuquén ",), ("Salta",)], "s string",
               unify("s", {"NEUQUÉN": "NEUQUEN"}, case="upper")) == ["NEUQUEN", "SALTA"]
    assert one(spark, [("03/15/2020",), ("-",)], "s string", parse_date("s")) == \
        [dt.date(2020, 3, 15), None]


def test_growth_policies(spark):  # E1 first line + NaN/inf rules
    rows = [(100.0, 110.5), (0.0, 5.0), (None, 7.0), (9.0, None), (0.0, 0.0), (16.0, 17.0),
            (0.0, -2.0)]
    df = spark.createDataFrame(rows, "b double, c double")
    inf = df.select(growth("b", "c")).collect()
    assert [r[0] for r in inf][:2] == [10.5, math.inf]
    assert [r[0] for r in inf][2:] == [None, None, None, 6.2, -math.inf]   # 6.25 -> 6.2 half-even
    zero = [r[0] for r in df.select(growth("b", "c", scale=1, digits=None, zero_base="zero")).collect()]
    assert zero[1] == 0.0 and zero[4] == 0.0 and zero[6] == 0.0
    assert [r[0] for r in df.select(growth("b", "c", zero_base="null")).collect()][1] is None


def test_in_millions(spark):
    assert one(spark, [(1234567,)], "v bigint", in_millions("v")) == [1.23]
