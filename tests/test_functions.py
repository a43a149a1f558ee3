"""Scalar column builders (C-family) on hand-made values."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from chargeload.functions import (
    duration_minutes,
    hms_minutes,
    iso_timestamp,
    multi_format_timestamp,
    round_half_up,
    safe_double,
    text_or_null,
)


def one(spark, col, value, typ="string"):
    df = spark.createDataFrame([(value,)], f"x {typ}")
    return df.select(col(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text,expected", [
    ("3:30:00", 210), ("0:00:00", 0), ("1:00:30", 61), ("2:15", 135), (" 4:05:00 ", 245),
    (None, None), ("", None), ("invalid", None), ("1:2:3:4", None), ("a:00:00", None),
])
def test_hms_minutes(spark, text, expected):
    assert one(spark, hms_minutes, text) == expected


@pytest.mark.parametrize("text,expected", [
    ("2020-08-01T08:00:00", dt.datetime(2020, 8, 1, 8, 0)),
    ("2020-08-01 08:00:00", dt.datetime(2020, 8, 1, 8, 0)),
    ("2020-08-01T12:00:00-05:00", dt.datetime(2020, 8, 1, 17, 0)),
    ("08/01/2020 08:00", dt.datetime(2020, 8, 1, 8, 0)),
    ("8/1/2020 8:05:09 PM", dt.datetime(2020, 8, 1, 20, 5, 9)),
    ("2020-8-1 8:00:00", dt.datetime(2020, 8, 1, 8, 0)),
    ("31/12/2020 10:00", dt.datetime(2020, 12, 31, 10, 0)),
    ("01/02/2020 10:00", dt.datetime(2020, 1, 2, 10, 0)),   # US reading wins
    ("", None), (None, None), ("not a date", None),
])
def test_multi_format_timestamp(spark, text, expected):
    assert one(spark, multi_format_timestamp, text) == expected


@pytest.mark.parametrize("text,zone,expected", [
    ("2020-08-01T08:30:00", "America/Los_Angeles", dt.datetime(2020, 8, 1, 15, 30)),
    ("2020-08-01T12:00:00-05:00", "America/Los_Angeles", dt.datetime(2020, 8, 1, 17, 0)),
    ("2020-08-01T12:00:00Z", "Nowhere/Atlantis", dt.datetime(2020, 8, 1, 12, 0)),
    ("2020-08-01T12:00:00", "UTC", dt.datetime(2020, 8, 1, 12, 0)),
    ("2020-08-01T12:00:00", "Nowhere/Atlantis", None),
    ("2020-03-08T02:30:00", "America/Los_Angeles", dt.datetime(2020, 3, 8, 10, 30)),   # gap
    ("2020-11-01T01:30:00", "America/Los_Angeles", dt.datetime(2020, 11, 1, 8, 30)),   # overlap
    ("08:30", "UTC", None), ("2020", "UTC", None), ("", "UTC", None), (None, "UTC", None),
])
def test_iso_timestamp_with_zone(spark, text, zone, expected):
    df = spark.createDataFrame([(text, zone)], "t string, z string")
    assert df.select(iso_timestamp("t", F.col("z")).alias("y")).first()["y"] == expected


def test_record_zone_defaults(spark):
    from chargeload.functions import record_zone

    df = spark.createDataFrame([(False, None), (True, None), (True, ""), (True, "Europe/Berlin")],
                               "present boolean, z string")
    got = [r["y"] for r in df.select(record_zone(F.col("present"), F.col("z")).alias("y")).collect()]
    assert got == ["America/Los_Angeles", "UTC", "UTC", "Europe/Berlin"]


@pytest.mark.parametrize("text,expected", [
    ("not_a_number", None), (" 1.5 ", 1.5), ("30.5", 30.5), ("1e3", 1000.0), ("", None), (None, None),
])
def test_safe_double(spark, text, expected):
    assert one(spark, safe_double, text) == expected


def test_text_or_null(spark):
    assert one(spark, text_or_null, "") is None
    assert one(spark, text_or_null, "ST-1") == "ST-1"


def test_duration_minutes(spark):
    rows = [(dt.datetime(2020, 1, 1, 8), dt.datetime(2020, 1, 1, 12)),
            (dt.datetime(2020, 1, 1, 8), dt.datetime(2020, 1, 1, 7)),
            (dt.datetime(2020, 1, 1, 8), dt.datetime(2020, 1, 1, 8, 1, 59)),
            (None, dt.datetime(2020, 1, 1, 8))]
    df = spark.createDataFrame(rows, "a timestamp, b timestamp")
    got = [r["d"] for r in df.select(duration_minutes("a", "b").alias("d")).collect()]
    assert got == [240, 0, 1, None]


def test_round_half_up_is_exact_on_decimal_value(spark):
    df = spark.createDataFrame([(2.675,), (13.124999999999998,), (0.03125,)], "x double")
    got = [r["y"] for r in df.select(round_half_up("x", 2).alias("y")).collect()]
    assert got == [2.68, 13.13, 0.03]
