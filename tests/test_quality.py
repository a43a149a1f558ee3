"""Validation rules (D1–D7) on variants of one canonical session."""

import datetime as dt

from pyspark.sql import functions as F

from chargeload.operators.quality import errors_text, ingest_counts, validate
from chargeload.schemas import SESSION

BASE = dict(session_id="q-17", source_dataset="q", source_record_id="17", station_id="dock 4", port_id=None,
            vehicle_id="van", arrival_ts=dt.datetime(2023, 2, 28, 22, 40), departure_ts=dt.datetime(2023, 3, 1, 5, 25),
            energy_requested_kwh=52.0, energy_delivered_kwh=48.75, max_charge_rate_kw=11.0,
            average_charge_rate_kw=7.2, session_duration_minutes=405, charging_duration_minutes=390,
            is_valid=False, validation_errors=[], raw_payload="{}")


def run(spark, **changes):
    row = {**BASE, **changes}
    df = spark.createDataFrame([tuple(row[f.name] for f in SESSION.fields)], SESSION)
    r = validate(df).select("is_valid", errors_text().alias("e")).first()
    return r["is_valid"], r["e"]


def test_canonical_row_is_valid(spark):
    assert run(spark) == (True, "")


def test_each_rule(spark):
    assert run(spark, arrival_ts=None) == (False, "arrival_ts:missing required timestamp")
    assert run(spark, departure_ts=None) == (False, "departure_ts:missing required timestamp")
    assert run(spark, departure_ts=dt.datetime(2023, 2, 28, 22, 39)) == (False, "departure_ts:departure must be after arrival")
    assert run(spark, departure_ts=BASE["arrival_ts"])[1] == "departure_ts:departure must be after arrival"
    assert run(spark, session_duration_minutes=0) == (False, "session_duration_minutes:must be positive")
    assert run(spark, energy_delivered_kwh=-5.0) == (False, "energy_delivered_kwh:must be non-negative")
    assert run(spark, max_charge_rate_kw=-1.0) == (False, "max_charge_rate_kw:must be non-negative")
    assert run(spark, charging_duration_minutes=-3) == (False, "charging_duration_minutes:must be non-negative")


def test_null_optionals_are_fine(spark):
    assert run(spark, energy_requested_kwh=None, energy_delivered_kwh=None, max_charge_rate_kw=None,
               station_id=None, port_id=None)[0] is True


def test_several_faults_in_fixed_order(spark):
    ok, e = run(spark, arrival_ts=None, session_duration_minutes=0, energy_delivered_kwh=-1.0, max_charge_rate_kw=-2.0)
    assert not ok
    assert e.split("|") == ["arrival_ts:missing required timestamp", "session_duration_minutes:must be positive",
                            "energy_delivered_kwh:must be non-negative", "max_charge_rate_kw:must be non-negative"]


def test_nan_is_not_negative(spark):
    assert run(spark, energy_delivered_kwh=float("nan"))[0] is True


def test_ingest_counts(spark):
    rows = [tuple({**BASE, **c}[f.name] for f in SESSION.fields)
            for c in ({}, {"session_id": "b", "arrival_ts": None}, {"session_id": "c"})]
    df = validate(spark.createDataFrame(rows, SESSION))
    r = ingest_counts(df).first()
    assert (r["records_seen"], r["records_invalid"]) == (3, 1)
    assert df.where(~F.col("is_valid")).count() == 1
