"""JSON session records → canonical sessions.

One ``select`` of column expressions over the VARIANT record; no Python per row.
Keys are looked up per record, so a key missing from one record is just NULL there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chargeload.functions.numbers import safe_double
from chargeload.functions.timestamps import duration_minutes, duration_overflows, iso_timestamp, known_zone, record_zone
from chargeload.operators.quality import OUT_OF_RANGE, notes

DATASET = "acn"

# Source keys of a JSON session record.
KEY_ID = "_id"
KEY_ARRIVAL = "connectionTime"
KEY_DEPARTURE = "disconnectTime"
KEY_DONE = "doneChargingTime"
KEY_DELIVERED = "kWhDelivered"
KEY_REQUESTED = "kWhRequested"
KEY_MAX_RATE = "maxRate"
KEY_VEHICLE = "userID"
KEY_STATION = "stationID"
KEY_PORT = "spaceID"
KEY_ZONE = "timezone"


def _path(key: str) -> str:
    return "$." + key if key.isidentifier() else f"$['{key}']"


def vraw(record: Column, key: str) -> Column:
    """The value at ``key`` as VARIANT; SQL NULL when the key is absent."""
    return F.try_variant_get(record, _path(key), "variant")


def vtext(record: Column, key: str) -> Column:
    """The value at ``key`` as text (numbers in their JSON spelling); NULL if absent/null."""
    return F.try_variant_get(record, _path(key), "string")


def record_id_text(record: Column) -> Column:
    """Text of ``_id``: absent → '', JSON null → 'None', else its text."""
    raw = vraw(record, KEY_ID)
    return (F.when(raw.isNull(), F.lit(""))
            .when(F.is_variant_null(raw), F.lit("None"))
            .otherwise(vtext(record, KEY_ID)))


def normalize_json_sessions(records: DataFrame, dataset: str = DATASET) -> DataFrame:
    """Canonical session columns (before validation) from ``read_json_records`` output."""
    r = F.col("record")
    # The record's zone, checked once against the known zone ids, then shared by the
    # three timestamps (keeps the plan small: the id list appears once).
    zone = record_zone(vraw(r, KEY_ZONE).isNotNull(), vtext(r, KEY_ZONE))
    records = records.withColumn("_zone", known_zone(zone))
    zone_ok = F.col("_zone")
    arrival = iso_timestamp(vtext(r, KEY_ARRIVAL), zone_ok, checked=True)
    departure = iso_timestamp(vtext(r, KEY_DEPARTURE), zone_ok, checked=True)
    done = iso_timestamp(vtext(r, KEY_DONE), zone_ok, checked=True)
    rid = record_id_text(r)
    out = records.select(
        F.concat(F.lit(f"{dataset}-"), rid).alias("session_id"),
        F.lit(dataset).alias("source_dataset"),
        rid.alias("source_record_id"),
        vtext(r, KEY_STATION).alias("station_id"),
        vtext(r, KEY_PORT).alias("port_id"),
        vtext(r, KEY_VEHICLE).alias("vehicle_id"),
        arrival.alias("arrival_ts"),
        departure.alias("departure_ts"),
        safe_double(vtext(r, KEY_REQUESTED)).alias("energy_requested_kwh"),
        safe_double(vtext(r, KEY_DELIVERED)).alias("energy_delivered_kwh"),
        safe_double(vtext(r, KEY_MAX_RATE)).alias("max_charge_rate_kw"),
        F.lit(None).cast("double").alias("average_charge_rate_kw"),
        done.alias("_done"),
        F.to_json(r).alias("raw_payload"),
        "_file", *[c for c in ("_block",) if c in records.columns], "_row",
    )
    return (out
            .withColumn("session_duration_minutes",
                        F.coalesce(duration_minutes("arrival_ts", "departure_ts"), F.lit(0)))
            .withColumn("charging_duration_minutes", duration_minutes("arrival_ts", "_done"))
            .withColumn("_notes", notes((duration_overflows("arrival_ts", "departure_ts"), "session_duration_minutes", OUT_OF_RANGE),
                                        (duration_overflows("arrival_ts", "_done"), "charging_duration_minutes", OUT_OF_RANGE)))
            .drop("_done"))
