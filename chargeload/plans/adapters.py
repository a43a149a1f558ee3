"""Sessions derived from the driver's ``events`` table (there is no charging table).

Each event becomes one session. The mapping gives the mix real feeds have: sessions
without a station, without an arrival, of zero length, with negative energy, without a
target or a max rate. All of it is projection over the scan, so it scales with
``events`` and keeps Parquet column pruning.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeload.functions.timestamps import duration_minutes
from chargeload.operators.quality import validate


def ensure_utc(spark: SparkSession) -> None:
    """The library's timestamp semantics (and result rendering) assume a UTC session."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ensure_utc(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def events_raw_sessions(events: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Session-shaped rows from events (before duration and validation); ``keep`` passes
    event columns through unchanged."""
    eid = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    minutes = F.when(eid % 50 == 0, F.lit(0)).otherwise(20 + eid % 220)
    return events.select(
        *keep,
        F.concat(F.lit("events-"), eid.cast("string")).alias("session_id"),
        F.lit("events").alias("source_dataset"),
        eid.cast("string").alias("source_record_id"),
        F.when(eid % 19 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("ST-"), (F.col("user_id") % 20).cast("string"))).alias("station_id"),
        F.lit(None).cast("string").alias("port_id"),
        F.col("user_id").cast("string").alias("vehicle_id"),
        F.when(eid % 97 == 0, F.lit(None).cast("timestamp")).otherwise(ts).alias("arrival_ts"),
        F.timestamp_micros(F.unix_micros(ts) + minutes.cast("long") * 60_000_000).alias("departure_ts"),
        F.when(eid % 3 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("value") * F.lit(1.25)).alias("energy_requested_kwh"),
        F.when(eid % 101 == 0, -F.col("value")).when(eid % 7 == 0, F.lit(None).cast("double"))
         .otherwise(F.col("value")).alias("energy_delivered_kwh"),
        F.when(eid % 4 == 0, F.lit(None).cast("double")).when(eid % 4 == 1, F.lit(6.6))
         .when(eid % 4 == 2, F.lit(11.0)).otherwise(F.lit(50.0)).alias("max_charge_rate_kw"),
        F.lit(None).cast("double").alias("average_charge_rate_kw"),
        F.lit(None).cast("int").alias("charging_duration_minutes"),
        F.to_json(F.struct(*[F.col(c) for c in events.columns])).alias("raw_payload"),
    )


def canonical(raw: DataFrame) -> DataFrame:
    """Add duration (NULL → 0), then validate: the SESSION columns, in order."""
    from chargeload.schemas import SESSION_COLUMNS

    with_dur = raw.withColumn(
        "session_duration_minutes",
        F.coalesce(duration_minutes("arrival_ts", "departure_ts"), F.lit(0)))
    return validate(with_dur).select(*SESSION_COLUMNS)


def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical, validated sessions from ``<sf_dir>/events.parquet``."""
    return canonical(events_raw_sessions(read_table(spark, sf_dir, "events")))
