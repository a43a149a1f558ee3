"""Table schemas of the canonical session store, the ledgers and the analysis outputs."""

from __future__ import annotations

from pyspark.sql import types as T

ERROR = T.StructType([
    T.StructField("field", T.StringType(), False),
    T.StructField("error", T.StringType(), False),
])

# Canonical charging session (one row per session_id in the store).
SESSION = T.StructType([
    T.StructField("session_id", T.StringType(), False),
    T.StructField("source_dataset", T.StringType(), False),
    T.StructField("source_record_id", T.StringType(), True),
    T.StructField("station_id", T.StringType(), True),
    T.StructField("port_id", T.StringType(), True),
    T.StructField("vehicle_id", T.StringType(), True),
    T.StructField("arrival_ts", T.TimestampType(), True),
    T.StructField("departure_ts", T.TimestampType(), True),
    T.StructField("energy_requested_kwh", T.DoubleType(), True),
    T.StructField("energy_delivered_kwh", T.DoubleType(), True),
    T.StructField("max_charge_rate_kw", T.DoubleType(), True),
    T.StructField("average_charge_rate_kw", T.DoubleType(), True),
    T.StructField("session_duration_minutes", T.IntegerType(), False),
    T.StructField("charging_duration_minutes", T.IntegerType(), True),
    T.StructField("is_valid", T.BooleanType(), False),
    T.StructField("validation_errors", T.ArrayType(ERROR, False), False),
    T.StructField("raw_payload", T.StringType(), True),
])

SESSION_COLUMNS = [f.name for f in SESSION.fields]

# As stored: plus insert time (``updated_at`` equals it — stored rows never change).
STORED_SESSION = T.StructType(SESSION.fields + [
    T.StructField("created_at", T.TimestampType(), True),
    T.StructField("updated_at", T.TimestampType(), True),
])

# Columns a loader must produce (the extension contract).
REQUIRED_COLUMNS = ("session_id", "source_dataset", "arrival_ts", "departure_ts",
                    "session_duration_minutes", "raw_payload")

# Columns the load analysis reads from the store.
ANALYSIS_COLUMNS = ["session_id", "station_id", "arrival_ts", "departure_ts", "energy_requested_kwh",
                    "energy_delivered_kwh", "max_charge_rate_kw", "session_duration_minutes", "is_valid"]

INGEST_RUN = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("source_dataset", T.StringType(), False),
    T.StructField("source_path", T.StringType(), False),
    T.StructField("started_at", T.TimestampType(), False),
    T.StructField("completed_at", T.TimestampType(), True),
    T.StructField("status", T.StringType(), False),
    T.StructField("records_seen", T.LongType(), False),
    T.StructField("records_inserted", T.LongType(), False),
    T.StructField("records_invalid", T.LongType(), False),
    T.StructField("notes", T.StringType(), True),
])

DECISION = T.StructType([
    T.StructField("session_id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("charge_rate_kw", T.DoubleType(), False),
    T.StructField("energy_delivered_kwh", T.DoubleType(), False),
])

GRID = T.StructType([
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("step_index", T.LongType(), False),
    T.StructField("interval_hours", T.DoubleType(), False),
])

FLEET_LOAD = T.StructType([
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("total_load_kw", T.DoubleType(), True),
    T.StructField("total_energy_kwh", T.DoubleType(), True),
    T.StructField("active_sessions", T.LongType(), False),
])

STATION_LOAD = T.StructType([
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("station_id", T.StringType(), True),
    T.StructField("load_kw", T.DoubleType(), True),
    T.StructField("energy_kwh", T.DoubleType(), True),
])

# Persisted load rows; ``level`` separates the fleet total from the NULL-station group.
LOAD = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("level", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("station_id", T.StringType(), True),
    T.StructField("load_kw", T.DoubleType(), True),
    T.StructField("energy_kwh", T.DoubleType(), True),
    T.StructField("active_sessions", T.LongType(), False),
])

RUN = T.StructType([
    T.StructField("run_id", T.StringType(), False),
    T.StructField("scenario_name", T.StringType(), False),
    T.StructField("policy_name", T.StringType(), False),
    T.StructField("source_dataset", T.StringType(), True),
    T.StructField("interval_minutes", T.IntegerType(), False),
    T.StructField("seed", T.LongType(), True),
    T.StructField("sessions_count", T.LongType(), False),
    T.StructField("peak_load_kw", T.DoubleType(), False),
    T.StructField("total_energy_kwh", T.DoubleType(), False),
    T.StructField("completion_rate", T.DoubleType(), False),
    T.StructField("average_load_kw", T.DoubleType(), False),
    T.StructField("load_factor", T.DoubleType(), False),
    T.StructField("sessions_completed", T.LongType(), False),
    T.StructField("targets_total", T.LongType(), False),
    T.StructField("notes", T.StringType(), True),
    T.StructField("created_at", T.TimestampType(), False),
])
