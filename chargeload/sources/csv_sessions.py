"""CSV session files → canonical sessions.

Column aliases are resolved once per distinct header (metadata only), by exact name and to a
position; the rows are then mapped by one ``select``, whatever number of headers there is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chargeload.functions.numbers import hms_minutes, hms_overflows, safe_double, text_or_null
from chargeload.functions.timestamps import duration_minutes, duration_overflows, multi_format_timestamp
from chargeload.operators.quality import OUT_OF_RANGE, SURPLUS_CELLS, notes

DATASET = "csv"

# Accepted header names per field, first present one wins.
ARRIVAL_COLUMNS = ("Start_Date___Time", "Start Date / Time", "start_time", "Start")
DEPARTURE_COLUMNS = ("End_Date___Time", "End Date / Time", "end_time", "End")
ENERGY_COLUMNS = ("Total_kWh", "Total kWh", "Energy (kWh)", "total_kwh")
CHARGING_TIME_COLUMNS = ("Charging_Time__hh_mm_ss_", "Charging Time (hh:mm:ss)", "charging_time")
STATION_COLUMNS = ("Station_Name", "Station Name", "station_name", "EVSE_ID")
PORT_COLUMNS = ("Port_Number", "Port Number", "port_number", "Port")

ALIASES = {
    "arrival": ARRIVAL_COLUMNS,
    "departure": DEPARTURE_COLUMNS,
    "energy": ENERGY_COLUMNS,
    "charging_time": CHARGING_TIME_COLUMNS,
    "station": STATION_COLUMNS,
    "port": PORT_COLUMNS,
}

#: Payload key under which a record with more cells than its header keeps its whole text.
RAW_RECORD = "_record"

_INTERNAL = ("_file", "_row", "_many")


def find_column(columns: list[str], candidates: tuple[str, ...]) -> str | None:
    """First candidate present in the header (a column-level choice, not per row)."""
    present = set(columns)
    return next((c for c in candidates if c in present), None)


def resolve_aliases(columns: list[str]) -> dict[str, str | None]:
    return {field: find_column(columns, cands) for field, cands in ALIASES.items()}


def _c(name: str | None):
    return F.col(f"`{name}`") if name else F.lit(None).cast("string")


def normalize_csv_sessions(records: DataFrame, dataset: str = "urbanev", id_scope: str = "auto") -> DataFrame:
    """Canonical session columns (before validation) from the records of ``read_csv_cells``, or from any frame of
    named text columns with ``_file`` and ``_row``.

    The id is the row's number in its file (``'dataset'``), or the digest of the file's path
    and the number (``'file'``), so that the rows of several files stay apart. ``'auto'``
    takes the number alone only where the input is one file by name. ``'dataset'`` on any
    other input fails instead of letting one file's rows shadow another's.

    A record with more cells than its header, or a value beyond its column's range, is kept with an
    error (``_notes``, which validation adds to the row's list): no cell stops an ingest."""
    if id_scope not in ("auto", "dataset", "file"):
        raise ValueError("id_scope must be 'auto', 'dataset' or 'file'")
    many = F.col("_many") if "_many" in records.columns else F.lit(True)
    by_position = "_cells" in records.columns
    if by_position:
        field = {f: F.try_element_at("_cells", F.col("_at")[f]) for f in ALIASES}
        extra = F.col("_extra").isNotNull()
        cells = F.map_from_arrays("_names", "_cells")       # a record with surplus cells keeps its text too
        payload = F.to_json(F.when(extra, F.map_concat(cells, F.create_map(F.lit(RAW_RECORD), F.col("_extra")))).otherwise(cells),
                            {"ignoreNullFields": "false"})
    else:
        source_cols = [c for c in records.columns if c not in _INTERNAL]
        field = {f: _c(name) for f, name in resolve_aliases(source_cols).items()}
        payload = F.to_json(F.struct(*[F.col(f"`{c}`") for c in source_cols]), {"ignoreNullFields": "false"})
        extra = F.lit(False)
    row = F.col("_row").cast("string")
    by_file = F.concat(F.md5("_file"), F.lit("-"), row)
    clash = F.raise_error(F.lit("ids by row number need an input of one file"))
    record_id = {"file": by_file, "auto": F.when(many, by_file).otherwise(row),
                 "dataset": F.when(many, clash).otherwise(row)}[id_scope]
    out = records.select(
        F.concat(F.lit(f"{dataset}-"), record_id).alias("session_id"),
        F.lit(dataset).alias("source_dataset"),
        record_id.alias("source_record_id"),
        text_or_null(field["station"]).alias("station_id"),
        text_or_null(field["port"]).alias("port_id"),
        F.lit(None).cast("string").alias("vehicle_id"),
        multi_format_timestamp(field["arrival"]).alias("arrival_ts"),
        multi_format_timestamp(field["departure"]).alias("departure_ts"),
        F.lit(None).cast("double").alias("energy_requested_kwh"),
        safe_double(field["energy"]).alias("energy_delivered_kwh"),
        F.lit(None).cast("double").alias("max_charge_rate_kw"),
        F.lit(None).cast("double").alias("average_charge_rate_kw"),
        hms_minutes(field["charging_time"]).alias("charging_duration_minutes"),
        payload.alias("raw_payload"),
        extra.alias("_surplus"), hms_overflows(field["charging_time"]).alias("_over"),
        "_file", "_row",
    )
    return out.select(
        "*", F.coalesce(duration_minutes("arrival_ts", "departure_ts"), F.lit(0)).alias("session_duration_minutes"),
        notes((F.col("_surplus"), "raw_payload", SURPLUS_CELLS),
              (duration_overflows("arrival_ts", "departure_ts"), "session_duration_minutes", OUT_OF_RANGE),
              (F.col("_over"), "charging_duration_minutes", OUT_OF_RANGE)).alias("_notes")).drop("_surplus", "_over")
