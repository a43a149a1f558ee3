"""Registered queries for scalar parsers, raw-file sources, the session store, ingest
jobs, analysis runs and the streaming ingest. Imported by ``chargeload.plans.queries``.

Source queries first derive raw files from the whole ``events`` table (see
``fixtures``), then read them back through the real readers. Files and read-only stores are
written once per session and table folder; queries that insert build a store of their own.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from chargeload.config import scratch_path
from chargeload.functions.numbers import hms_minutes, round6, safe_double
from chargeload.functions.timestamps import iso_timestamp, multi_format_timestamp
from chargeload.operators.comparison import load_profiles
from chargeload.operators.quality import errors_text
from chargeload.plans import fixtures
from chargeload.plans import oracle as O
from chargeload.plans.adapters import events_sessions, read_table
from chargeload.plans.jobs import analyze, analyze_policies, ingest
from chargeload.plans.queries import query
from chargeload.schemas import RUN
from chargeload.sinks import store
from chargeload.sources.csv_sessions import normalize_csv_sessions
from chargeload.sources.readers import read_csv_records, read_json_records
from chargeload.sources.registry import SessionSource, get_loader, list_loaders, register_loader, unregister_loader
from chargeload.streaming.ingest_stream import ingest_stream

LOCAL_FMT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
ZONES = ("America/Los_Angeles", "America/New_York", "Asia/Kolkata", "Europe/Berlin", "UTC", O.UNKNOWN_ZONE)
SPLIT_AT = "2024-01-16 00:00:00"
LOOKUP_ID = "events-1234"


# --- C: scalar parsers over texts derived from events ----------------------------------

def _zone_case(eid):
    k = eid % 7
    z = F.when(k == 0, F.lit(ZONES[0]))
    for i, name in enumerate(ZONES[1:], 1):
        z = z.when(k == i, F.lit(name))
    return z.otherwise(F.lit(O.UNKNOWN_ZONE)), k


@query("parse_local_timestamp", O.with_sessions(f"""
, z AS (SELECT event_id, t, event_id % 7 AS k,
     CASE event_id % 7 {' '.join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(ZONES))} ELSE '{O.UNKNOWN_ZONE}' END
       AS zone FROM raw),
zt AS (SELECT *, CASE WHEN k IN (5, 6) THEN 'UTC' ELSE zone END AS zsafe FROM z),
tx AS (SELECT *, CASE WHEN k = 6
          THEN strftime(timezone('{fixtures.OFFSET_ZONE}', timezone('UTC', t)), '%Y-%m-%dT%H:%M:%S.%f') || '+05:30'
          ELSE strftime(timezone(zsafe, timezone('UTC', t)), '%Y-%m-%dT%H:%M:%S.%f') END AS local_text FROM zt)
SELECT event_id, zone, local_text,
  CASE WHEN k = 6 THEN timezone('UTC', CAST(local_text AS TIMESTAMPTZ)) WHEN k = 5 THEN NULL
       ELSE timezone('UTC', timezone(zsafe, CAST(local_text AS TIMESTAMP))) END AS parsed_ts
FROM tx"""))
def q_parse_local_timestamp(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    zone, k = _zone_case(eid)
    t = F.col("ts").cast("timestamp")
    text_zone = F.when(k >= 5, F.lit("UTC")).otherwise(zone)
    local = F.when(k == 6, F.concat(F.date_format(F.from_utc_timestamp(t, fixtures.OFFSET_ZONE), LOCAL_FMT),
                                    F.lit("+05:30"))) \
             .otherwise(F.date_format(F.from_utc_timestamp(t, text_zone), LOCAL_FMT))
    df = ev.select(eid, zone.alias("zone"), local.alias("local_text"))
    return df.withColumn("parsed_ts", iso_timestamp("local_text", F.col("zone")))


@query("parse_multi_format_datetime", O.with_sessions(f"""
, tx AS (SELECT event_id, {O.layout_text('t')} AS text FROM raw)
SELECT event_id, text, {O.parse_multi('text')} AS parsed_ts FROM tx"""))
def q_parse_multi_format_datetime(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    text = fixtures.csv_datetime_text(F.col("ts").cast("timestamp"), F.col("event_id"))
    return ev.select("event_id", text.alias("text")).withColumn("parsed_ts", multi_format_timestamp("text"))


@query("parse_hms_minutes", O.with_sessions(f"""
, tx AS (SELECT event_id, {O.charging_text()} AS text FROM raw),
sp AS (SELECT event_id, text, {O.hms_parts('text')} FROM tx)
SELECT event_id, text, CAST({O.HMS_MINUTES} AS DOUBLE) AS minutes FROM sp"""))
def q_parse_hms_minutes(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    minutes = F.when(eid % 50 == 0, F.lit(0)).otherwise(20 + eid % 220)
    df = ev.select("event_id", fixtures.charging_time_text(minutes, eid).alias("text"))
    # nullable integers are reported as doubles so both engines hand over the same type
    return df.withColumn("minutes", hms_minutes("text").cast("double"))


def _number_text_sql() -> str:
    base = "CAST(event_id % 1000 AS VARCHAR) || '.' || lpad(CAST(event_id % 100 AS VARCHAR), 2, '0')"
    return (f"CASE event_id % 5 WHEN 0 THEN {base} WHEN 1 THEN ' ' || {base} || ' ' WHEN 2 THEN 'not_a_number' "
            f"WHEN 3 THEN '' ELSE CAST(event_id % 7 AS VARCHAR) || 'e2' END")


@query("safe_double", f"""
SELECT event_id, {_number_text_sql()} AS text, TRY_CAST(trim({_number_text_sql()}) AS DOUBLE) AS number
FROM events""")
def q_safe_double(spark, sf_dir):
    ev = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    base = F.concat((eid % 1000).cast("string"), F.lit("."), F.lpad((eid % 100).cast("string"), 2, "0"))
    k = eid % 5
    text = (F.when(k == 0, base).when(k == 1, F.concat(F.lit(" "), base, F.lit(" ")))
            .when(k == 2, F.lit("not_a_number")).when(k == 3, F.lit(""))
            .otherwise(F.concat((eid % 7).cast("string"), F.lit("e2"))))
    return ev.select("event_id", text.alias("text")).withColumn("number", safe_double("text"))


# --- A1 / B1: JSON session files ------------------------------------------------------------

READ_JSON_SQL = O.with_files("""
SELECT CASE WHEN event_id % 401 = 0 THEN '' ELSE CAST(event_id AS VARCHAR) END AS record_id,
  CASE WHEN event_id % 6 = 0 THEN 'absent' WHEN event_id % 6 = 4 THEN 'null'
       WHEN event_id % 6 = 1 THEN 'America/Los_Angeles' WHEN event_id % 6 = 2 THEN 'America/New_York'
       WHEN event_id % 6 = 3 THEN '' ELSE 'Nowhere/Atlantis' END AS zone_state,
  station_id, CASE WHEN event_id % 5 <> 0 THEN concat('P', CAST(event_id % 4 AS VARCHAR)) END AS port_id,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE energy_delivered_kwh END AS kwh_delivered
FROM raw""")


def _json_fields(recs):
    from chargeload.sources.json_sessions import record_id_text, vraw, vtext
    from chargeload.functions.numbers import safe_double as sd

    r = F.col("record")
    z = vraw(r, "timezone")
    state = F.when(z.isNull(), "absent").when(F.is_variant_null(z), "null").otherwise(vtext(r, "timezone"))
    return recs.select(record_id_text(r).alias("record_id"), state.alias("zone_state"),
                       vtext(r, "stationID").alias("station_id"), vtext(r, "spaceID").alias("port_id"),
                       sd(vtext(r, "kWhDelivered")).alias("kwh_delivered"))


@query("read_json_sessions", READ_JSON_SQL)
def q_read_json_sessions(spark, sf_dir):
    return _json_fields(read_json_records(spark, fixtures.write_json_sessions(spark, sf_dir)))


@query("read_json_mixed_layouts", READ_JSON_SQL)
def q_read_json_mixed_layouts(spark, sf_dir):
    return _json_fields(read_json_records(spark, fixtures.write_mixed_json_sessions(spark, sf_dir)))


JSON_COLS = ("session_id, source_dataset, source_record_id, station_id, port_id, vehicle_id, arrival_ts, departure_ts, "
             "energy_requested_kwh, energy_delivered_kwh, max_charge_rate_kw, session_duration_minutes, "
             "charging_minutes, is_valid, errors, payload_site, payload_requested")
JSON_CONST = "'acn' AS source_dataset"
JSON_PAYLOAD = ("jp AS (SELECT *, 'site-1' AS payload_site, energy_requested_kwh AS payload_requested FROM jv)")
# charging_duration_minutes is a nullable integer: reported as a double on both sides so
# both engines hand over the same type.
CHARGING_SQL = "CAST(charging_duration_minutes AS DOUBLE) AS charging_minutes"


def _charging(df, **payload):
    """Comparable forms of the columns whose types differ: nullable integer, error list, payload fields."""
    df = df.withColumn("charging_minutes", F.col("charging_duration_minutes").cast("double"))
    df = df.withColumn("errors", errors_text()) if "validation_errors" in df.columns else df
    return df.withColumns({f"payload_{k}": F.get_json_object("raw_payload", path) for k, path in payload.items()})


def _cols(names: str) -> list[str]:
    return [c.strip() for c in names.split(",")]


@query("normalize_json_sessions", O.with_files(
    f"SELECT {JSON_COLS.replace('charging_minutes', CHARGING_SQL).replace('source_dataset', JSON_CONST)} FROM jp", O.JSON_CTE, JSON_PAYLOAD))
def q_normalize_json_sessions(spark, sf_dir):
    df = _charging(get_loader("acn").load(spark, fixtures.write_json_sessions(spark, sf_dir)), site="$.siteID",
                   requested="$.kWhRequested")
    return df.select(*_cols(JSON_COLS)).withColumn("payload_requested", F.col("payload_requested").cast("double"))


# --- A2 / B2 / B3 / C9: CSV session files ---------------------------------------------------

@query("read_csv_sessions", O.with_files(
    "SELECT bucket, station_id AS Station_Name, start_text AS Start_Date___Time, "
    "ch_text AS Charging_Time__hh_mm_ss_, port AS Port_Number FROM ct", O.CSV_CTE))
def q_read_csv_sessions(spark, sf_dir):
    recs = read_csv_records(spark, fixtures.write_csv_sessions(spark, sf_dir))
    return recs.select("bucket", "Station_Name", "Start_Date___Time", "Charging_Time__hh_mm_ss_", "Port_Number")


@query("row_ordinal", O.with_files("SELECT bucket, event_id, row_ord AS _row FROM ct", O.CSV_CTE))
def q_row_ordinal(spark, sf_dir):
    recs = read_csv_records(spark, fixtures.write_csv_sessions(spark, sf_dir))
    return recs.select("bucket", F.col("Session_Ref").cast("long").alias("event_id"), "_row")


CSV_COLS = ("bucket, session_id, source_dataset, source_record_id, vehicle_id, station_id, port_id, arrival_ts, departure_ts, energy_delivered_kwh, "
            "charging_minutes, session_duration_minutes, is_valid, errors, payload_ref, payload_start")


def _csv_sql(station: str = "station_id", source: str = "cv") -> str:
    """Ids carry the digest of their file's path, which SQL can't know: 'b<bucket>' stands for it."""
    cols = (CSV_COLS.replace("charging_minutes", CHARGING_SQL)
            .replace("session_id,", "concat('urbanev-b', CAST(bucket AS VARCHAR), '-', source_record_id) AS session_id,", 1)
            .replace("source_dataset", "'urbanev' AS source_dataset")
            .replace(" source_record_id, vehicle", " concat('b', CAST(bucket AS VARCHAR), '-', source_record_id) AS source_record_id, vehicle")
            .replace("vehicle_id", "CAST(NULL AS VARCHAR) AS vehicle_id").replace(" station_id,", f" {station} AS station_id,")
            .replace("payload_ref", "CAST(event_id AS VARCHAR) AS payload_ref").replace("payload_start", "start_text AS payload_start"))
    return f"SELECT {cols} FROM {source}"


def _csv_ids(df):
    """'b<bucket>' in the place of a right path digest."""
    df = df.withColumn("bucket", F.regexp_extract("_file", r"bucket=(\d+)", 1).cast("int"))
    name = F.concat(F.lit("b"), F.col("bucket").cast("string"), F.lit("-"))
    return df.withColumns({c: F.replace(F.col(c), F.concat(F.md5("_file"), F.lit("-")), name)
                           for c in ("session_id", "source_record_id")})


def _csv_rows(spark, path):
    df = _charging(get_loader("urbanev").load(spark, path), ref="$.Session_Ref")
    start = F.coalesce(*[F.get_json_object("raw_payload", f"$['{c}']") for c in ("Start_Date___Time", "Start Date / Time")])
    return _csv_ids(df.withColumn("payload_start", start)).select(*_cols(CSV_COLS))


@query("normalize_csv_sessions", O.with_files(_csv_sql(), O.CSV_CTE))
def q_normalize_csv_sessions(spark, sf_dir):
    return _csv_rows(spark, fixtures.write_csv_sessions(spark, sf_dir))


@query("read_csv_mixed_headers", O.with_files(_csv_sql("CASE WHEN bucket > 5 THEN evse ELSE station_id END"), O.CSV_CTE))
def q_read_csv_mixed_headers(spark, sf_dir):
    return _csv_rows(spark, fixtures.write_mixed_csv_sessions(spark, sf_dir))


@query("read_csv_quoted", O.with_files("""
SELECT CAST(event_id % 8 AS INTEGER) AS bucket, event_id, row_number() OVER (PARTITION BY event_id % 8 ORDER BY event_id) - 1 AS _row, station_id AS Station_Name,
  CASE event_id % 4 WHEN 0 THEN '1 Main St' WHEN 1 THEN concat('Gate "A"', chr(10), 'level 2') WHEN 2 THEN 'Quay 3, left'
    ELSE concat('one', chr(10), chr(10), '"two"') END AS Address
FROM checked"""))
def q_read_csv_quoted(spark, sf_dir):
    recs = read_csv_records(spark, fixtures.write_quoted_csv_sessions(spark, sf_dir))
    return recs.select("bucket", F.col("Session_Ref").cast("long").alias("event_id"), "_row", "Station_Name", "Address")


@query("ingest_odd_values", O.with_files("""
SELECT session_id, station_id, arrival_ts, strftime(departure_ts, '%Y-%m-%d %H:%M:%S') AS departure, energy_delivered_kwh, session_duration_minutes,
  CAST(charging_duration_minutes AS DOUBLE) AS charging_minutes, errors = '' AS is_valid, errors,
  (SELECT count(*) FROM ov) AS records_seen, (SELECT count(*) FILTER (WHERE errors <> '') FROM ov) AS records_invalid,
  (SELECT concat(CAST(count(*) FILTER (WHERE surplus) AS VARCHAR), ' records with more cells than their header, kept as invalid') FROM ov) AS notes
FROM ov""", O.ODD_CTE))
def q_ingest_odd_values(spark, sf_dir):
    root = scratch_path(spark, "store")
    path = fixtures.write_odd_csv_sessions(spark, sf_dir)
    row = ingest(spark, "urbanev", path, root)
    stored = _charging(store.read_sessions(spark, root, "urbanev"))
    digests = read_csv_records(spark, path).select("_file").distinct()
    digests = digests.select(F.md5("_file").alias("digest"), F.regexp_extract("_file", r"bucket=(\d+)", 1).alias("b"))
    stored = stored.withColumn("digest", F.regexp_extract("session_id", "^urbanev-([0-9a-f]{32})-", 1)).join(digests, "digest")
    return stored.select(
        F.concat(F.lit("urbanev-b"), "b", F.regexp_extract("session_id", "(-[0-9]+)$", 1)).alias("session_id"), "station_id", "arrival_ts",
        F.date_format("departure_ts", "yyyy-MM-dd HH:mm:ss").alias("departure"), "energy_delivered_kwh", "session_duration_minutes", "charging_minutes",
        "is_valid", "errors", F.lit(row["records_seen"]).cast("long").alias("records_seen"),
        F.lit(row["records_invalid"]).cast("long").alias("records_invalid"), F.lit(row["notes"]).alias("notes"))


@query("ingest_csv", O.with_files("""
SELECT concat('urbanev-b', CAST(bucket AS VARCHAR), '-', source_record_id) AS session_id, is_valid, energy_delivered_kwh,
       (SELECT count(*) FROM cv) AS records_seen, (SELECT count(*) FROM cv) AS records_inserted
FROM cv""", O.CSV_CTE))
def q_ingest_csv(spark, sf_dir):
    root = scratch_path(spark, "store")
    path = fixtures.write_csv_sessions(spark, sf_dir)
    row = ingest(spark, "urbanev", path, root)
    files = read_csv_records(spark, path).select("_file").distinct()
    digests = files.select(F.md5("_file").alias("digest"), F.regexp_extract("_file", r"bucket=(\d+)", 1).alias("b"))
    stored = store.read_sessions(spark, root, "urbanev", ["session_id", "is_valid", "energy_delivered_kwh"])
    stored = stored.withColumn("digest", F.regexp_extract("session_id", "^urbanev-([0-9a-f]{32})-", 1))
    return stored.join(digests, "digest").select(
        F.concat(F.lit("urbanev-b"), "b", F.regexp_extract("session_id", "(-[0-9]+)$", 1)).alias("session_id"), "is_valid",
        "energy_delivered_kwh", F.lit(row["records_seen"]).cast("long").alias("records_seen"),
        F.lit(row["records_inserted"]).cast("long").alias("records_inserted"))


@query("resolve_aliases", O.with_files(
    f"SELECT bucket, evse AS station_id, port_id, arrival_ts, energy_delivered_kwh, {CHARGING_SQL} "
    "FROM cv", O.CSV_CTE))
def q_resolve_aliases(spark, sf_dir):
    recs = read_csv_records(spark, fixtures.write_csv_sessions(spark, sf_dir, alias_headers=True))
    df = _charging(normalize_csv_sessions(recs, "urbanev"))
    df = df.withColumn("bucket", F.regexp_extract("_file", r"bucket=(\d+)", 1).cast("int"))
    return df.select("bucket", "station_id", "port_id", "arrival_ts", "energy_delivered_kwh", "charging_minutes")


@query("registered_source", O.with_sessions(
    "SELECT concat('fleet-', CAST(event_id AS VARCHAR)) AS session_id, 'fleet' AS source_dataset, station_id, arrival_ts, is_valid, errors FROM checked"))
def q_registered_source(spark, sf_dir):
    """A source of one's own (the events table), looked up by name and held to the contract."""
    def normalize(df):
        return df.withColumns({"session_id": F.replace("session_id", F.lit("events-"), F.lit("fleet-")), "source_dataset": F.lit("fleet")}) \
                 .drop("is_valid", "validation_errors")

    before = set(list_loaders())
    register_loader(SessionSource("fleet", lambda s, path: events_sessions(s, path), normalize, prefixed=True))
    try:
        if set(list_loaders()) != before | {"fleet"}:
            raise AssertionError("the source is not listed")
        df = get_loader("fleet").load(spark, sf_dir)
    finally:
        unregister_loader("fleet")
    return df.select("session_id", "source_dataset", "station_id", "arrival_ts", "is_valid", errors_text().alias("errors"))


@query("insert_times", O.with_sessions("SELECT session_id, TRUE AS within_the_run, TRUE AS never_updated FROM checked"))
def q_insert_times(spark, sf_dir):
    """The insert time of every stored row lies within the run that stored it."""
    root, began = scratch_path(spark, "store"), dt.datetime.now(dt.timezone.utc)
    s = events_sessions(spark, sf_dir).withColumn("_row", F.col("source_record_id").cast("long"))
    store.insert_new_sessions(spark, s, root, order_cols=["_row"])
    ended = dt.datetime.now(dt.timezone.utc)
    out = store.read_sessions(spark, root, "events", ["session_id", "created_at", "updated_at"])
    return out.select("session_id", F.coalesce(F.col("created_at").between(F.lit(began), F.lit(ended)), F.lit(False)).alias("within_the_run"),
                      (F.col("created_at") == F.col("updated_at")).alias("never_updated"))


# --- A7 / A8 / B9 / E11 / H2: session store ----------------------------------------------

def _events_store(spark, sf_dir, with_json: bool = False) -> str:
    """A store of the events sessions (and the JSON ones), built once: the queries on it only read sessions."""
    def write(root: str) -> None:
        sessions = events_sessions(spark, sf_dir)
        store.insert_new_sessions(spark, sessions.withColumn("_row", F.col("source_record_id").cast("long")), root,
                                  order_cols=["_row"])
        if with_json:
            ingest(spark, "acn", fixtures.write_json_sessions(spark, sf_dir), root)

    return fixtures.once(spark, sf_dir, f"store-{with_json}".lower(), write)


@query("insert_across_datasets", O.with_sessions("""
SELECT source, count(*) AS sessions, (SELECT count(*) FROM checked) AS first_inserted, 0 AS second_inserted
FROM (SELECT 'one' AS source FROM checked) GROUP BY source"""))
def q_insert_across_datasets(spark, sf_dir):
    # Two sources whose ids carry no dataset: the second one's equal ids are known already.
    root = scratch_path(spark, "store")
    s = events_sessions(spark, sf_dir).withColumn("_row", F.col("source_record_id").cast("long"))
    n = [store.insert_new_sessions(spark, s.withColumn("source_dataset", F.lit(name)), root, order_cols=["_row"])
         for name in ("one", "two")]
    out = store.read_sessions(spark, root, columns=["source_dataset"]).groupBy(F.col("source_dataset").alias("source"))
    return out.agg(F.count(F.lit(1)).alias("sessions")).withColumns(
        {"first_inserted": F.lit(n[0]).cast("long"), "second_inserted": F.lit(n[1])})


@query("insert_new_sessions", O.with_sessions(f"""
SELECT session_id, station_id, is_valid,
  (SELECT count(*) FROM checked WHERE NOT coalesce(arrival_ts < TIMESTAMP '{SPLIT_AT}', false)) AS inserted_second
FROM checked"""))
def q_insert_new_sessions(spark, sf_dir):
    root = scratch_path(spark, "store")
    s = events_sessions(spark, sf_dir).withColumn("_row", F.col("source_record_id").cast("long"))
    early = F.coalesce(F.col("arrival_ts") < F.lit(SPLIT_AT).cast("timestamp"), F.lit(False))
    store.insert_new_sessions(spark, s.where(early), root, order_cols=["_row"])
    # Second batch: every session again, plus a later copy of each with another station.
    # First writer wins, stored ids are skipped: only the not-yet-stored originals go in.
    dups = s.withColumn("station_id", F.lit("DUP")).withColumn("_row", F.col("_row") + F.lit(10**12))
    n = store.insert_new_sessions(spark, s.unionByName(dups), root, order_cols=["_row"])
    out = store.read_sessions(spark, root, "events", ["session_id", "station_id", "is_valid"])
    return out.withColumn("inserted_second", F.lit(n).cast("long"))


@query("sessions_by_dataset", O.with_sessions(
    "SELECT session_id, station_id, arrival_ts, departure_ts, energy_requested_kwh, energy_delivered_kwh, "
    "max_charge_rate_kw, session_duration_minutes, is_valid FROM checked"))
def q_sessions_by_dataset(spark, sf_dir):
    root = _events_store(spark, sf_dir, with_json=True)
    return store.sessions_by_dataset(spark, root, "events")


@query("session_lookup", O.with_sessions(
    f"SELECT session_id, station_id, arrival_ts, departure_ts, is_valid FROM checked WHERE session_id = '{LOOKUP_ID}'"))
def q_session_lookup(spark, sf_dir):
    root = _events_store(spark, sf_dir)
    return store.session_lookup(spark, root, LOOKUP_ID).select(
        "session_id", "station_id", "arrival_ts", "departure_ts", "is_valid")


@query("count_by_source", O.with_files("""
SELECT 'events' AS source_dataset, count(*) AS sessions FROM checked
UNION ALL SELECT 'acn', count(DISTINCT session_id) FROM jv""", O.JSON_CTE))
def q_count_by_source(spark, sf_dir):
    return store.count_by_source(spark, _events_store(spark, sf_dir, with_json=True))


@query("page_by_source", O.with_sessions(
    "SELECT session_id, arrival_ts FROM checked ORDER BY arrival_ts ASC NULLS LAST, session_id LIMIT 100 OFFSET 200"))
def q_page_by_source(spark, sf_dir):
    root = _events_store(spark, sf_dir)
    return store.page_by_source(spark, root, "events", limit=100, offset=200).select("session_id", "arrival_ts")


@query("page_after_key", O.with_sessions(
    "SELECT session_id, arrival_ts FROM checked ORDER BY arrival_ts ASC NULLS LAST, session_id LIMIT 100 OFFSET 200"))
def q_page_after_key(spark, sf_dir):
    # Two pages by key give the third hundred, as two offsets of a hundred do.
    root, after = _events_store(spark, sf_dir), None
    for _ in range(2):
        last = store.page_after(spark, root, "events", 100, after).select("arrival_ts", "session_id").tail(1)
        after = tuple(last[0]) if last else after
    return store.page_after(spark, root, "events", 100, after).select("session_id", "arrival_ts")


# --- D7 / D8: ingest job ---------------------------------------------------------------------

@query("ingest_counters", O.with_files("""
, c AS (SELECT count(*) AS seen, count(DISTINCT session_id) AS uniq, count(*) FILTER (WHERE NOT is_valid) AS bad
        FROM jv)
SELECT 1 AS run_no, seen AS records_seen, uniq AS records_inserted, bad AS records_invalid, 'completed' AS status
FROM c
UNION ALL
SELECT 2, seen, 0, bad, 'completed' FROM c""", O.JSON_CTE))
def q_ingest_counters(spark, sf_dir):
    root = scratch_path(spark, "store")
    path = fixtures.write_json_sessions(spark, sf_dir)
    rows = [ingest(spark, "acn", path, root) for _ in range(2)]
    ledger = store.read_ingest_runs(spark, root).select("run_id", "records_seen", "records_inserted",
                                                        "records_invalid", "status")
    ids = spark.createDataFrame([(i + 1, r["run_id"]) for i, r in enumerate(rows)], "run_no int, run_id string")
    return ids.join(ledger, "run_id").select("run_no", "records_seen", "records_inserted", "records_invalid",
                                             "status")


# --- A10–A12 / B10 / B11: analysis runs ---------------------------------------------------

# --- G4 / G6 / E3 / E9: rates and targets outside the usual range ---------------------------

def _extreme_sql(policy: str) -> str:
    return O.with_extremes(policy, 5, f"""
, got AS (SELECT session_id, sum(energy) AS kwh FROM loop GROUP BY session_id)
SELECT '{policy}' AS policy_name, session_id, is_valid,
  CASE WHEN kwh > 1e20 THEN round(kwh / CAST('1e20' AS DOUBLE)) * CAST('1e20' AS DOUBLE) ELSE {O.r2('coalesce(kwh, 0)', 6)} END AS energy_kwh
FROM extreme LEFT JOIN got USING (session_id)""")


EXTREME_POLICIES = ("immediate_charge", "uniform_spread", "randomized_delay")


@query("policy_extreme_values", " UNION ALL ".join(f"SELECT * FROM ({_extreme_sql(p)})" for p in EXTREME_POLICIES))
def q_policy_extreme_values(spark, sf_dir):
    s = events_sessions(spark, sf_dir)
    eid = F.col("source_record_id").cast("long")
    rate = F.when(eid % 8 == 1, float("inf")).when(eid % 8 == 2, float("nan")).when(eid % 8 == 3, 0.0).otherwise(6.0)
    huge = (eid % 64 == 5) | (eid % 640 == 9)
    s = s.withColumn("max_charge_rate_kw", rate).withColumn(
        "energy_requested_kwh", F.when(huge, F.lit(1e25)).otherwise(F.col("energy_requested_kwh")))
    got = F.col("delivered_kwh")
    return load_profiles(s, list(EXTREME_POLICIES), 5).session_totals().select(
        "policy_name", "session_id", "is_valid", F.when(got > 1e20, F.round(got / 1e20) * 1e20).otherwise(round6(got)).alias("energy_kwh"))


@query("run_results", O.with_loop("immediate_charge", 5, f"""
SELECT CASE WHEN grouping(station_id) = 1 THEN 'fleet' ELSE 'station' END AS level, ts AS timestamp,
  station_id, {O.r2('sum(rate)', 6)} AS load_kw, count(*) AS active_sessions
FROM loop GROUP BY GROUPING SETS ((ts), (ts, station_id))"""))
def q_run_results(spark, sf_dir):
    root = _events_store(spark, sf_dir)
    run_id = analyze(spark, root, "events", "immediate_charge", 5)
    _, fleet, station = store.run_results(spark, root, run_id)
    cols = ["level", "timestamp", "station_id", round6("load_kw").alias("load_kw"), "active_sessions"]
    return fleet.select(*cols).unionByName(station.select(*cols))


def _run_kpi_oracle(policy: str = "immediate_charge") -> str:
    from chargeload.plans.queries import _metrics_oracle

    return (f"SELECT policy_name, sessions_total AS sessions_count, peak_load_kw, total_energy_kwh, completion_rate, "
            f"average_load_kw, load_factor, sessions_completed FROM ({_metrics_oracle(policy)})")


@query("run_kpis", _run_kpi_oracle())
def q_run_kpis(spark, sf_dir):
    root = _events_store(spark, sf_dir)
    run_id = analyze(spark, root, "events", "immediate_charge", 5)
    run, _, _ = store.run_results(spark, root, run_id)
    return run.select("policy_name", "sessions_count", "peak_load_kw", "total_energy_kwh", "completion_rate",
                      "average_load_kw", "load_factor", "sessions_completed")


def _policy_runs_oracle() -> str:
    from chargeload.plans.queries import METRIC_POLICIES

    runs = " UNION ALL ".join(f"SELECT * FROM ({_run_kpi_oracle(p)})" for p in METRIC_POLICIES)
    return f"SELECT k.*, n.fleet_rows FROM ({runs}) k, ({O.with_grid(5, 'SELECT count(DISTINCT ts) AS fleet_rows FROM steps')}) n"


@query("run_all_policies", _policy_runs_oracle())
def q_run_all_policies(spark, sf_dir):
    """All policies by one expansion, stored as a run each."""
    root = _events_store(spark, sf_dir)
    ids = analyze_policies(spark, root, "events", None, 5)
    runs = spark.read.schema(RUN).parquet(f"{root}/runs").where(F.col("run_id").isin(list(ids.values())))
    fleet = store.get_loads(spark, root, list(ids.values())).where("level = 'fleet'").groupBy("run_id").agg(F.count(F.lit(1)).alias("fleet_rows"))
    return runs.join(fleet, "run_id").select("policy_name", "sessions_count", "peak_load_kw", "total_energy_kwh", "completion_rate",
                                             "average_load_kw", "load_factor", "sessions_completed", "fleet_rows")


# --- A5: incremental (streaming) ingest ---------------------------------------------------

@query("ingest_stream", O.with_files("SELECT DISTINCT session_id, 'acn' AS source_dataset FROM jv", O.JSON_CTE))
def q_ingest_stream(spark, sf_dir):
    root = scratch_path(spark, "store")
    # both layouts in one folder tree; a second call finds nothing new
    path = fixtures.write_mixed_json_sessions(spark, sf_dir)
    ingest_stream(spark, "acn", path, root, max_files_per_trigger=8)
    if ingest_stream(spark, "acn", path, root):
        raise AssertionError("the stream read files again")
    return store.read_sessions(spark, root, "acn", ["session_id", "source_dataset"])
