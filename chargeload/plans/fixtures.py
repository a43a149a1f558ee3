"""Raw session files derived from ``events``, written to the shared folder.

The source-side queries (readers, normalisers, ingest, stream) read real files through
the real readers. These builders derive those files from the whole ``events`` table
with Spark (distributed writes, one folder per call), varying the awkward cases the
sources must handle: per-record zones (absent / null / empty / unknown), explicit UTC
offsets, missing keys, junk numbers, several datetime layouts, h:mm and h:mm:ss times,
empty cells and alternative header names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chargeload.config import scratch_path
from chargeload.plans.adapters import events_raw_sessions, read_table

OFFSET_ZONE = "Asia/Kolkata"      # +05:30, no DST
UNKNOWN_ZONE = "Nowhere/Atlantis"


def _events_with_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event columns next to the session columns derived from the same row (one scan)."""
    return events_raw_sessions(read_table(spark, sf_dir, "events"), keep=("event_id", "ts", "user_id"))


def _local_text(ts: Column, zone: Column, pattern: str = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") -> Column:
    return F.date_format(F.from_utc_timestamp(ts, zone), pattern)


def json_zone_case(eid: Column) -> Column:
    """'absent' | 'null' | zone text for the record's ``timezone`` key."""
    k = eid % 6
    return (F.when(k == 0, "absent").when(k == 1, "America/Los_Angeles").when(k == 2, "America/New_York")
            .when(k == 3, "").when(k == 4, "null").otherwise(UNKNOWN_ZONE))


def json_lines(spark: SparkSession, sf_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """One JSON text line per event, shaped like a JSON session record."""
    e = _events_with_sessions(spark, sf_dir)
    eid = F.col("event_id")
    case = json_zone_case(eid)
    eff_zone = (F.when(case == "absent", "America/Los_Angeles").when(case.isin("", "null"), "UTC")
                .when(case == UNKNOWN_ZONE, "UTC").otherwise(case))
    with_offset = eid % 10 == 7

    def ts_text(c: Column) -> Column:
        return F.when(with_offset, F.concat(_local_text(c, F.lit(OFFSET_ZONE)), F.lit("+05:30"))) \
                .otherwise(_local_text(c, eff_zone))

    minutes = ((F.unix_micros("departure_ts") - F.unix_micros(F.col("ts").cast("timestamp"))) / 60_000_000).cast("long")
    done = F.timestamp_micros(F.unix_micros("arrival_ts") + (minutes * 3 / 4).cast("long") * 60_000_000)
    rec = F.struct(
        F.when(eid % 401 != 0, eid.cast("string")).alias("_id"),   # NULL → key absent → id ''

        ts_text(F.col("arrival_ts")).alias("connectionTime"),
        ts_text(F.col("departure_ts")).alias("disconnectTime"),
        ts_text(done).alias("doneChargingTime"),
        F.when(eid % 13 == 0, F.lit("not_a_number"))
         .otherwise(F.col("energy_delivered_kwh").cast("string")).alias("kWhDelivered"),
        F.col("energy_requested_kwh").alias("kWhRequested"),
        F.col("max_charge_rate_kw").alias("maxRate"),
        F.col("user_id").cast("string").alias("userID"),
        F.col("station_id").alias("stationID"),
        F.when(eid % 5 != 0, F.concat(F.lit("P"), (eid % 4).cast("string"))).alias("spaceID"),
        F.lit("site-1").alias("siteID"),
    )
    base = F.to_json(rec)
    zone_field = (F.when(case == "absent", F.lit(""))
                  .when(case == "null", F.lit(',"timezone":null'))
                  .otherwise(F.concat(F.lit(',"timezone":"'), case, F.lit('"'))))
    return e.select(*keep, F.concat(F.regexp_replace(base, r"\}$", ""), zone_field, F.lit("}")).alias("value"))


_WRITTEN: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """The folder that ``write(path)`` filled, written once per session and table folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = scratch_path(spark, name)
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def write_json_sessions(spark: SparkSession, sf_dir: str) -> str:
    return once(spark, sf_dir, "json-sessions", lambda path: json_lines(spark, sf_dir).write.text(path))


def write_mixed_json_sessions(spark: SparkSession, sf_dir: str) -> str:
    """The same records in one folder tree of 16 files: 8 of lines (one folder each), 8 of one array each."""
    def write(path: str) -> None:
        e = json_lines(spark, sf_dir, keep=("event_id",))
        e = e.withColumn("bucket", F.col("event_id") % 16)
        ends = e.where("bucket >= 8").groupBy("bucket").agg(F.min("event_id").alias("first"))
        arrays = e.where("bucket >= 8").join(F.broadcast(ends), "bucket")       # at most 8 rows
        arrays = arrays.select("bucket", F.col("event_id").alias("at"),
                               F.concat(F.when(F.col("event_id") > F.col("first"), F.lit(",")).otherwise(F.lit("")),
                                        "value").alias("value"))
        for at, mark in ((-1, "["), (2**62, "]")):
            arrays = arrays.unionByName(ends.select("bucket", F.lit(at).cast("bigint").alias("at"), F.lit(mark).alias("value")))
        lines = e.where("bucket < 8").select("bucket", F.col("event_id").alias("at"), "value")
        (lines.unionByName(arrays).repartition(16, "bucket").sortWithinPartitions("bucket", "at")
         .select("bucket", "value").write.partitionBy("bucket").text(path))

    return once(spark, sf_dir, "mixed-json-sessions", write)


# --- CSV -------------------------------------------------------------------------------

CSV_BUCKETS = 8


def csv_datetime_text(c: Column, eid: Column) -> Column:
    """Start/end text in one of five layouts (by event), junk for a few events."""
    k = eid % 5
    text = (F.when(k == 0, F.date_format(c, "yyyy-MM-dd HH:mm:ss"))
            .when(k == 1, F.date_format(c, "MM/dd/yyyy HH:mm"))
            .when(k == 2, F.date_format(c, "M/d/yyyy h:mm:ss a"))
            .when(k == 3, F.date_format(c, "dd/MM/yyyy HH:mm"))
            .otherwise(F.concat(_local_text(c, F.lit(OFFSET_ZONE), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+05:30"))))
    return F.when(eid % 23 == 0, F.lit("not a date")).otherwise(text)


def charging_time_text(minutes: Column, eid: Column) -> Column:
    """'h:mm:ss' (seconds from the event id), 'h:mm' for some, 'invalid' for a few."""
    m = (minutes * 3 / 4).cast("long")
    hh, mm, ss = (m / 60).cast("long").cast("string"), F.lpad((m % 60).cast("string"), 2, "0"), \
        F.lpad((eid % 60).cast("string"), 2, "0")
    return (F.when(eid % 17 == 0, F.lit("invalid"))
            .when(eid % 7 == 3, F.concat(hh, F.lit(":"), mm))
            .otherwise(F.concat(hh, F.lit(":"), mm, F.lit(":"), ss)))


def csv_frame(spark: SparkSession, sf_dir: str, alias_headers: bool = False) -> DataFrame:
    e = _events_with_sessions(spark, sf_dir)
    eid = F.col("event_id")
    ts = F.col("ts").cast("timestamp")
    minutes = ((F.unix_micros("departure_ts") - F.unix_micros(ts)) / 60_000_000).cast("long")
    names = (("Start Date / Time", "End Date / Time", "Energy (kWh)", "Charging Time (hh:mm:ss)", "Port")
             if alias_headers else
             ("Start_Date___Time", "End_Date___Time", "Total_kWh", "Charging_Time__hh_mm_ss_", "Port_Number"))
    cols = []
    if not alias_headers:
        cols.append(F.col("station_id").alias("Station_Name"))
    cols += [
        csv_datetime_text(F.col("arrival_ts"), eid).alias(names[0]),
        csv_datetime_text(F.col("departure_ts"), eid).alias(names[1]),
        F.when(eid % 13 == 0, F.lit("n/a")).otherwise(F.col("energy_delivered_kwh").cast("string")).alias(names[2]),
        charging_time_text(minutes, eid).alias(names[3]),
        F.concat(F.lit("EVSE-"), (eid % 50).cast("string")).alias("EVSE_ID"),
        F.when(eid % 11 != 0, (eid % 3 + 1).cast("string")).alias(names[4]),
        F.lit("1 Main St").alias("Address"),
        F.lit("Springfield").alias("City"),
        eid.cast("string").alias("Session_Ref"),
        (eid % CSV_BUCKETS).alias("bucket"),
        eid.alias("_order"),
    ]
    return e.select(*cols)


def write_csv_sessions(spark: SparkSession, sf_dir: str, alias_headers: bool = False) -> str:
    """CSV files, one per bucket folder (``bucket=<event_id mod 8>``), rows in event order.

    Buckets are hash-balanced by event id, so no file holds a skewed share."""
    return once(spark, sf_dir, f"csv-sessions-{alias_headers}".lower(),
                lambda path: _write_csv(csv_frame(spark, sf_dir, alias_headers), path))


def _write_csv(df: DataFrame, path: str) -> None:
    (df.repartition(CSV_BUCKETS, "bucket").sortWithinPartitions("bucket", "_order").drop("_order")
       .write.mode("append").partitionBy("bucket").option("header", True).csv(path))


def write_mixed_csv_sessions(spark: SparkSession, sf_dir: str) -> str:
    """The same rows under three headers in one folder: buckets 0-2 as usual, 3-5 with the columns
    in another order, 6 and 7 with other names (and no station column)."""
    def write(path: str) -> None:
        usual = csv_frame(spark, sf_dir)
        turned = usual.select(*reversed(usual.columns))
        _write_csv(usual.where("bucket < 3"), path)
        _write_csv(turned.where("bucket BETWEEN 3 AND 5"), path)
        _write_csv(csv_frame(spark, sf_dir, alias_headers=True).where("bucket > 5"), path)

    return once(spark, sf_dir, "mixed-csv-sessions", write)


def _quoted(c: Column) -> Column:
    """A quoted cell; NULL is an empty one."""
    return F.coalesce(F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"')), F.lit(""))


def address_text(eid: Column) -> Column:
    """Addresses with quotes, commas, line breaks and empty lines, by event."""
    k = eid % 4
    return (F.when(k == 0, F.lit("1 Main St")).when(k == 1, F.lit('Gate "A"\nlevel 2'))
            .when(k == 2, F.lit("Quay 3, left")).otherwise(F.lit("one\n\n\"two\"")))


def _write_csv_lines(rows: DataFrame, headers: Column, path: str) -> None:
    """Text files by bucket: each with its header, then ``value`` in event order."""
    ends = rows.select("bucket").distinct().select("bucket", F.lit(-1).cast("bigint").alias("at"), headers.alias("value"))
    (rows.select("bucket", F.col("event_id").alias("at"), "value").unionByName(ends)
     .repartition(CSV_BUCKETS, "bucket").sortWithinPartitions("bucket", "at").select("bucket", "value")
     .write.partitionBy("bucket").text(path))


def write_quoted_csv_sessions(spark: SparkSession, sf_dir: str) -> str:
    """CSV files with quoted stations and addresses, most of them over several lines."""
    def write(path: str) -> None:
        e, eid = _events_with_sessions(spark, sf_dir), F.col("event_id")
        cells = [_quoted(F.col("station_id")), F.coalesce(F.date_format("arrival_ts", "yyyy-MM-dd HH:mm:ss"), F.lit("")),
                 _quoted(address_text(eid)), eid.cast("string")]
        rows = e.select("event_id", (eid % CSV_BUCKETS).alias("bucket"), F.concat_ws(",", *cells).alias("value"))
        _write_csv_lines(rows, F.lit('Station_Name,Start_Date___Time,"Address",Session_Ref'), path)

    return once(spark, sf_dir, "quoted-csv-sessions", write)


def write_odd_csv_sessions(spark: SparkSession, sf_dir: str) -> str:
    """CSV files whose cells go to the limits: ends in the year 9999, hours beyond an integer of minutes, rows
    with a cell too many or cut off after the start, and headers that differ only in letter case (buckets 3 and 4)."""
    def write(path: str) -> None:
        e, eid = _events_with_sessions(spark, sf_dir), F.col("event_id")
        minutes = ((F.unix_micros("departure_ts") - F.unix_micros(F.col("ts").cast("timestamp"))) / 60_000_000).cast("long")
        text = lambda c: F.coalesce(F.date_format(c, "yyyy-MM-dd HH:mm:ss"), F.lit(""))
        twins = (eid % CSV_BUCKETS).between(3, 4)
        start = F.concat(F.coalesce("station_id", F.lit("")), F.lit(","), text("arrival_ts"), F.when(twins, F.lit(",twin")).otherwise(F.lit("")))
        rest = F.concat_ws(
            ",", F.when(eid % 29 == 0, F.lit("9999-12-31 00:00:00")).otherwise(text("departure_ts")),
            F.coalesce(F.when(eid % 13 == 0, F.lit("n/a")).otherwise(F.col("energy_delivered_kwh").cast("string")), F.lit("")),
            F.when(eid % 31 == 0, F.lit("40000000:00:00")).otherwise(charging_time_text(minutes, eid)),
            F.when(eid % 37 == 0, F.lit("surplus")))
        rows = e.select("event_id", (eid % CSV_BUCKETS).alias("bucket"), F.when(eid % 41 == 0, start).otherwise(F.concat(start, F.lit(","), rest)).alias("value"))
        names = "End_Date___Time,Total_kWh,Charging_Time__hh_mm_ss_"
        _write_csv_lines(rows, F.when(F.col("bucket").between(3, 4), F.lit(f"Station_Name,Start_Date___Time,start_date___time,{names}"))
                         .otherwise(F.lit(f"Station_Name,Start_Date___Time,{names}")), path)

    return once(spark, sf_dir, "odd-csv-sessions", write)
