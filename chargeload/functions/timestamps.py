"""Timestamp column builders (parsing, zone handling, durations).

All builders return ``Column`` expressions that stay inside whole-stage codegen;
none of them evaluates Python per row. The session time zone must be UTC
(``spark.sql.session.timeZone=UTC``), which ``chargeload.config.get_spark`` sets.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MICROS_PER_MINUTE = 60_000_000
MICROS_PER_HOUR = 3_600_000_000

# The default zone of JSON session records, and the four fallback
# datetime layouts of CSV session files, tried in this order (US reading first).
DEFAULT_RECORD_ZONE = "America/Los_Angeles"
FALLBACK_DATETIME_PATTERNS = (
    "M/d/yyyy H:m",        # %m/%d/%Y %H:%M
    "M/d/yyyy h:m:s a",    # %m/%d/%Y %I:%M:%S %p
    "yyyy-M-d H:m:s",      # %Y-%m-%d %H:%M:%S
    "d/M/yyyy H:m",        # %d/%m/%Y %H:%M
)

# ISO-8601 text as accepted for session timestamps: a date, optionally a time (hours,
# minutes, seconds, fraction; each part optional from the right) and then optionally a
# UTC offset (Z, ±HH, ±HHMM, ±HH:MM). Anything else parses to NULL.
_ISO_TEXT = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)?)?$"
_HAS_OFFSET = r"[T ]\d{2}(:\d{2}(:\d{2}(\.\d+)?)?)?(Z|[+-]\d{2}(:?\d{2})?)$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@lru_cache(maxsize=1)
def _jvm_zone_ids() -> tuple[str, ...]:
    """Region zone ids the executors' JVM can convert (the Python tz database's list where
    the JVM is not reachable from here, e.g. over Spark Connect)."""
    try:
        spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        ids = spark.sparkContext._jvm.java.time.ZoneId.getAvailableZoneIds()  # noqa: SLF001
        return tuple(sorted(str(z) for z in ids))
    except Exception:  # noqa: BLE001
        import zoneinfo

        return tuple(sorted(zoneinfo.available_timezones()))


def known_zone(tz: Column | str) -> Column:
    """``tz`` if the JVM knows it as a region zone id, else NULL (never throws)."""
    tz = _col(tz)
    return F.when(tz.isin(list(_jvm_zone_ids())), tz)


def iso_timestamp(text: Column | str, naive_zone: Column | str | None = None, checked: bool = False) -> Column:
    """Parse ISO text. Offset present → converted to UTC; naive → read in ``naive_zone``
    (a column holding a zone id; NULL zone → NULL result) or as UTC when not given.
    Non-ISO text, unknown zones and impossible dates give NULL. ``checked=True`` says
    ``naive_zone`` already went through :func:`known_zone`."""
    t = F.trim(_col(text))
    iso = t.rlike(_ISO_TEXT)
    as_ts = t.try_cast("timestamp")
    has_offset = t.rlike(_HAS_OFFSET)
    if naive_zone is None:
        naive = as_ts
    else:
        zone = _col(naive_zone) if checked else known_zone(naive_zone)
        naive = F.when(zone.isNotNull(), F.to_utc_timestamp(as_ts, zone))
    return F.when(iso, F.when(has_offset, as_ts).otherwise(naive))


def record_zone(zone_present: Column, zone_value: Column) -> Column:
    """Zone of a JSON record: key absent → the fixed default zone; null or '' → UTC."""
    return (F.when(~zone_present, F.lit(DEFAULT_RECORD_ZONE))
            .when(zone_value.isNull() | (zone_value == ""), F.lit("UTC"))
            .otherwise(zone_value))


def multi_format_timestamp(text: Column | str) -> Column:
    """ISO first (offset → UTC, naive → UTC), then the fixed fallback layouts in order."""
    text = _col(text)
    t = F.when(text != "", text)
    tries = [iso_timestamp(t)] + [F.try_to_timestamp(t, F.lit(p)) for p in FALLBACK_DATETIME_PATTERNS]
    return F.coalesce(*tries)


def _minutes_between(start: Column | str, end: Column | str) -> Column:
    diff = F.unix_micros(_col(end)) - F.unix_micros(_col(start))
    return F.call_function("div", F.greatest(F.lit(0).cast("long"), diff), F.lit(MICROS_PER_MINUTE))


def duration_minutes(start: Column | str, end: Column | str) -> Column:
    """Whole minutes from start to end, never negative; NULL when either end is NULL or the
    minutes are beyond an integer (more than four thousand years)."""
    start, end = _col(start), _col(end)
    return F.when(start.isNotNull() & end.isNotNull(), _minutes_between(start, end).try_cast("int"))


def duration_overflows(start: Column | str, end: Column | str) -> Column:
    """Are there more minutes from start to end than an integer holds?"""
    return F.coalesce(_minutes_between(start, end) > F.lit(2**31 - 1), F.lit(False))


def micros(ts: Column | str) -> Column:
    return F.unix_micros(_col(ts))


def from_micros(us: Column) -> Column:
    return F.timestamp_micros(us)
