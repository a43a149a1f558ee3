"""Scalar column builders (C-family): timestamps, numbers, text, rounding."""

from chargeload.functions.numbers import hms_minutes, positive, round6, round_half_up, safe_double, text_or_null
from chargeload.functions.timestamps import (
    DEFAULT_RECORD_ZONE,
    FALLBACK_DATETIME_PATTERNS,
    duration_minutes,
    from_micros,
    iso_timestamp,
    known_zone,
    micros,
    multi_format_timestamp,
    record_zone,
)

__all__ = [
    "DEFAULT_RECORD_ZONE", "FALLBACK_DATETIME_PATTERNS", "duration_minutes", "from_micros",
    "hms_minutes", "iso_timestamp", "positive", "known_zone", "micros", "multi_format_timestamp",
    "record_zone", "round6", "round_half_up", "safe_double", "text_or_null",
]
